"""Scoring, calibration and resampling of two fixed predictors of the home win."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import stats as S
from pregame.plans.oracle import oracle
from pregame.plans.rating_queries import draws_sql, uniform_sql
from pregame.plans.registry import query
from pregame.plans.util import r6
from pregame.sources import views

DRAWS = 100
SCORED_SQL = """scored AS (SELECT game_id AS row_id, league, season, game_date, CAST(home_pts > away_pts AS INT) AS y, home_pts - away_pts AS margin,
    0.5::DOUBLE + (home_team - away_team) / 100.0::DOUBLE AS p, (home_team + 1) / 27.0::DOUBLE AS q FROM decided)"""


def scored(spark, sf_dir):
    """Decided games with the outcome and two predictions."""
    gm = views.decided(spark, sf_dir)
    return gm.select(
        F.col("game_id").alias("row_id"), "league", "season", "game_date",
        (F.col("home_pts") > F.col("away_pts")).cast("int").alias("y"),
        (F.col("home_pts") - F.col("away_pts")).alias("margin"),
        (F.lit(0.5) + (F.col("home_team") - F.col("away_team")) / 100.0).alias("p"),
        ((F.col("home_team") + 1) / 27.0).alias("q"),
    )


def sql(body: str, recursive: bool = False) -> str:
    return oracle("decided", f", {SCORED_SQL}{body if body.startswith(',') else ' ' + body}", recursive)


def ll(p: str) -> str:
    return f"(-(y * LN(GREATEST(1e-15::DOUBLE, LEAST({1 - 1e-15!r}::DOUBLE, {p}))) + (1 - y) * LN(1 - GREATEST(1e-15::DOUBLE, LEAST({1 - 1e-15!r}::DOUBLE, {p})))))"


@query(
    "class_metrics",
    "ST-01",
    sql(f"""SELECT league, COUNT(*) AS n, ROUND(AVG({ll('p')}), 6) AS log_loss, ROUND(AVG((p - y) * (p - y)), 6) AS brier,
    ROUND(AVG(CAST((p > 0.5) = (y > 0.5) AS DOUBLE)), 6) AS accuracy FROM scored GROUP BY league"""),
)
def _class_metrics(spark, sf_dir):
    out = S.class_metrics(scored(spark, sf_dir), "y", "p", ["league"])
    return out.select("league", "n", r6("log_loss"), r6("brier"), r6("accuracy"))


@query(
    "value_metrics",
    "ST-01",
    sql("SELECT league, COUNT(*) AS n, ROUND(AVG(ABS(margin - 40 * (p - 0.5))), 6) AS mae, ROUND(SQRT(AVG(POW(margin - 40 * (p - 0.5), 2))), 6) AS rmse FROM scored GROUP BY league"),
)
def _value_metrics(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("m", 40 * (F.col("p") - 0.5))
    return S.value_metrics(df, "margin", "m", ["league"]).select("league", "n", r6("mae"), r6("rmse"))


@query(
    "roc_auc",
    "ST-02",
    sql(""", r AS (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored)
    SELECT CAST(SUM(y) AS BIGINT) AS positives, CAST(SUM(1 - y) AS BIGINT) AS negatives,
    ROUND((SUM(CASE WHEN y = 1 THEN rk END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y)::DOUBLE * SUM(1 - y)), 6) AS auc FROM r"""),
)
def _auc(spark, sf_dir):
    return S.auc(scored(spark, sf_dir), "y", "p").withColumn("auc", r6("auc"))


def _bins_sql(p: str = "p", n: int = 10, op: str = ">") -> str:
    edges = S.uniform_edges(n)
    return " + ".join(f"CAST({p} {op} {e!r}::DOUBLE AS INT)" for e in edges[1:-1])


_EDGE = "list_value(" + ", ".join(f"{e!r}::DOUBLE" for e in S.uniform_edges(10)) + ")"
BINS_SQL = f"""bn AS (SELECT CAST({_bins_sql()} AS INT) AS bin, y, p FROM scored),
    bins AS (SELECT bin, COUNT(*) AS n, AVG(p) AS mean_predicted, AVG(y) AS observed FROM bn GROUP BY bin)"""
_OUT = "ROUND(mean_predicted, 6) AS mean_predicted, ROUND(observed, 6) AS observed"


@query(
    "reliability_bins",
    "ST-03",
    sql(f", {BINS_SQL} SELECT bin, ROUND({_EDGE}[bin + 1], 6) AS lower, ROUND({_EDGE}[bin + 2], 6) AS upper, n, {_OUT} FROM bins"),
)
def _bins(spark, sf_dir):
    out = S.calibration_bins(scored(spark, sf_dir), "y", "p")
    return out.select("bin", r6("lower"), r6("upper"), "n", r6("mean_predicted"), r6("observed"))


@query(
    "reliability_bins_left_closed",
    "ST-03",
    sql(f""", b AS (SELECT CAST({_bins_sql(op='>=')} AS INT) AS bin, COUNT(*) AS n, AVG(p) AS mean_predicted, AVG(y) AS observed FROM scored GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, COALESCE(n, 0) AS n, {_OUT} FROM range(10) t(i) LEFT JOIN b ON b.bin = i"""),
)
def _bins_left(spark, sf_dir):
    out = S.calibration_bins(scored(spark, sf_dir), "y", "p", closed="left", keep_empty=True)
    return out.select("bin", "n", r6("mean_predicted"), r6("observed"))


@query(
    "reliability_quantile_bins",
    "ST-03",
    sql(""", e AS (SELECT list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))) AS ed FROM scored),
    b AS (SELECT *, CAST(len(list_filter(ed[2:len(ed) - 1], lambda x: x < p)) AS INT) AS bin FROM scored, e)
    SELECT bin, ROUND(ANY_VALUE(ed[bin + 1]), 6) AS lower, ROUND(ANY_VALUE(ed[bin + 2]), 6) AS upper, COUNT(*) AS n, ROUND(AVG(p), 6) AS mean_predicted, ROUND(AVG(y), 6) AS observed FROM b GROUP BY bin"""),
)
def _bins_quantile(spark, sf_dir):
    out = S.calibration_bins(scored(spark, sf_dir), "y", "p", strategy="quantile")
    return out.select("bin", r6("lower"), r6("upper"), "n", r6("mean_predicted"), r6("observed"))


@query(
    "calibration_error",
    "ST-04",
    sql(f""", {BINS_SQL} SELECT ROUND(SUM(n * ABS(mean_predicted - observed)) / SUM(n), 6) AS ece, ROUND(MAX(ABS(mean_predicted - observed)), 6) AS mce,
    ARG_MAX(bin, ABS(mean_predicted - observed)) AS mce_bin, ARG_MAX(n, ABS(mean_predicted - observed)) AS mce_bin_rows, COUNT(*) FILTER (n < 30) AS thin_bins FROM bins"""),
)
def _ece(spark, sf_dir):
    out = S.ece(S.calibration_bins(scored(spark, sf_dir), "y", "p"))
    return out.select(r6("ece"), r6("mce"), "mce_bin", "mce_bin_rows", "thin_bins")


@query(
    "brier_decomposition",
    "ST-05",
    sql(f""", {BINS_SQL}, r AS (SELECT AVG(y) AS base, AVG((p - y) * (p - y)) AS raw FROM scored)
    SELECT ROUND(SUM(n * POW(mean_predicted - observed, 2)) / SUM(n), 6) AS reliability, ROUND(SUM(n * POW(observed - base, 2)) / SUM(n), 6) AS resolution,
    ROUND(ANY_VALUE(base * (1 - base)), 6) AS uncertainty, ROUND(SUM(n * (POW(mean_predicted - observed, 2) + observed * (1 - observed))) / SUM(n), 6) AS brier_binned,
    ROUND(ANY_VALUE(raw), 6) AS brier_raw, ROUND(ANY_VALUE(raw) - SUM(n * (POW(mean_predicted - observed, 2) + observed * (1 - observed))) / SUM(n), 6) + 0.0 AS within_bin_gap FROM bins, r"""),
)
def _brier(spark, sf_dir):
    out = S.brier_decomposition(scored(spark, sf_dir), "y", "p")
    return out.select(*[r6(c) for c in out.columns])


# ---- resampling ---------------------------------------------------------------------------------

LOSS_SQL = f"losses AS (SELECT row_id, {ll('p')} AS lp, {ll('q')} AS lq FROM scored)"


def losses(spark, sf_dir):
    y = F.col("y").cast("double")
    return scored(spark, sf_dir).select(
        "row_id", S.per_row_loss(y, F.col("p"), True).alias("lp"), S.per_row_loss(y, F.col("q"), True).alias("lq")
    )


def _interval_sql(per: str) -> str:
    return f"SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, STDDEV_SAMP(m) AS sd, COUNT(*) AS draws FROM {per}"


@query(
    "paired_bootstrap",
    "ST-07 ST-13",
    sql(f""", {LOSS_SQL}, src AS (SELECT row_id, lp - lq AS d FROM losses), dr AS ({draws_sql('src', DRAWS, 7, 'd, row_id')}),
    per AS (SELECT draw, SUM(w * d) / SUM(w) AS m FROM dr GROUP BY draw), i AS ({_interval_sql('per')}), n AS (SELECT COUNT(*) AS n, AVG(d) AS difference FROM src)
    SELECT n, ROUND(difference, 6) AS difference, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, draws, lo > 0 OR hi < 0 AS excludes_zero,
    (lo > 0 OR hi < 0) AND LEAST(ABS(lo), ABS(hi)) < 0.0005 AS redraw FROM n, i"""),
)
def _paired(spark, sf_dir):
    out = S.needs_redraw(S.paired_bootstrap(losses(spark, sf_dir), "lp", "lq", DRAWS), 0.0005)
    return out.select("n", r6("difference"), r6("lo"), r6("hi"), "draws", "excludes_zero", "redraw")


@query(
    "redrawn_intervals",
    "ST-07",
    sql(f""", {LOSS_SQL}, src AS (SELECT row_id + s * 1000003 AS row_id, s, lp - lq AS d FROM losses, range(3) t(s)), dr AS ({draws_sql('src', 50, 7, 'd, s, row_id')}),
    per AS (SELECT s, draw, SUM(w * d) / SUM(w) AS m FROM dr GROUP BY ALL)
    SELECT CAST(s AS INT) AS seed, ROUND(quantile_cont(m, 0.025), 6) AS lo, ROUND(quantile_cont(m, 0.975), 6) AS hi,
    quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS excludes_zero FROM per GROUP BY s"""),
)
def _redrawn(spark, sf_dir):
    out = S.redrawn_intervals(losses(spark, sf_dir), "lp", "lq", 50, [0, 1, 2])
    return out.select("seed", r6("lo"), r6("hi"), "excludes_zero")


@query(
    "ratio_change_interval",
    "ST-08",
    sql(f""", {LOSS_SQL}, dr AS ({draws_sql('losses', DRAWS, 7, 'lp, lq, row_id')}), per AS (SELECT draw, 100 * (SUM(w * lq) / SUM(w * lp) - 1) AS m FROM dr GROUP BY draw),
    i AS ({_interval_sql('per')}) SELECT ROUND(100 * ((SELECT AVG(lq) / AVG(lp) FROM losses) - 1), 5) AS change_pct, ROUND(lo, 5) AS lo, ROUND(hi, 5) AS hi, draws FROM i"""),
)
def _ratio(spark, sf_dir):
    out = S.bootstrap_ratio_change(losses(spark, sf_dir), "lq", "lp", DRAWS)
    return out.select(*[F.round(c, 5).alias(c) for c in ("change_pct", "lo", "hi")], "draws")


@query(
    "null_calibration_error",
    "ST-09",
    sql(f""", d AS (SELECT draw, LEAST(CAST(FLOOR(p * 10) AS INT), 9) AS bin, p, CAST({uniform_sql('row_id', 'draw', 11)} < p AS INT) AS hit FROM scored, range(50) t(draw)),
    b AS (SELECT draw, bin, COUNT(*) AS n, SUM(p) AS sp, SUM(hit) AS sy FROM d GROUP BY ALL), e AS (SELECT draw, SUM(ABS(sp - sy)) / SUM(n) AS ece FROM b GROUP BY draw)
    SELECT COUNT(*) AS draws, ROUND(AVG(ece), 6) AS mean_ece, ROUND(quantile_cont(ece, 0.5), 6) AS median_ece, ROUND(quantile_cont(ece, 0.95), 6) AS p95_ece FROM e"""),
)
def _null(spark, sf_dir):
    out = S.null_ece(scored(spark, sf_dir), "p", 50)
    return out.select("draws", r6("mean_ece"), r6("median_ece"), r6("p95_ece"))


@query(
    "accuracy_interval",
    "ST-10",
    sql(f""", src AS (SELECT row_id, CAST((p > 0.5) = (y = 1) AS DOUBLE) AS hit FROM scored), dr AS ({draws_sql('src', DRAWS, 7, 'hit, row_id')}),
    per AS (SELECT draw, SUM(w * hit) / SUM(w) AS m FROM dr GROUP BY draw), i AS ({_interval_sql('per')}), n AS (SELECT COUNT(*) AS n, AVG(hit) AS mean FROM src)
    SELECT n, ROUND(mean, 6) AS mean, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi FROM n, i"""),
)
def _accuracy(spark, sf_dir):
    out = S.metric_interval(scored(spark, sf_dir), "y", "p", DRAWS)
    return out.select("n", r6("mean"), r6("lo"), r6("hi"))


@query(
    "auc_interval",
    "ST-10 ST-02",
    sql(f""", src AS (SELECT row_id, y, LEAST(CAST(FLOOR(p * 1024) AS INT), 1023) AS s FROM scored), dr AS ({draws_sql('src', 40, 7, 'y, s, row_id')}),
    g AS (SELECT draw, s, SUM(w * y) AS pos, SUM(w * (1 - y)) AS neg FROM dr GROUP BY ALL),
    c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
    per AS (SELECT draw, SUM(pos * (b + neg * 0.5)) / (SUM(pos)::DOUBLE * SUM(neg)) AS m FROM c GROUP BY draw), i AS ({_interval_sql('per')})
    SELECT ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, draws FROM i"""),
)
def _auc_interval(spark, sf_dir):
    return S.auc_interval(scored(spark, sf_dir), "y", "p", 40).select(r6("lo"), r6("hi"), "draws")


@query(
    "mcnemar_test",
    "ST-10",
    sql(""", c AS (SELECT COUNT(*) FILTER ((p > 0.5) = (y = 1) AND (q > 0.5) <> (y = 1)) AS only_a, COUNT(*) FILTER ((p > 0.5) <> (y = 1) AND (q > 0.5) = (y = 1)) AS only_b FROM scored),
    k AS (SELECT *, LEAST(only_a, only_b) AS k, only_a + only_b AS n FROM c)
    SELECT only_a, only_b, ROUND(LEAST(1.0, 2 * (SELECT SUM(EXP(LGAMMA(n + 1) - LGAMMA(i + 1) - LGAMMA(n - i + 1) - n * LN(2))) FROM range(k.k + 1) t(i))), 6) AS p_value FROM k"""),
)
def _mcnemar(spark, sf_dir):
    return S.mcnemar(scored(spark, sf_dir), "y", "p", "q").withColumn("p_value", r6("p_value"))


# ---- margins ------------------------------------------------------------------------------------


def cdf_sql(z: str) -> str:
    from pregame.functions.scalar import _HART_DEN, _HART_NUM

    def poly(coefs: list[float]) -> str:
        out = f"{coefs[0]!r}::DOUBLE"
        for c in coefs[1:]:
            out = f"({out} * ABS({z}) + {c!r}::DOUBLE)"
        return out

    low = f"(EXP(-({z}) * ({z}) / 2) * {poly(_HART_NUM)} / {poly(_HART_DEN)})"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {low} ELSE {low} END)"


GRID = S.sigma_grid(10.0, 60.0, 26)
# A margin forecast that is not the outcome: 90 points per unit of predicted probability.
FORECAST_SQL = "fc AS (SELECT *, 90 * (p - 0.5) AS f, margin - 90 * (p - 0.5) AS resid FROM scored)"


def forecast(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("f", 90 * (F.col("p") - 0.5)).withColumn("resid", F.col("margin") - F.col("f"))


@query(
    "margin_sigma",
    "ST-11 J-23",
    sql(f""", {FORECAST_SQL}, g AS (SELECT y, sigma, GREATEST(1e-6::DOUBLE, LEAST({1 - 1e-6!r}::DOUBLE, {cdf_sql('f / sigma')})) AS pr FROM fc, (SELECT unnest([{', '.join(repr(s) + '::DOUBLE' for s in GRID)}]) AS sigma) WHERE season = 1998),
    l AS (SELECT sigma, AVG(-(y * LN(pr) + (1 - y) * LN(1 - pr))) AS log_loss FROM g GROUP BY sigma)
    SELECT sigma, ROUND(log_loss, 6) AS log_loss FROM l ORDER BY l.log_loss, sigma LIMIT 1"""),
)
def _sigma(spark, sf_dir):
    out = S.fit_sigma(forecast(spark, sf_dir).filter("season = 1998"), "f", "y", GRID)
    return out.select("sigma", r6("log_loss"))


@query("margin_probability", "ST-11 F-23", sql(f", {FORECAST_SQL} SELECT row_id, ROUND({cdf_sql('f / 40')}, 6) AS prob FROM fc"))
def _margin_prob(spark, sf_dir):
    df = forecast(spark, sf_dir)
    return df.select("row_id", r6(S.margin_to_prob(df, "f", F.lit(40)), "prob"))


@query(
    "heteroscedastic_sigma",
    "ST-11",
    sql(f", {FORECAST_SQL} SELECT ROUND(regr_intercept(ABS(resid), q), 5) AS a, ROUND(regr_slope(ABS(resid), q), 5) AS b, ROUND(CORR(q, ABS(resid)), 5) AS r FROM fc WHERE season < 1998"),
)
def _hetero(spark, sf_dir):
    out = S.heteroscedastic_sigma(forecast(spark, sf_dir).filter("season < 1998"), "q", "resid")
    return out.select(*[F.round(c, 5).alias(c) for c in ("a", "b", "r")])


@query(
    "empirical_margin_probability",
    "ST-11",
    sql(f""", {FORECAST_SQL}, pool AS (SELECT resid FROM fc WHERE season = 1998), asks AS (SELECT DISTINCT f FROM fc WHERE season > 1998),
    c AS (SELECT f, (SELECT COUNT(*) FROM pool WHERE resid <= -f) / (SELECT COUNT(*) FROM pool) AS cdf FROM asks)
    SELECT row_id, ROUND(GREATEST(1e-6, LEAST(1 - 1e-6, 1 - cdf)), 6) AS empirical_p FROM fc JOIN c USING (f) WHERE season > 1998"""),
)
def _empirical(spark, sf_dir):
    df = forecast(spark, sf_dir)
    out = S.empirical_prob(df.filter("season > 1998"), "f", df.filter("season = 1998"), "resid")
    return out.select("row_id", r6("empirical_p"))


@query(
    "calibrator_inversions",
    "ST-12",
    sql(""", c AS (SELECT DISTINCT p, CASE WHEN q > 0.9 THEN p - 0.05 ELSE p END AS cal FROM scored), d AS (SELECT cal - LAG(cal) OVER (ORDER BY p, cal) AS d FROM c)
    SELECT (SELECT COUNT(*) FROM c) AS points, COUNT(*) FILTER (d < -1e-12) AS inversions FROM d"""),
)
def _inversions(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("cal", F.when(F.col("q") > 0.9, F.col("p") - 0.05).otherwise(F.col("p")))
    return S.inversions(df, "p", "cal")


@query("per_row_losses", "ST-13", sql(f", {LOSS_SQL} SELECT row_id, ROUND(lp, 6) AS lp, ROUND(lq, 6) AS lq FROM losses"))
def _per_row(spark, sf_dir):
    return losses(spark, sf_dir).select("row_id", r6("lp"), r6("lq"))


@query(
    "season_panels",
    "ST-14",
    sql(f""", n AS (SELECT season, COUNT(*) AS games FROM scored GROUP BY season), done AS (SELECT season FROM n WHERE games >= 0.8 * (SELECT quantile_cont(games, 0.5) FROM n)),
    t AS (SELECT s.*, panel FROM scored s JOIN done USING (season), (VALUES ('all'), ('early')) v(panel) WHERE panel = 'all' OR MONTH(game_date) = 8)
    SELECT season, panel, COUNT(*) AS n, ROUND(AVG({ll('p')}), 6) AS log_loss, ROUND(AVG((p - y) * (p - y)), 6) AS brier,
    ROUND(AVG(CAST((p > 0.5) = (y > 0.5) AS DOUBLE)), 6) AS accuracy FROM t GROUP BY ALL"""),
)
def _panels(spark, sf_dir):
    out = S.panel_metrics(scored(spark, sf_dir), "y", "p", F.month("game_date") == 8)
    return out.select("season", "panel", "n", r6("log_loss"), r6("brier"), r6("accuracy"))
