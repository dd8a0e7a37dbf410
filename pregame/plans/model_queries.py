"""Model fitting, selection and promotion on the feature table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pregame.operators import modelling as M
from pregame.operators import projections
from pregame.operators.sets import union_all
from pregame.operators.stats import per_row_loss
from pregame.plans.feature_queries import game_features
from pregame.plans.oracle import oracle
from pregame.plans.rating_queries import draws_sql
from pregame.plans.registry import query
from pregame.plans.stat_queries import ll, scored, sql
from pregame.plans.util import r6, scratch
from pregame.sources import files, views

FEATURES = ["home_roll5_pts", "away_roll5_pts", "home_roll5_opp_pts", "away_roll5_opp_pts"]
TRAIN, VALID, TEST = "season < 1998", "season = 1998", "season IN (1999, 2000)"
FIT = "season <= 1998"


def model_table(spark, sf_dir):
    """Feature table of decided games, written once so that iterative fits re-read columns, not the whole plan."""
    path = scratch(spark, "model-table")
    gm = game_features(spark, sf_dir).filter("home_win IS NOT NULL")
    files.write_table(gm.withColumn("home_win", F.col("home_win").cast("double")), path, ["season"])
    return spark.read.parquet(path)


@query(
    "scaling_table",
    "M-01",
    oracle("players", "SELECT c AS \"column\", ROUND(m, 6) AS mean, ROUND(s, 6) AS sd FROM (SELECT 'mins' AS c, AVG(mins) AS m, STDDEV_SAMP(mins) AS s FROM players WHERE season < 1998 AND mins IS NOT NULL UNION ALL SELECT 'pts', AVG(pts), STDDEV_SAMP(pts) FROM players WHERE season < 1998 AND mins IS NOT NULL)"),
)
def _scaling(spark, sf_dir):
    out = M.scaling_table(views.players(spark, sf_dir).filter(TRAIN), ["mins", "pts"])
    return out.select("column", r6("mean"), r6("sd"))


@query("standardised_features", "M-01", None)
def _scaled(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    gm = model_table(spark, sf_dir)
    model = M.fit_scaler(gm.filter(TRAIN), FEATURES)
    rows = model.transform(projections.complete_cases(gm, FEATURES))
    v = vector_to_array("features")
    return rows.select("game_id", *[r6(v[i], f"z{i}") for i in range(len(FEATURES))])


@query(
    "median_imputation",
    "M-02",
    oracle(
        "players",
        """, m AS (SELECT quantile_cont(mins, 0.5) AS m FROM players WHERE season < 1998)
        SELECT game_id, player_id, COALESCE(mins, m) AS mins, CAST(mins IS NULL AS INT) AS mins_missing FROM players, m""",
    ),
)
def _impute(spark, sf_dir):
    p = views.players(spark, sf_dir)
    out = M.impute_median(p, p.filter(TRAIN), ["mins"], indicators=True)
    return out.select("game_id", "player_id", "mins", "mins_missing")


@query(
    "linear_margin_model",
    "M-03",
    sql(""", f AS (SELECT regr_slope(margin, p) AS b, regr_intercept(margin, p) AS a FROM scored WHERE season < 1998) SELECT row_id, ROUND(a + b * p, 4) AS predicted FROM scored, f WHERE season IN (1999, 2000)"""),
)
def _linear(spark, sf_dir):
    df = scored(spark, sf_dir)
    model = M.fit_linear(df.filter(TRAIN), ["p"], "margin")
    return M.predict(model, df.filter(TEST), "predicted").select("row_id", F.round("predicted", 4).alias("predicted"))


@query("ridge_margin_model", "M-03", None)
def _ridge(spark, sf_dir):
    gm = model_table(spark, sf_dir)
    model = M.fit_linear(gm.filter(TRAIN), FEATURES, "margin", reg=1.0, impute=True)
    return M.predict(model, gm.filter(TEST), "predicted").select("game_id", F.round("predicted", 3).alias("predicted"))


@query("logistic_winner_model", "M-04", None)
def _logistic(spark, sf_dir):
    gm = model_table(spark, sf_dir)
    model = M.fit_logistic(gm.filter(TRAIN), FEATURES, "home_win", c=1.0, impute=True)
    return M.predict(model, gm.filter(TEST), "p_home").select("game_id", F.round("p_home", 4).alias("p_home"))


@query("boosted_winner_model", "M-05", None)
def _gbt(spark, sf_dir):
    gm = model_table(spark, sf_dir).withColumn("stop", F.expr(VALID))
    model = M.fit_gbt(gm.filter(FIT), FEATURES, "home_win", True, depth=4, trees=2000, step=0.05, early_stop="stop", patience=50)
    return M.predict(model, gm.filter(TEST), "p_home").select("game_id", F.round("p_home", 4).alias("p_home"))


@query("penalty_search", "M-06", None)
def _tune(spark, sf_dir):
    gm = projections.complete_cases(model_table(spark, sf_dir), FEATURES)
    grid = [{"reg": 0.0}, {"reg": 1.0}, {"reg": 100.0}]
    fit = lambda rows, params: M.fit_linear(rows, FEATURES, "margin", **params)
    return M.tune(gm, grid, fit, "margin", TRAIN, VALID, False).withColumn("loss", F.round("loss", 4))


@query(
    "naive_predictions",
    "M-07",
    sql(""", r AS (SELECT AVG(y) AS rate, quantile_cont(margin, 0.5) AS med FROM scored WHERE season < 1998) SELECT row_id, ROUND(rate, 6) AS rate, ROUND(med, 6) AS med FROM scored, r WHERE season IN (1999, 2000)"""),
)
def _naive(spark, sf_dir):
    df = scored(spark, sf_dir)
    a = M.naive_prediction(df, TRAIN, "y", "rate").withColumnRenamed("naive", "rate")
    b = M.naive_prediction(a, TRAIN, "margin", "median").withColumnRenamed("naive", "med")
    return b.filter(TEST).select("row_id", r6("rate"), r6("med"))


@query(
    "rolling_naive_margin",
    "M-07",
    oracle(
        "team_games",
        """, r AS (SELECT *, CASE WHEN COUNT(pts) OVER w = 5 THEN AVG(pts) OVER w END AS m FROM team_games
        WINDOW w AS (PARTITION BY league, team, season ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT game_id, ROUND(MAX(m) FILTER (is_home) - MAX(m) FILTER (NOT is_home), 6) + 0.0 AS naive FROM r GROUP BY game_id""",
    ),
)
def _rolling_naive(spark, sf_dir):
    out = M.rolling_naive(game_features(spark, sf_dir), "home_roll5_pts", "away_roll5_pts", "difference")
    return out.select("game_id", r6("naive"))


@query("routed_predictions", "M-08 P-15", None)
def _routed(spark, sf_dir):
    gm = projections.with_route(model_table(spark, sf_dir), FEATURES)
    linear = M.fit_linear(gm.filter(TRAIN), FEATURES, "margin")
    trees = M.fit_gbt(gm.filter(TRAIN), FEATURES, "margin", False, depth=2, trees=3)
    return M.route_predict(gm.filter(TEST), linear, trees).select("game_id", "route", F.round("prediction_value", 3).alias("predicted"))


@query(
    "walk_forward_folds",
    "M-09",
    oracle(
        "games",
        """SELECT fold, season, CASE WHEN season = fold THEN 'validation' ELSE 'train' END AS fold_role, COUNT(*) AS games
        FROM games, (VALUES (1998), (1999)) f(fold) WHERE season BETWEEN fold - 3 AND fold GROUP BY ALL""",
    ),
)
def _walk(spark, sf_dir):
    out = M.walk_forward(views.schedule(spark, sf_dir), [1998, 1999], span=3)
    return out.groupBy("fold", "season", "fold_role").agg(F.count(F.lit(1)).alias("games"))


FOLD_SCORES_SQL = f""", s AS (SELECT season AS fold, AVG({ll('p')}) AS a, AVG({ll('q')}) AS b, AVG({ll('0.55::DOUBLE')}) AS c, AVG({ll('(0.5 * p + 0.275::DOUBLE)')}) AS d FROM scored GROUP BY season),
    sc AS (SELECT 'difference' AS candidate, fold, a AS score, 2 AS n_features, 'linear' AS family, FALSE AS uses_window FROM s
    UNION ALL SELECT 'home', fold, b, 1, 'trees', TRUE FROM s UNION ALL SELECT 'constant', fold, c, 0, 'linear', FALSE FROM s UNION ALL SELECT 'shrunk', fold, d, 2, 'linear', TRUE FROM s)"""


def fold_scores(spark, sf_dir):
    """Log loss per season of four candidate predictors."""
    df = scored(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    candidates = [
        ("difference", F.col("p"), 2, "linear", False),
        ("home", F.col("q"), 1, "trees", True),
        ("constant", F.lit(0.55), 0, "linear", False),
        ("shrunk", 0.5 * F.col("p") + 0.275, 2, "linear", True),
    ]
    one = df.groupBy(F.col("season").alias("fold")).agg(
        *[F.avg(per_row_loss(F.col("y"), p, True)).alias(name) for name, p, *_ in candidates]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("candidate"), F.col(n).alias("score"), F.lit(k).alias("n_features"), F.lit(f).alias("family"), F.lit(w).alias("uses_window")
            )
            for n, _, k, f, w in candidates
        ]
    )
    return one.select("fold", F.explode(rows).alias("r")).select("fold", "r.*")


@query(
    "candidate_selection",
    "M-10",
    sql(f"""{FOLD_SCORES_SQL}, g AS (SELECT a.candidate AS a, b.candidate AS b, AVG(a.score - b.score) AS gap, STDDEV_SAMP(a.score - b.score) AS sd FROM sc a JOIN sc b USING (fold) WHERE a.candidate <> b.candidate GROUP BY ALL),
    bt AS (SELECT DISTINCT b AS candidate FROM g WHERE gap < -sd), m AS (SELECT candidate, AVG(score) AS mean, ANY_VALUE(n_features) AS nf, ANY_VALUE(family) AS family, ANY_VALUE(uses_window) AS uw FROM sc GROUP BY candidate),
    o AS (SELECT *, candidate IN (SELECT candidate FROM bt) AS beaten FROM m)
    SELECT candidate, ROUND(mean, 6) AS mean, CASE WHEN beaten THEN 'beaten' WHEN ROW_NUMBER() OVER (ORDER BY beaten, nf, family <> 'linear', uw, mean, candidate) = 1 THEN 'selected' ELSE 'tied' END AS status FROM o"""),
)
def _select(spark, sf_dir):
    return M.select_with_ties(fold_scores(spark, sf_dir)).select("candidate", r6("mean"), "status")


@query(
    "candidate_table",
    "M-11",
    sql(f"{FOLD_SCORES_SQL} SELECT family, candidate, COUNT(*) AS folds, ROUND(AVG(score), 6) AS mean, ROUND(STDDEV_SAMP(score), 6) AS sd, ROUND(STDDEV_POP(score), 6) AS sd_pop FROM sc GROUP BY ALL"),
)
def _table(spark, sf_dir):
    out = M.candidate_table(fold_scores(spark, sf_dir), ["family", "candidate"])
    return out.select("family", "candidate", "folds", r6("mean"), r6("sd"), r6("sd_pop"))


@query(
    "cheaper_window_choice",
    "M-10",
    sql(f"""{FOLD_SCORES_SQL} SELECT 'winner' AS target, 'linear' AS family, 'CUP5' AS "window", 'CARRY5' AS shipped, ROUND(AVG(score), 6) AS shipped_mean FROM sc WHERE candidate = 'shrunk'"""),
)
def _cheaper(spark, sf_dir):
    table = M.candidate_table(fold_scores(spark, sf_dir).filter("family = 'linear'"), ["family", "candidate"])
    window = F.when(F.col("candidate") == "shrunk", "CARRY5").when(F.col("candidate") == "difference", "CUP5").otherwise("CUP3")
    table = table.select(F.lit("winner").alias("target"), "family", window.alias("window"), "mean")
    picked = table.filter("window = 'CUP5'").select("target", "family", "window")
    return M.cheaper_window(picked, table, "CUP", "CARRY").withColumn("shipped_mean", r6("shipped_mean"))


@query(
    "incomplete_row_policies",
    "M-12 J-20",
    sql(f""", c AS (SELECT *, row_id % 7 <> 0 AS complete FROM scored WHERE season = 1998),
    s AS (SELECT 'refuse' AS policy, y, complete, CASE WHEN complete THEN p END AS p FROM c UNION ALL SELECT 'carry', y, complete, CASE WHEN row_id % 14 <> 0 THEN p END FROM c UNION ALL SELECT 'impute', y, complete, CASE WHEN complete THEN p ELSE 0.55::DOUBLE END FROM c)
    SELECT policy, CASE WHEN complete THEN 'common' ELSE 'refused' END AS panel, COUNT(*) AS rows, COUNT(p) AS answered, ROUND(AVG({ll('p')}) FILTER (p IS NOT NULL), 6) AS log_loss,
    ROUND(AVG(CAST((p > 0.5) = (y = 1) AS DOUBLE)) FILTER (p IS NOT NULL), 6) AS accuracy FROM s GROUP BY ALL"""),
)
def _policies(spark, sf_dir):
    c = scored(spark, sf_dir).filter(VALID).withColumn("complete", F.col("row_id") % 7 != 0)
    parts = [
        c.withColumns({"policy": F.lit("refuse"), "p": F.when(F.col("complete"), F.col("p"))}),
        c.withColumns({"policy": F.lit("carry"), "p": F.when(F.col("row_id") % 14 != 0, F.col("p"))}),
        c.withColumns({"policy": F.lit("impute"), "p": F.when(F.col("complete"), F.col("p")).otherwise(0.55)}),
    ]
    out = M.policy_panels(union_all(parts), "complete", "y", "p")
    return out.select("policy", "panel", "rows", "answered", r6("log_loss"), r6("accuracy"))


@query("feature_ablation", "M-13", None)
def _ablation(spark, sf_dir):
    arms = [M.Arm("form", FEATURES), M.Arm("form and rest", [*FEATURES, "home_rest_days", "away_rest_days"])]
    fit = lambda rows, cols, y: M.fit_linear(rows, cols, y)
    out = M.ablation(model_table(spark, sf_dir), arms, "margin", TRAIN, TEST, fit, False)
    return out.withColumn("loss", F.round("loss", 4))


GATE_DRAWS = 50


@query(
    "promotion_gate",
    "M-14 ST-08",
    sql(f""", lo AS (SELECT 'winner' AS market, row_id, {ll('(0.5 * p + 0.275::DOUBLE)')} AS cand, {ll('p')} AS prod, {ll('0.55::DOUBLE')} AS nv FROM scored WHERE season > 1998
    UNION ALL SELECT 'margin', row_id, ABS(margin - 40 * (q - 0.5)), ABS(margin - 5), ABS(margin) FROM scored WHERE season > 1998),
    dr AS ({draws_sql('lo', GATE_DRAWS, 7, 'market, cand, prod, nv, row_id')}),
    pr AS (SELECT market, draw, 100 * (SUM(w * cand) / SUM(w * prod) - 1) AS c, SUM(w * (nv - prod)) / SUM(w) AS e FROM dr GROUP BY ALL),
    b AS (SELECT market, quantile_cont(c, 0.025) AS band_low, quantile_cont(c, 0.975) AS band_high, quantile_cont(e, 0.025) AS edge_low FROM pr GROUP BY market),
    m AS (SELECT market, AVG(cand) AS cand, AVG(prod) AS prod, AVG(nv) AS nv FROM lo GROUP BY market)
    SELECT market, ROUND(100 * (cand / prod - 1), 4) AS change_pct, ROUND(band_low, 4) AS band_low, ROUND(band_high, 4) AS band_high, nv - prod > 0 AND edge_low > 0 AS informative,
    100 * (cand / prod - 1) <= 2 AS within_tolerance, 100 * (cand / prod - 1) <= 2 AND (NOT (nv - prod > 0 AND edge_low > 0) OR nv - cand >= 0.5 * (nv - prod)) AS passed FROM m JOIN b USING (market)"""),
)
def _gate(spark, sf_dir):
    df = scored(spark, sf_dir).filter("season > 1998").withColumn("yd", F.col("y").cast("double"))
    winner = df.select(
        F.lit("winner").alias("market"), "row_id", per_row_loss(F.col("yd"), 0.5 * F.col("p") + 0.275, True).alias("candidate"),
        per_row_loss(F.col("yd"), F.col("p"), True).alias("production"), per_row_loss(F.col("yd"), F.lit(0.55), True).alias("naive"),
    )
    margin = df.select(
        F.lit("margin").alias("market"), "row_id", F.abs(F.col("margin") - 40 * (F.col("q") - 0.5)).alias("candidate"),
        F.abs(F.col("margin") - 5).alias("production"), F.abs("margin").alias("naive"),
    )
    out = M.promotion_gate(winner.unionByName(margin), 2.0, GATE_DRAWS)
    return out.select(
        "market", *[F.round(c, 4).alias(c) for c in ("change_pct", "band_low", "band_high")], "informative", "within_tolerance", "passed"
    )


@query(
    "season_firewall",
    "M-15",
    oracle("games", "SELECT season, COUNT(*) AS games FROM games WHERE season < 1999 GROUP BY season"),
)
def _firewall(spark, sf_dir):
    rows = M.refuse_seasons(views.schedule(spark, sf_dir).filter("season < 1999"), [1999, 2000])
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "later_games_score",
    "M-17 ST-01",
    sql(f""", n AS (SELECT AVG(y) AS rate FROM scored WHERE season < 1998)
    SELECT COUNT(*) AS games, ROUND(AVG({ll('p')}), 6) AS model_loss, ROUND(AVG({ll('rate')}), 6) AS naive_loss FROM scored, n WHERE game_date > DATE '1999-07-31'"""),
)
def _later(spark, sf_dir):
    df = M.naive_prediction(scored(spark, sf_dir), TRAIN, "y", "rate")
    out = M.score_later_games(df, dt.date(1999, 7, 31), "y", "p", "naive", True)
    return out.select("games", r6("model_loss"), r6("naive_loss"))


@query("platt_calibration", "ST-06", None)
def _platt(spark, sf_dir):
    df = scored(spark, sf_dir)
    model = M.fit_platt(df.filter(TRAIN), "p", "y")
    return M.apply_platt(model, df.filter(TEST), "p").select("row_id", F.round("calibrated", 4).alias("calibrated"))


@query("isotonic_calibration", "ST-06 ST-12", None)
def _isotonic(spark, sf_dir):
    df = scored(spark, sf_dir)
    model = M.fit_isotonic(df.filter(TRAIN), "p", "y")
    return M.apply_isotonic(model, df.filter(TEST), "p").select("row_id", F.round("calibrated", 6).alias("calibrated"))




# ---- fits whose defining equations SQL can check -------------------------------------------------


@query(
    "logistic_score_equations",
    "M-04",
    sql("SELECT COUNT(*) AS n, ROUND(AVG(y), 4) AS mean_p, ROUND(AVG(p * y), 4) AS mean_xp FROM scored WHERE season < 1998"),
)
def _logistic_equations(spark, sf_dir):
    """An unpenalised fit reproduces the mean outcome and the mean of feature times outcome."""
    df = scored(spark, sf_dir).filter(TRAIN)
    out = M.predict(M.fit_logistic(df, ["p"], "y"), df, "fitted")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 4).alias("mean_p"), F.round(F.avg(F.col("p") * F.col("fitted")), 4).alias("mean_xp")
    )


@query("boosted_mean_equation", "M-05", sql("SELECT COUNT(*) AS n, ROUND(AVG(margin), 6) AS mean_fitted FROM scored WHERE season < 1998"))
def _gbt_equation(spark, sf_dir):
    """Every tree of a squared-loss fit leaves residuals of mean zero."""
    df = scored(spark, sf_dir).filter(TRAIN)
    model = M.fit_gbt(df, ["p", "q"], "margin", False, depth=2, trees=3)
    return M.predict(model, df, "fitted").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fitted"), "mean_fitted"))


STUMPS, STEP, PATIENCE, CELLS = 25, 0.3, 4, 16


def stump_ctes(name: str, where: str, trees: str) -> str:
    """Boosted stumps on the cells of p: state is the prediction per cell after each tree. A cell is a value of the only feature."""
    return f"""{name}c AS (SELECT list(n ORDER BY cell) AS n, list(s ORDER BY cell) AS s, list(cell ORDER BY cell) AS v FROM
        (SELECT cell, COUNT(*)::DOUBLE AS n, SUM(margin)::DOUBLE AS s FROM cells WHERE {where} GROUP BY cell)),
    {name}r AS (SELECT 0 AS k, list_transform(n, lambda x: 0::DOUBLE) AS f FROM {name}c
      UNION ALL SELECT k + 1, list_transform(f, lambda x, i: x + w * CASE WHEN i <= t THEN l ELSE r END) FROM
        (SELECT k, f, w, t, list_sum(g[:t]) / list_sum(n[:t]) AS l, list_sum(g[t + 1:]) / list_sum(n[t + 1:]) AS r FROM
          (SELECT *, list_position(gain, list_max(gain)) AS t FROM
            (SELECT *, list_transform(range(1, LEN(n)), lambda j: POW(list_sum(g[:j]), 2) / list_sum(n[:j]) + POW(list_sum(g[j + 1:]), 2) / list_sum(n[j + 1:])) AS gain FROM
              (SELECT k, f, n, CASE WHEN k = 0 THEN 1.0 ELSE {STEP} END::DOUBLE AS w, list_transform(s, lambda x, i: CASE WHEN k = 0 THEN 1 ELSE 2 END * (x - n[i] * f[i])) AS g
               FROM {name}r, {name}c WHERE k < {trees})))))"""


@query(
    "boosted_refit",
    "M-05",
    sql(f""", cells AS (SELECT *, FLOOR(p * {CELLS}) AS cell FROM scored),
    {stump_ctes('a', 'season < 1998', str(STUMPS))},
    loss AS (SELECT k, AVG(POW(margin - f[list_position(v, cell)], 2)) AS loss FROM cells, ar, ac WHERE season = 1998 AND k > 0 AND list_contains(v, cell) GROUP BY k),
    lows AS (SELECT k, loss, ARG_MIN(k, (loss, k)) OVER (ORDER BY k) AS best FROM loss),
    stop AS (SELECT COALESCE((SELECT best FROM lows WHERE k - best >= {PATIENCE} ORDER BY k LIMIT 1), (SELECT best FROM lows ORDER BY k DESC LIMIT 1)) AS trees),
    {stump_ctes('b', 'season <= 1998', '(SELECT trees FROM stop)')}
    SELECT row_id, CAST(trees AS INT) AS trees, ROUND(f[list_position(v, cell)], 6) AS predicted FROM cells, stop, br, bc WHERE k = trees AND season IN (1999, 2000) AND list_contains(v, cell)""", recursive=True),
)
def _refit(spark, sf_dir):
    """Stumps on one feature of few values, so every split can be checked."""
    df = scored(spark, sf_dir).withColumn("cell", F.floor(F.col("p") * CELLS).cast("double"))
    model, trees = M.fit_refit_gbt(df.filter(FIT), "season = 1998", ["cell"], "margin", False, depth=1, trees=STUMPS, step=STEP, patience=PATIENCE)
    known = df.filter(FIT).select("cell").distinct()
    out = M.predict(model, df.filter(TEST).join(known, "cell", "left_semi"), "predicted")
    return out.select("row_id", F.lit(trees).alias("trees"), r6("predicted"))


@query(
    "isotonic_values",
    "ST-06 ST-12",
    sql(""", t AS (SELECT ROUND(p, 3) AS x, SUM(y)::DOUBLE AS s, COUNT(*)::DOUBLE AS w FROM scored WHERE season < 1998 GROUP BY ALL),
    c AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) AS i, s, w, SUM(s) OVER (ORDER BY x) AS cs, SUM(w) OVER (ORDER BY x) AS cw FROM t),
    least_mean AS (SELECT a.i AS a, b.i AS b, MIN((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM c a JOIN c b ON b.i >= a.i),
    v AS (SELECT b AS i, MAX(m) AS v FROM least_mean GROUP BY b),
    k AS (SELECT x, v, LEAD(x) OVER (ORDER BY x) AS nx, LEAD(v) OVER (ORDER BY x) AS nv FROM c JOIN v USING (i)),
    q AS (SELECT row_id, ROUND(p, 4) AS p FROM scored WHERE season IN (1999, 2000))
    SELECT row_id, ROUND(GREATEST(1e-6, LEAST(1 - 1e-6, CASE WHEN k.x IS NULL THEN (SELECT ARG_MIN(v, x) FROM k) WHEN nx IS NULL THEN v ELSE v + (nv - v) * (q.p - k.x) / (nx - k.x) END)), 6) AS calibrated
    FROM q ASOF LEFT JOIN k ON q.p >= k.x"""),
)
def _isotonic_values(spark, sf_dir):
    """Every calibrated value, against the largest of the least means of the runs around it."""
    df = scored(spark, sf_dir)
    model = M.fit_isotonic(df.filter(TRAIN).withColumn("p", F.round("p", 3)), "p", "y", block_rows=50)
    return M.apply_isotonic(model, df.filter(TEST).withColumn("p", F.round("p", 4)), "p").select("row_id", r6("calibrated"))


@query("isotonic_mean_equation", "ST-06", sql("SELECT COUNT(*) AS n, ROUND(AVG(y), 5) AS mean_calibrated FROM scored WHERE season < 1998"))
def _isotonic_equation(spark, sf_dir):
    """Pooling adjacent violators keeps the weighted mean."""
    df = scored(spark, sf_dir).filter(TRAIN)
    out = M.apply_isotonic(M.fit_isotonic(df, "p", "y"), df, "p")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), 5).alias("mean_calibrated"))


_LINE_SQL = """f AS (SELECT regr_slope(margin, p) AS bp, regr_intercept(margin, p) AS ap, regr_slope(margin, q) AS bq, regr_intercept(margin, q) AS aq FROM scored WHERE season < 1998)"""


@query(
    "linear_ablation",
    "M-13",
    sql(f""", {_LINE_SQL} SELECT 'difference' AS arm, COUNT(*) AS n, ROUND(AVG(ABS(margin - ap - bp * p)), 4) AS loss FROM scored, f WHERE season IN (1999, 2000)
    UNION ALL SELECT 'home', COUNT(*), ROUND(AVG(ABS(margin - aq - bq * q)), 4) FROM scored, f WHERE season IN (1999, 2000)"""),
)
def _linear_ablation(spark, sf_dir):
    arms = [M.Arm("difference", ["p"]), M.Arm("home", ["q"])]
    out = M.ablation(scored(spark, sf_dir), arms, "margin", TRAIN, TEST, lambda rows, cols, y: M.fit_linear(rows, cols, y), False)
    return out.withColumn("loss", F.round("loss", 4))


@query(
    "feature_set_search",
    "M-06",
    sql(f""", {_LINE_SQL}, l AS (SELECT 0 AS cell, AVG(ABS(margin - ap - bp * p)) AS loss FROM scored, f WHERE season = 1998
    UNION ALL SELECT 1, AVG(ABS(margin - aq - bq * q)) FROM scored, f WHERE season = 1998)
    SELECT cell, ROUND(loss, 4) AS loss, ROW_NUMBER() OVER (ORDER BY loss, cell) = 1 AS best FROM l"""),
)
def _feature_search(spark, sf_dir):
    grid = [{"cols": ["p"]}, {"cols": ["q"]}]
    out = M.tune(scored(spark, sf_dir), grid, lambda rows, g: M.fit_linear(rows, g["cols"], "margin"), "margin", TRAIN, VALID, False)
    return out.select("cell", F.round("loss", 4).alias("loss"), "best")


@query(
    "routed_linear_rows",
    "M-08 P-15",
    sql(f""", {_LINE_SQL}, t AS (SELECT row_id, row_id % 4 = 0 AS trees, ap + bp * p AS lin FROM scored, f WHERE season IN (1999, 2000))
    SELECT row_id, CASE WHEN trees THEN 'trees' ELSE 'linear' END AS route, ROUND(CASE WHEN NOT trees THEN lin END, 4) AS predicted FROM t"""),
)
def _routed_linear(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("form", F.when(F.col("row_id") % 4 != 0, F.col("p")))
    df = projections.with_route(df, ["form"])
    linear = M.fit_linear(df.filter(TRAIN), ["p"], "margin")
    trees = M.fit_gbt(df.filter(TRAIN), ["q"], "margin", False, depth=1, trees=2)
    out = M.route_predict(df.filter(TEST), linear, trees)
    return out.select("row_id", "route", F.when(F.col("route") == "linear", F.round("prediction_value", 4)).alias("predicted"))
