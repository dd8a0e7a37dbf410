"""Scoring, calibration and resampling as aggregates over scored rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.functions.scalar import clip_probability, normal_cdf
from pregame.operators.order_stats import exact_quantiles

# ---- per-row losses and metrics -----------------------------------------------------------------


def per_row_loss(y: Column, p: Column, classification: bool) -> Column:
    """The term whose mean is the metric: log loss or absolute error."""
    if not classification:
        return F.abs(y - p)
    q = clip_probability(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def class_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    yy, pp = F.col(y).cast("double"), F.col(p)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(per_row_loss(yy, pp, True)).alias("log_loss"),
        F.avg((pp - yy) * (pp - yy)).alias("brier"),
        F.avg(((pp > 0.5) == (yy > 0.5)).cast("double")).alias("accuracy"),
    )


def value_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def _slot(p: Column, slots: int) -> Column:
    return F.least(F.floor(p * slots), F.lit(slots - 1)).cast("int")


def auc(df: DataFrame, y: str, p: str, slots: int = 4096) -> DataFrame:
    """Exact ROC-AUC of probabilities in [0, 1].

    Rows become counts per distinct probability, probabilities fall into ordered slots, and the
    counts below a probability are those of earlier slots plus the earlier ones of its own slot. So
    neither a repeated probability nor the whole ranking is ever in one task.
    """
    per = df.groupBy(F.col(p).alias("_p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg")
    ).withColumn("_s", _slot(F.col("_p"), slots))
    slot = per.groupBy("_s").agg(F.sum("neg").alias("_neg"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most `slots` rows
    base = slot.select("_s", F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    j = per.withColumn("_below", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(base, "_s")
    wins = F.col("pos") * (F.col("_base") + F.col("_below") + F.col("neg") * 0.5)
    return j.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (F.sum(wins) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"),
    )


def inversions(df: DataFrame, raw: str, cal: str, slots: int = 4096, tol: float = 1e-12) -> DataFrame:
    """Neighbours in order of ``raw`` whose calibrated value falls. Equal raw values count as one.

    Ordered in slots; each slot also looks at the last value of the slot before it.
    """
    points = df.select(F.col(raw).alias("_r"), F.col(cal).alias("_c")).distinct().withColumn("_s", _slot(F.col("_r"), slots))
    w = Window.partitionBy("_s").orderBy("_r", "_c")
    inside = points.withColumn("_d", F.col("_c") - F.lag("_c").over(w)).agg(
        F.count_if(F.col("_d") < -tol).alias("n_in"), F.count(F.lit(1)).alias("points")
    )
    ends = points.groupBy("_s").agg(
        F.min_by("_c", F.struct("_r", "_c")).alias("_first"), F.max_by("_c", F.struct("_r", "_c")).alias("_last")
    )
    across = ends.withColumn("_d", F.col("_first") - F.lag("_last").over(Window.orderBy("_s"))).agg(
        F.count_if(F.col("_d") < -tol).alias("n_across")
    )
    # two one-row aggregates
    return inside.crossJoin(F.broadcast(across)).select("points", (F.col("n_in") + F.col("n_across")).alias("inversions"))


# ---- calibration --------------------------------------------------------------------------------


def uniform_edges(n: int) -> list[float]:
    return [i * (1.0 / n) for i in range(n + 1)]


def calibration_bins(
    df: DataFrame, y: str, p: str, n: int = 10, strategy: str = "uniform", closed: str = "right", keep_empty: bool = False
) -> DataFrame:
    """Reliability table: bin, lower, upper, rows, mean prediction, observed rate.

    ``right``: bins (lo, hi], a prediction of 0 in the first. ``left``: bins [lo, hi), 1 in the last.
    Quantile edges are exact, end at 0 and 1, and equal edges are merged.
    """
    yy = F.col(y).cast("double")
    if strategy == "uniform":
        edges = uniform_edges(n)
        ready = df.withColumn("_edges", F.array(*[F.lit(e) for e in edges]))
    else:
        inner = exact_quantiles(df, {p: [i / n for i in range(1, n)]})[p]
        edges = sorted({0.0, 1.0, *[e for e in inner if e is not None]})
        ready = df.withColumn("_edges", F.array(*[F.lit(e) for e in edges]))
    hit = (lambda e: e < F.col(p)) if closed == "right" else (lambda e: e <= F.col(p))
    inner_edges = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    index = F.aggregate(inner_edges, F.lit(0), lambda acc, e: acc + F.when(hit(e), 1).otherwise(0))
    out = (
        ready.withColumn("bin", index)
        .groupBy("bin", F.get("_edges", index).alias("lower"), F.get("_edges", index + 1).alias("upper"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(yy).alias("observed"))
    )
    if not keep_empty:
        return out
    if strategy != "uniform":
        raise ValueError("empty bins are kept for uniform edges only")
    edges = uniform_edges(n)
    all_bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper")) for i in range(n)])
    frame = out.agg(F.count(F.lit(1)).alias("_c")).select(F.explode(all_bins).alias("b")).select("b.*")
    filled = out.select("bin", "n", "mean_predicted", "observed")
    return frame.join(filled, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(bins: DataFrame) -> DataFrame:
    """Expected and maximum calibration error, the bin that sets the maximum, thin bins (< 30 rows)."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed"))
    return bins.filter("n > 0").agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"),
        F.max(gap).alias("mce"),
        F.max_by("bin", F.struct(gap, -F.col("bin"))).alias("mce_bin"),
        F.max_by("n", F.struct(gap, -F.col("bin"))).alias("mce_bin_rows"),
        F.count_if(F.col("n") < 30).alias("thin_bins"),
    )


def brier_decomposition(df: DataFrame, y: str, p: str, n: int = 10, strategy: str = "uniform") -> DataFrame:
    """Reliability, resolution, uncertainty, binned and raw Brier score."""
    b = calibration_bins(df, y, p, n, strategy)
    yy = F.col(y).cast("double")
    raw = df.agg(F.avg(yy).alias("base_rate"), F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier_raw"))
    j = b.crossJoin(F.broadcast(raw))  # one row
    gap = F.col("mean_predicted") - F.col("observed")
    dev = F.col("observed") - F.col("base_rate")
    total = F.sum("n")
    out = j.agg(
        (F.sum(F.col("n") * gap * gap) / total).alias("reliability"),
        (F.sum(F.col("n") * dev * dev) / total).alias("resolution"),
        F.first(F.col("base_rate") * (1 - F.col("base_rate"))).alias("uncertainty"),
        (F.sum(F.col("n") * (gap * gap + F.col("observed") * (1 - F.col("observed")))) / total).alias("brier_binned"),
        F.first("brier_raw").alias("brier_raw"),
    )
    return out.withColumn("within_bin_gap", F.col("brier_raw") - F.col("brier_binned"))


# ---- resampling ---------------------------------------------------------------------------------

PRIME = 2147483647
# Distribution function of the Poisson law with mean 1.
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217,
]


def with_uniform(df: DataFrame, row_id: Column, draw: str, seed: int, out: str) -> DataFrame:
    """``out``: a number in [0, 1) fixed by (row, draw, seed), from integer arithmetic any SQL engine repeats.

    Recomputing a lost task gives the same draws, so results never depend on retries or partitioning. Each
    squaring is a column of its own: as one expression every square would double the generated code.
    """
    d = F.col(draw).cast("bigint")
    return (
        df.withColumn("_row", F.pmod(row_id.cast("bigint"), F.lit(PRIME)))
        .withColumn("_a", (F.col("_row") * 48271 + d * 40692 + F.lit(seed * 69621)) % PRIME)
        .withColumn("_b", (F.col("_a") * F.col("_a") + d) % PRIME)
        .withColumn(out, ((F.col("_b") * F.col("_b") + F.col("_row")) % PRIME) / F.lit(float(PRIME)))
        .drop("_row", "_a", "_b")
    )


def stable_id(*cols: str) -> Column:
    """A row id from text keys: the first 32 bits of an MD5, the same in any engine."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def poisson_weight(u: Column) -> Column:
    out: Column = F.lit(0)
    for cut in POISSON_CDF:
        out = out + (u >= cut).cast("int")
    return out


def _draws(df: DataFrame, draws: int, seed: int, row_id: Column | None = None) -> DataFrame:
    """Rows times draws with a Poisson(1) weight ``w``. A weight of 0 adds nothing to the sums it enters.

    Rows are not filtered on the weight: the filter would be pushed below it and repeat its expression.
    """
    d = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = with_uniform(d, F.col("row_id") if row_id is None else row_id, "draw", seed, "_u")
    return d.withColumn("w", poisson_weight(F.col("_u"))).drop("_u")


def _interval(per_draw: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return per_draw.agg(q.alias("_q"), F.count(F.lit(1)).alias("draws"), F.stddev_samp(value).alias("sd")).select(
        F.element_at("_q", 1).alias("lo"), F.element_at("_q", 2).alias("hi"), "sd", "draws"
    )


def bootstrap_mean(df: DataFrame, x: str, draws: int, seed: int) -> DataFrame:
    """Mean of ``x`` and its 95 % interval. ``df`` has a stable ``row_id``.

    Weighted sums per draw combine map-side: the shuffle carries one row per draw and partition.
    """
    per = _draws(df.select("row_id", x), draws, seed).groupBy("draw").agg(
        (F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias("m")
    )
    mean = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
    return mean.crossJoin(F.broadcast(_interval(per, "m")))  # one row each


def paired_bootstrap(losses: DataFrame, model: str, baseline: str, draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of mean(model) - mean(baseline); one draw weights both losses of a row."""
    d = losses.withColumn("_d", F.col(model) - F.col(baseline))
    out = bootstrap_mean(d.select("row_id", "_d"), "_d", draws, seed).withColumnRenamed("mean", "difference")
    return out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def needs_redraw(interval: DataFrame, trigger: float) -> DataFrame:
    """An interval that excludes zero by less than ``trigger`` deserves other seeds."""
    near = F.least(F.abs("lo"), F.abs("hi"))
    return interval.withColumn("redraw", F.col("excludes_zero") & (near < trigger))


def redrawn_intervals(losses: DataFrame, model: str, baseline: str, draws: int, seeds: list[int]) -> DataFrame:
    """The same interval under each seed, in one job: the seed is one more group key."""
    d = losses.select("row_id", (F.col(model) - F.col(baseline)).alias("_d"))
    d = d.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    # The seed enters through the row id, which the hash mixes non-linearly.
    weighted = _draws(d, draws, 7, F.col("row_id") + F.col("seed") * 1000003)
    per = weighted.groupBy("seed", "draw").agg((F.sum(F.col("w") * F.col("_d")) / F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return per.groupBy("seed").agg(q.alias("_q")).select(
        "seed", F.element_at("_q", 1).alias("lo"), F.element_at("_q", 2).alias("hi")
    ).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def bootstrap_ratio_change(losses: DataFrame, candidate: str, production: str, draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of 100 * (mean candidate / mean production - 1)."""
    per = _draws(losses.select("row_id", candidate, production), draws, seed).groupBy("draw").agg(
        (100.0 * (F.sum(F.col("w") * F.col(candidate)) / F.sum(F.col("w") * F.col(production)) - 1)).alias("m")
    )
    seen = losses.agg((100.0 * (F.avg(candidate) / F.avg(production) - 1)).alias("change_pct"))
    return seen.crossJoin(F.broadcast(_interval(per, "m")))  # one row each


def metric_interval(df: DataFrame, y: str, p: str, draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of accuracy by resampling rows."""
    hit = ((F.col(p) > 0.5) == (F.col(y) == 1)).cast("double")
    return bootstrap_mean(df.select("row_id", hit.alias("hit")), "hit", draws, seed)


def auc_interval(df: DataFrame, y: str, p: str, draws: int, seed: int = 7, slots: int = 1024) -> DataFrame:
    """95 % interval of AUC with probabilities rounded to ``slots`` ordered values.

    Per draw only (slot) weights are kept, so the rank window runs over at most ``slots`` rows a draw.
    """
    d = _draws(df.select("row_id", y, _slot(F.col(p), slots).alias("_s")), draws, seed)
    per = d.groupBy("draw", "_s").agg(
        F.sum(F.col("w") * F.col(y)).alias("pos"), F.sum(F.col("w") * (1 - F.col(y))).alias("neg")
    )
    w = Window.partitionBy("draw").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    r = per.withColumn("_b", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    a = r.groupBy("draw").agg(
        (F.sum(F.col("pos") * (F.col("_b") + F.col("neg") * 0.5)) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("m")
    )
    return _interval(a, "m")


def null_ece(df: DataFrame, p: str, draws: int, n: int = 10, seed: int = 11) -> DataFrame:
    """ECE of outcomes drawn from the predictions themselves: quantiles of the null distribution."""
    bins = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    d = df.select("row_id", F.col(p).alias("_p"), bins.alias("bin")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    )
    d = with_uniform(d, F.col("row_id"), "draw", seed, "_u")
    per = d.groupBy("draw", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_p").alias("sp"), F.sum((F.col("_u") < F.col("_p")).cast("int")).alias("sy")
    )
    e = per.groupBy("draw").agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))
    q = F.percentile("ece", F.array(F.lit(0.5), F.lit(0.95)))
    return e.agg(F.count(F.lit(1)).alias("draws"), F.avg("ece").alias("mean_ece"), q.alias("_q")).select(
        "draws", "mean_ece", F.element_at("_q", 1).alias("median_ece"), F.element_at("_q", 2).alias("p95_ece")
    )


def _binomial_two_sided(k: int, n: int) -> float:
    """2 * P(X <= k) for X ~ Bin(n, 1/2), k <= n/2, at most 1; terms are added from the largest down."""
    if n == 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total, ratio, i = 0.0, 1.0, k
    while ratio > 1e-18 and i >= 0:
        total += ratio
        ratio *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2.0 * math.exp(log_term) * total)


@F.pandas_udf(T.DoubleType())
def _mcnemar_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_binomial_two_sided(int(a), int(b)) for a, b in zip(k, n)])


def mcnemar(df: DataFrame, y: str, p_a: str, p_b: str) -> DataFrame:
    """Rows only one predictor gets right, and the exact two-sided p-value (computed on one row)."""
    a = (F.col(p_a) > 0.5) == (F.col(y) == 1)
    b = (F.col(p_b) > 0.5) == (F.col(y) == 1)
    c = df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    k, n = F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")
    return c.withColumn("p_value", _mcnemar_p(k, n))


# ---- margin to probability ----------------------------------------------------------------------


def sigma_grid(lo: float = 1.0, hi: float = 60.0, steps: int = 60) -> list[float]:
    return [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]


def fit_sigma(df: DataFrame, margin: str, y: str, grid: list[float]) -> DataFrame:
    """The sigma of least log loss of normal_cdf(margin / sigma) on the given rows.

    The grid is exploded from a literal and summed map-side; refine by calling again around the answer.
    """
    d = df.select(margin, F.col(y).cast("double").alias("_y"), F.explode(F.array(*[F.lit(s) for s in grid])).alias("sigma"))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), normal_cdf(F.col(margin) / F.col("sigma"))))
    loss = -(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))
    per = d.groupBy("sigma").agg(F.avg(loss).alias("log_loss"))
    return per.agg(F.min(F.struct("log_loss", "sigma")).alias("b")).select("b.sigma", "b.log_loss")


def margin_to_prob(df: DataFrame, margin: str, sigma: Column) -> Column:
    return normal_cdf(F.col(margin) / sigma)


def heteroscedastic_sigma(train: DataFrame, total: str, resid: str) -> DataFrame:
    """One row (a, b): sigma = max(1, (a + b * total) * sqrt(pi / 2)) from the mean absolute residual."""
    return train.agg(
        F.regr_intercept(F.abs(resid), F.col(total)).alias("a"),
        F.regr_slope(F.abs(resid), F.col(total)).alias("b"),
        F.corr(F.col(total), F.abs(resid)).alias("r"),
    )


def empirical_prob(df: DataFrame, margin: str, pool: DataFrame, resid: str, slot_width: float = 1.0) -> DataFrame:
    """1 - F(-margin) with F the empirical distribution of the residual pool.

    Residuals become counts per distinct value, values fall into ordered slots of ``slot_width``; the
    count at or below a query is that of earlier slots plus the earlier values of its own slot. One
    window over slots, one window inside slots.
    """
    vals = pool.groupBy(F.col(resid).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    asks = df.select((-F.col(margin)).alias("_v")).distinct().withColumn("_ask", F.lit(1))
    both = vals.join(asks, "_v", "full").withColumn("_s", F.floor(F.col("_v") / slot_width))
    slots = both.groupBy("_s").agg(F.sum(F.coalesce("_c", F.lit(0))).alias("_n"))
    base = slots.select(
        "_s",
        F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    inner = Window.partitionBy("_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    total = pool.agg(F.count(F.lit(1)).alias("_total"))
    cdf = (
        both.withColumn("_in", F.coalesce(F.sum(F.coalesce("_c", F.lit(0))).over(inner), F.lit(0)))
        .join(base, "_s")
        .filter("_ask = 1")
        .crossJoin(F.broadcast(total))  # one row
        .select("_v", ((F.col("_base") + F.col("_in")) / F.col("_total")).alias("_cdf"))
    )
    out = df.join(cdf, -F.col(margin) == F.col("_v"), "left")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 - F.col("_cdf")))
    return out.withColumn("empirical_p", p).drop("_v", "_cdf")


# ---- panels -------------------------------------------------------------------------------------


def completed_seasons(df: DataFrame, season: str = "season", share: float = 0.8) -> DataFrame:
    """Seasons with at least ``share`` of the median season's games."""
    n = df.groupBy(season).agg(F.count(F.lit(1)).alias("games"))
    med = n.agg(F.percentile("games", F.lit(0.5)).alias("_m"))
    return n.crossJoin(F.broadcast(med)).filter(F.col("games") >= share * F.col("_m")).drop("_m")  # one row


def panel_metrics(df: DataFrame, y: str, p: str, early: Column) -> DataFrame:
    """Metrics per completed season, early panel beside the whole."""
    seasons = completed_seasons(df).select("season")
    tagged = df.join(seasons, "season").withColumn(
        "panel", F.explode(F.when(early, F.array(F.lit("all"), F.lit("early"))).otherwise(F.array(F.lit("all"))))
    )
    return class_metrics(tagged, y, p, ["season", "panel"])

