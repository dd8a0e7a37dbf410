"""Model fitting, selection and promotion on Spark ML and SQL aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalar import log_odds
from pregame.operators.order_stats import exact_quantiles
from pregame.operators.stats import bootstrap_mean, bootstrap_ratio_change, per_row_loss
from pregame.session import cut_lineage, set_checkpoints

# ---- preparation --------------------------------------------------------------------------------


def fit_scaler(train: DataFrame, cols: list[str]):
    """Standardisation fitted on the given rows only (sample deviation)."""
    stages = [
        VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]
    return Pipeline(stages=stages).fit(train.dropna(subset=cols))


def scaling_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """The fitted means and deviations as rows, from one aggregate."""
    one = train.dropna(subset=cols).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd")) for c in cols]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def impute_median(df: DataFrame, train: DataFrame, cols: list[str], indicators: bool = False) -> DataFrame:
    """NULLs replaced by the training median (exact), optionally with 0/1 indicators."""
    medians = exact_quantiles(train, {c: [0.5] for c in cols})
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols}) if indicators else df
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0]).cast("double")) for c in cols})


def _features(cols: list[str], impute: bool, scale: bool) -> list:
    stages: list = []
    names = cols
    if impute:
        names = [f"_i_{c}" for c in cols]
        stages.append(Imputer(strategy="median", inputCols=cols, outputCols=names, relativeError=1e-4))
    stages.append(VectorAssembler(inputCols=names, outputCol="_raw" if scale else "features", handleInvalid="error"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return stages


def fit_linear(train: DataFrame, cols: list[str], y: str, reg: float = 0.0, impute: bool = False) -> PipelineModel:
    """Least squares, or ridge with ``reg``."""
    model = LinearRegression(featuresCol="features", labelCol=y, regParam=reg, elasticNetParam=0.0)
    rows = train.dropna(subset=[y] if impute else [*cols, y])
    return Pipeline(stages=[*_features(cols, impute, True), model]).fit(rows)


def fit_logistic(train: DataFrame, cols: list[str], y: str, c: float | None = None, impute: bool = False) -> PipelineModel:
    """Logistic regression; ``c`` is the inverse penalty of the summed loss (None: no penalty)."""
    rows = train.dropna(subset=[y] if impute else [*cols, y])
    reg = 0.0 if c is None else 1.0 / (c * max(rows.count(), 1))
    model = LogisticRegression(featuresCol="features", labelCol=y, regParam=reg, standardization=False, maxIter=200, tol=1e-9)
    return Pipeline(stages=[*_features(cols, impute, True), model]).fit(rows)


def fit_gbt(
    train: DataFrame, cols: list[str], y: str, classification: bool, depth: int = 3, trees: int = 20, step: float = 0.1,
    early_stop: str | None = None, patience: int = 50, seed: int = 7,
) -> PipelineModel:
    """Boosted trees after median imputation; ``early_stop`` names a boolean column of stopping rows.

    Stopping rows are not fitted. The model ends at their lowest loss before ``patience`` trees in a row brought no lower one; ``trees``
    is the most. A shorter fit is the beginning of a longer one, so fits grow until that point lies inside.
    """
    kind = GBTClassifier if classification else GBTRegressor
    model = kind(featuresCol="features", labelCol=y, maxDepth=depth, maxIter=trees, stepSize=step, seed=seed)
    known = train.dropna(subset=[y])
    if not early_stop:
        return Pipeline(stages=[*_features(cols, True, False), model]).fit(known)
    set_checkpoints(train.sparkSession)  # a tree's residuals hang on all trees before it
    ready = Pipeline(stages=_features(cols, True, False)).fit(known)
    fitted, held = ready.transform(known.filter(~F.col(early_stop))), known.filter(F.col(early_stop))
    n = min(trees, patience + 1)
    while True:
        last = model.copy({model.maxIter: n}).fit(fitted)
        count = stopping_point(staged_losses(PipelineModel([*ready.stages, last]), held, classification), patience)
        if count + patience <= n or n == trees:
            break
        n = min(trees, count + max(3 * count, patience))
    if count < n:
        last = model.copy({model.maxIter: count}).fit(fitted)
    return PipelineModel([*ready.stages, last])


def staged_losses(model: PipelineModel, rows: DataFrame, classification: bool) -> list[float]:
    """Mean loss on ``rows`` of every prefix of the ensemble, from one pass over them."""
    ready = PipelineModel(model.stages[:-1]).transform(rows)
    last = model.stages[-1]
    return list(last.evaluateEachIteration(ready) if classification else last.evaluateEachIteration(ready, "squared"))


def stopping_point(losses: list[float], patience: int) -> int:
    """Number of trees at the lowest loss seen before ``patience`` trees in a row brought no lower one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def fit_refit_gbt(
    rows: DataFrame, held: str, cols: list[str], y: str, classification: bool, depth: int = 3, trees: int = 200, step: float = 0.1, patience: int = 20, seed: int = 7,
) -> tuple[PipelineModel, int]:
    """Boosted trees with the number of trees that early stopping found, refitted on all rows.

    A probe is fitted on the rows that are not ``held`` (a boolean expression); its prefixes are scored on the held ones. The model
    returned is of the same kind, with that many trees, on held rows too.
    """
    known = rows.dropna(subset=[y]).withColumn("_held", F.coalesce(F.expr(held), F.lit(False)))
    probe = fit_gbt(known.filter("NOT _held"), cols, y, classification, depth, trees, step, seed=seed)
    count = stopping_point(staged_losses(probe, known.filter("_held"), classification), patience)
    return fit_gbt(known, cols, y, classification, depth, count, step, seed=seed), count


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction_value") -> DataFrame:
    """Probability of the positive class, or the predicted value."""
    scored = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*df.columns, value.alias(out))


# ---- calibration --------------------------------------------------------------------------------


def fit_platt(df: DataFrame, p: str, y: str, c: float = 1.0) -> PipelineModel:
    """Logistic regression on the log-odds of the raw probability."""
    rows = df.select(log_odds(F.col(p)).alias("_logit"), F.col(y).cast("double").alias("_y"))
    assembler = VectorAssembler(inputCols=["_logit"], outputCol="features")
    reg = 1.0 / (c * max(rows.count(), 1))
    lr = LogisticRegression(labelCol="_y", regParam=reg, standardization=False, maxIter=500, tol=1e-10)
    return Pipeline(stages=[assembler, lr]).fit(rows)


def apply_platt(model: PipelineModel, df: DataFrame, p: str, out: str = "calibrated") -> DataFrame:
    scored = model.transform(df.withColumn("_logit", log_odds(F.col(p))))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def _violators(block: pd.DataFrame) -> pd.DataFrame:
    """Pools adjacent violators of one block; rows are pools (lo, hi, total, weight) in order."""
    block = block.sort_values("lo")
    out: list[list[float]] = []
    for lo, hi, total, weight in block[["lo", "hi", "total", "weight"]].itertuples(index=False):
        out.append([lo, hi, total, weight])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1][1:] = [last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return pd.DataFrame(out, columns=["lo", "hi", "total", "weight"]).assign(block=block["block"].iloc[0])


_POOLS = "lo double, hi double, total double, weight double, block int"


def _block_of(x: Column, bounds: list[float]) -> Column:
    """Number of sorted bounds at or below the value."""
    if not bounds:
        return F.lit(0)
    held = np.array(bounds)

    @F.pandas_udf("int")
    def block(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, v.to_numpy(), side="right").astype("int32"))

    return block(x)


@dataclass
class Isotonic:
    """Pools of an isotonic fit (lo, hi, value, next_lo, next_value, block) and the bounds of its blocks."""

    pools: DataFrame
    bounds: list[float]


def fit_isotonic(df: DataFrame, p: str, y: str, block_rows: int = 100_000) -> Isotonic:
    """Monotone step function by pooling adjacent violators in blocks.

    Rows are first merged per probability. Each round pools the violators inside blocks of consecutive pools; then the blocks are
    shifted by half, so that what met at a border meets inside, until no two pools at a border violate. Pools of pools are the
    pools of all rows, so the result does not depend on the blocks. The driver holds three values per block.
    """
    points = df.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("_y")).dropna().groupBy("lo").agg(
        F.sum("_y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    pools = cut_lineage(points.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    n = pools.count()
    blocks = max(1, math.ceil(n / block_rows))
    bounds = sorted({b for b in exact_quantiles(pools, {"lo": [k / blocks for k in range(1, blocks)]})["lo"] if b is not None}) if blocks > 1 else []
    while True:
        pools = cut_lineage(pools.withColumn("block", _block_of(F.col("lo"), bounds)).groupBy("block").applyInPandas(_violators, _POOLS))
        pool = F.struct("lo", "hi", "total", "weight")
        ends = pools.groupBy("block").agg(F.min(pool).alias("first"), F.max(pool).alias("last"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()
        if all(a.last.total * b.first.weight <= b.first.total * a.last.weight for a, b in zip(ends, ends[1:], strict=False)):
            break
        # a block of one pool joins the one before, else its border would stay a border
        middles = _middles(pools)
        bounds = [middles[r.block] for r in ends if r.n > 1]
    nxt = {a.block: (b.first.lo, b.first.total / b.first.weight) for a, b in zip(ends, ends[1:], strict=False)}
    w = Window.partitionBy("block").orderBy("lo")
    value = F.col("total") / F.col("weight")
    out = pools.select("block", "lo", "hi", value.alias("value"))
    after = df.sparkSession.createDataFrame([(k, *v) for k, v in nxt.items()], "block int, _lo double, _value double")
    out = out.join(F.broadcast(after), "block", "left").select(  # a row per block
        "block", "lo", "hi", "value", F.coalesce(F.lead("lo").over(w), "_lo").alias("next_lo"), F.coalesce(F.lead("value").over(w), "_value").alias("next_value")
    )
    return Isotonic(cut_lineage(out), bounds)


def _middles(pools: DataFrame) -> dict[int, float]:
    """``lo`` of the middle pool of each block."""
    w = Window.partitionBy("block")
    at = F.row_number().over(w.orderBy("lo"))
    placed = pools.select("block", "lo", at.alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    return {r.block: r.lo for r in placed.filter(F.col("at") == F.floor(F.col("n") / 2) + 1).collect()}


def apply_isotonic(model: Isotonic, df: DataFrame, p: str, out: str = "calibrated", eps: float = 1e-6) -> DataFrame:
    """Value of the pool around each probability; between two pools the line from one to the other, beyond the ends their values.

    Each distinct probability is looked up once, in its block and the pool before the block. A null probability stays null.
    """
    pool = F.struct("lo", "hi", "value", "next_lo", "next_value")
    edges = model.pools.groupBy("block").agg(F.min(pool).alias("first"), F.max(pool).alias("last")).orderBy("block").collect()
    entry = [(k, *max((r.last for r in edges if r.block < k), default=edges[0].first, key=lambda x: x.lo)) for k in range(len(model.bounds) + 1)] if edges else []
    entry = df.sparkSession.createDataFrame(entry, "block int, lo double, hi double, value double, next_lo double, next_value double")
    held = model.pools.unionByName(entry)
    points = df.select(F.col(p).cast("double").alias("lo")).dropna().distinct().withColumn("block", _block_of(F.col("lo"), model.bounds))
    seen = held.select("block", F.col("lo").alias("at"), F.struct(*held.columns).alias("pool"), F.lit(0).alias("asked")).unionByName(
        points.select("block", F.col("lo").alias("at"), F.lit(None).cast(held.select(F.struct(*held.columns).alias("s")).schema["s"].dataType).alias("pool"), F.lit(1).alias("asked"))
    )
    # the pool with the greatest lo at or below the value; the entry pool stands first in its block
    w = Window.partitionBy("block").orderBy("at", "asked")
    found = seen.withColumn("pool", F.last("pool", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("asked = 1").select("at", "block", "pool.*")
    found = found.drop("block")
    line = F.col("value") + (F.col("next_value") - F.col("value")) * (F.col("at") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    value = F.when((F.col("at") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("value")).otherwise(line)
    first = edges[0].first.value if edges else None
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce(value, F.lit(first).cast("double"))))
    looked = found.select(F.col("at").alias("_at"), clipped.alias(out))
    return df.join(looked, F.col(p).cast("double") == F.col("_at"), "left").select(*[df[c] for c in df.columns], out)


# ---- baselines ----------------------------------------------------------------------------------


def naive_prediction(gm: DataFrame, train: str, y: str, stat: str) -> DataFrame:
    """No-skill prediction from the training rows: ``rate``/``mean`` or ``median`` of ``y``. One row joined."""
    if stat == "median":
        return gm.withColumn("naive", F.lit(exact_quantiles(gm.filter(train), {y: [0.5]})[y][0]).cast("double"))
    one = gm.filter(train).agg(F.avg(F.col(y).cast("double")).alias("naive"))
    return gm.crossJoin(F.broadcast(one))


def rolling_naive(gm: DataFrame, home: str, away: str, how: str, out: str = "naive") -> DataFrame:
    """The teams' own trailing averages, differenced or added."""
    return gm.withColumn(out, F.col(home) - F.col(away) if how == "difference" else F.col(home) + F.col(away))


# ---- folds and selection ------------------------------------------------------------------------


def walk_forward(gm: DataFrame, folds: list[int], span: int | None = None, season: str = "season") -> DataFrame:
    """Rows once per fold they serve: earlier seasons (within ``span``) train, the fold's season validates."""
    f = gm.select("*", F.explode(F.array(*[F.lit(v) for v in folds])).alias("fold"))
    s = F.col(season)
    inside = s <= F.col("fold")
    if span is not None:
        inside = inside & (s >= F.col("fold") - span)
    return f.filter(inside).withColumn("fold_role", F.when(s == F.col("fold"), "validation").otherwise("train"))


def refuse_seasons(df: DataFrame, refused: list[int], season: str = "season") -> DataFrame:
    """Fitting rows, refused while they are read when one is of a refused season."""
    guard = F.when(F.col(season).isin(refused), F.raise_error(F.lit("fitting on a held-out season"))).otherwise(F.col(season))
    return df.withColumn(season, guard)


def candidate_table(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation over folds per candidate."""
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"),
        F.stddev_pop("score").alias("sd_pop"),
    )


def select_with_ties(scores: DataFrame) -> DataFrame:
    """Candidates nothing beats, ranked by fewer features, linear before trees, no window, then mean.

    scores: candidate, fold, score (lower is better), n_features, family, uses_window. A candidate beats
    another when its mean paired gap exceeds the deviation of the gaps over folds (any gain counts with
    one fold). The pairs are candidates squared, a table of a model search, never of data rows.
    """
    a = scores.select(F.col("candidate").alias("a"), "fold", F.col("score").alias("sa"))
    b = scores.select(F.col("candidate").alias("b"), "fold", F.col("score").alias("sb"))
    gaps = a.join(b, "fold").filter("a <> b").groupBy("a", "b").agg(
        F.avg(F.col("sa") - F.col("sb")).alias("gap"), F.stddev_samp(F.col("sa") - F.col("sb")).alias("sd"), F.count(F.lit(1)).alias("n")
    )
    beats = F.when(F.col("n") < 2, F.col("gap") < 0).otherwise(F.col("gap") < -F.col("sd"))
    beaten = gaps.filter(beats).select(F.col("b").alias("candidate")).distinct().withColumn("beaten", F.lit(True))
    meta = scores.groupBy("candidate").agg(
        F.avg("score").alias("mean"), F.first("n_features").alias("n_features"), F.first("family").alias("family"),
        F.first("uses_window").alias("uses_window"),
    )
    pool = meta.join(beaten, "candidate", "left").withColumn("beaten", F.coalesce("beaten", F.lit(False)))
    order = F.struct(
        F.col("beaten"), "n_features", (F.col("family") != "linear").alias("f"), "uses_window", "mean", "candidate"
    )
    best = pool.agg(F.min_by("candidate", order).alias("_best"))
    status = F.when(F.col("beaten"), "beaten").when(F.col("candidate") == F.col("_best"), "selected").otherwise("tied")
    return pool.crossJoin(F.broadcast(best)).withColumn("status", status).drop("_best")  # one row


def cheaper_window(selected: DataFrame, table: DataFrame, dear: str, cheap: str) -> DataFrame:
    """A tied choice on a dear window is shipped as its cheaper twin of the same family.

    selected: target, family, window. table: target, family, window, mean. A missing twin is fatal.
    """
    twin = F.regexp_replace("window", f"^{dear}", cheap)
    s = selected.withColumn("shipped", F.when(F.col("window").startswith(dear), twin).otherwise(F.col("window")))
    t = table.select("target", "family", F.col("window").alias("shipped"), F.col("mean").alias("shipped_mean"))
    out = s.join(t, ["target", "family", "shipped"], "left")
    guard = F.when(F.col("shipped_mean").isNull(), F.raise_error(F.lit("no score for the cheaper window"))).otherwise(
        F.col("shipped_mean")
    )
    return out.withColumn("shipped_mean", guard)


@dataclass(frozen=True)
class Arm:
    name: str
    features: list[str]


def ablation(
    gm: DataFrame, arms: list[Arm], y: str, train: str, test: str,
    fit: Callable[[DataFrame, list[str], str], PipelineModel], classification: bool,
) -> DataFrame:
    """Each arm fitted and scored on identical rows: those every arm can use. One row per arm."""
    from pregame.operators.sets import union_all

    need = sorted({c for a in arms for c in a.features} | {y})
    rows = gm.dropna(subset=need)
    parts = []
    for arm in arms:
        model = fit(rows.filter(train), arm.features, y)
        scored = predict(model, rows.filter(test))
        loss = per_row_loss(F.col(y).cast("double"), F.col("prediction_value"), classification)
        parts.append(scored.agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss")).withColumn("arm", F.lit(arm.name)))
    return union_all(parts)


def tune(
    df: DataFrame, grid: list[dict], fit: Callable[[DataFrame, dict], PipelineModel], y: str, train: str, validation: str,
    classification: bool,
) -> DataFrame:
    """Validation loss per parameter set and the first best in grid order. The split is by time, never random."""
    from pregame.operators.sets import union_all

    parts = []
    for i, params in enumerate(grid):
        model = fit(df.filter(train), params)
        loss = per_row_loss(F.col(y).cast("double"), F.col("prediction_value"), classification)
        row = predict(model, df.filter(validation)).agg(F.avg(loss).alias("loss"))
        parts.append(row.withColumns({"cell": F.lit(i), "params": F.lit(str(params))}))
    scores = union_all(parts)
    best = scores.agg(F.min(F.struct("loss", "cell")).alias("b"))
    return scores.crossJoin(F.broadcast(best)).withColumn("best", F.col("cell") == F.col("b.cell")).drop("b")  # one row


# ---- incomplete rows ----------------------------------------------------------------------------


def policy_panels(scored: DataFrame, complete: str, y: str, p: str) -> DataFrame:
    """Policies for incomplete rows on the common and the refused panel, with coverage.

    scored: policy, row_id, ``complete`` (by the refusing policy), y, p (NULL where a policy refuses).
    """
    loss = per_row_loss(F.col(y).cast("double"), F.col(p), True)
    answered = F.col(p).isNotNull()
    panel = F.when(F.col(complete), "common").otherwise("refused")
    return scored.groupBy("policy", panel.alias("panel")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(answered).alias("answered"),
        F.avg(F.when(answered, loss)).alias("log_loss"),
        F.avg(F.when(answered, ((F.col(p) > 0.5) == (F.col(y) == 1)).cast("double"))).alias("accuracy"),
    )


# ---- routing and promotion ----------------------------------------------------------------------


def route_predict(df: DataFrame, linear: PipelineModel, trees: PipelineModel, out: str = "prediction_value") -> DataFrame:
    """Complete rows by the linear model, the others by the trees (column ``route``)."""
    a = predict(linear, df.filter(F.col("route") == "linear"), out)
    b = predict(trees, df.filter(F.col("route") != "linear"), out)
    return a.unionByName(b)


def score_later_games(scored: DataFrame, after, y: str, p: str, naive: str, classification: bool) -> DataFrame:
    """A frozen model on games dated after its fit, beside the no-skill prediction."""
    yy = F.col(y).cast("double")
    return scored.filter(F.col("game_date") > F.lit(after)).agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(per_row_loss(yy, F.col(p), classification)).alias("model_loss"),
        F.avg(per_row_loss(yy, F.col(naive), classification)).alias("naive_loss"),
    )


def promotion_gate(losses: DataFrame, tolerance_pct: float, draws: int = 200, seed: int = 7, fraction: float = 0.5) -> DataFrame:
    """Verdict per market from per-row losses (market, row_id, candidate, production, naive).

    Passes when the change against production is within the tolerance and, where production measurably
    beats no skill (low end of its 95 % band above 0), the candidate keeps at least ``fraction`` of that edge.
    An unknown no-skill loss is an error, not a pass.
    Markets are a handful of names; every market is its own small aggregation.
    """
    from pregame.operators.sets import union_all

    markets = [r["market"] for r in losses.select("market").distinct().orderBy("market").limit(101).collect()]
    if len(markets) > 100:
        raise ValueError("a gate judges a fixed set of markets")
    parts = []
    for m in markets:
        rows = losses.filter(F.col("market") == m)
        band = bootstrap_ratio_change(rows, "candidate", "production", draws, seed)
        edge = bootstrap_mean(rows.select("row_id", (F.col("naive") - F.col("production")).alias("e")), "e", draws, seed)
        means = rows.agg(F.avg("candidate").alias("candidate"), F.avg("production").alias("production"), F.avg("naive").alias("naive"))
        one = (  # one row each
            means.crossJoin(F.broadcast(band.select("change_pct", F.col("lo").alias("band_low"), F.col("hi").alias("band_high"))))
            .crossJoin(F.broadcast(edge.select(F.col("lo").alias("edge_low"))))
        )
        parts.append(one.withColumn("market", F.lit(m)))
    g = union_all(parts)
    gain, kept = F.col("naive") - F.col("production"), F.col("naive") - F.col("candidate")
    informative = (gain > 0) & (F.col("edge_low") > 0)
    unknown = F.col("naive").isNull() | F.isnan("naive")
    guard = (
        F.when(unknown, F.raise_error(F.concat(F.lit("no-skill loss unknown for market "), F.col("market"))).cast("boolean"))
        .when(informative, kept >= fraction * gain)
        .otherwise(True)
    )
    within = F.col("change_pct") <= tolerance_pct
    return g.withColumns({"informative": informative, "within_tolerance": within, "passed": within & guard})
