"""Trailing windows, counts, records and ranks. Every frame ends before the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.operators.skew import has_hot_group, inherit, row_scope, running_last, running_sums

TIE = ["game_id"]
DAY = "game_date"


def full_mean(col: str | Column, scope, w: int) -> Column:
    """Mean of the previous ``w`` rows; NULL unless all ``w`` exist and are non-null."""
    c = F.col(col) if isinstance(col, str) else col
    frame = scope.rows(-w, -1)
    return F.when(F.count(c).over(frame) == w, F.avg(c).over(frame))


def trailing_mean(
    df: DataFrame, keys: list[str], col: str, w: int, out: str, day: str = DAY, tie: list[str] = TIE
) -> DataFrame:
    scope = row_scope(df, keys, day, tie, w)
    return scope.finish(scope.df.withColumn(out, full_mean(col, scope, w)))


def add_rolling(
    df: DataFrame,
    keys: list[str],
    metrics: list[str],
    windows: list[int],
    prefix: str = "roll",
    day: str = DAY,
    tie: list[str] = TIE,
) -> DataFrame:
    """``{prefix}{w}_{metric}`` for every window and metric: one shuffle, one sort.

    Season scope: keys hold the season. Career scope (crosses seasons): they do not.
    """
    scope = row_scope(df, keys, day, tie, max(windows))
    new = {f"{prefix}{w}_{m}": full_mean(m, scope, w) for w in windows for m in metrics}
    return scope.finish(scope.df.select("*", *[c.alias(n) for n, c in new.items()]))


def add_rolling_all_competitions(
    df: DataFrame, keys: list[str], metrics: list[str], windows: list[int], tag: str, emit: str, prefix: str = "all"
) -> DataFrame:
    """Windows over every competition, rows of one competition kept."""
    return add_rolling(df, keys, metrics, windows, prefix).filter(F.col(tag) == emit)


def trailing_appearance_mean(
    df: DataFrame, keys: list[str], played: str, metrics: list[str], w: int, day: str = DAY, tie: list[str] = TIE
) -> DataFrame:
    """Trailing mean over appearances only, carried forward over absences.

    ``played`` is the boolean appearance column. Appearances are windowed on their own (the flag is
    a window key, so one shuffle serves), then the latest value is carried within the player-season.
    """
    has_hot_group(df, keys)  # the coarser keys first: the finer ones below need no check of their own then
    scope = row_scope(df, [*keys, played], day, tie, w)
    new = [F.when(F.col(played), full_mean(m, scope, w)).alias(f"roll{w}_{m}") for m in metrics]
    rolled = scope.finish(scope.df.select("*", *new))
    # A NULL warm-up appearance must not inherit an older value; there is none older, so last() is safe.
    return running_last(rolled, keys, day, tie, [f"roll{w}_{m}" for m in metrics])


def team_window(df: DataFrame, keys: list[str], windows: list[int], prefix: str) -> DataFrame:
    """Points for, against, margin and win rate (a tie counts one half)."""
    value = F.when(F.col("pts") > F.col("opp_pts"), 1.0).when(F.col("pts") < F.col("opp_pts"), 0.0).otherwise(0.5)
    ready = df.withColumns(
        {
            "pf": F.col("pts"),
            "pa": F.col("opp_pts"),
            "margin": F.col("pts") - F.col("opp_pts"),
            "win_rate": value,
        }
    )
    out = add_rolling(inherit(ready, df), keys, ["pf", "pa", "margin", "win_rate"], windows, prefix)
    return out.drop("pf", "pa", "margin", "win_rate")


def prior_counts(df: DataFrame, career: list[str], season: str = "season") -> DataFrame:
    """Games before this one, in the career and in the season."""
    out = running_sums(df, career, DAY, TIE, {"prior_career": F.lit(1)})
    return running_sums(out, [*career, season], DAY, TIE, {"prior_season": F.lit(1)})


def expected_warmup(df: DataFrame, keys: list[str], col: str, w: int) -> DataFrame:
    """Per key: NULLs a full window must have, sum of min(w, games), beside those it has."""
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col(col).isNull()).alias("nulls"),
    )
    return per.withColumn("expected", F.least(F.col("games"), F.lit(w)))


def gap_reach(df: DataFrame, team_keys: list[str], season: str, col: str, w: int) -> DataFrame:
    """Per season: NULL windows beyond the warm-up, which only missing games can cause."""
    per = expected_warmup(df, [*team_keys, season], col, w)
    return per.groupBy(season).agg(
        F.sum("nulls").alias("nulls"),
        F.sum("expected").alias("expected"),
        (F.sum("nulls") - F.sum("expected")).alias("beyond_warmup"),
    )


def on_off(df: DataFrame, keys: list[str], margin: str, absent: str, min_on: int = 10, min_off: int = 5) -> DataFrame:
    """Mean team margin with the player minus without, earlier games only; NULL below the minimum samples."""
    played = ~F.col(absent)
    sums = {
        "_on": F.when(played, F.col(margin)).otherwise(0.0),
        "_n_on": F.when(played, 1).otherwise(0),
        "_off": F.when(F.col(absent), F.col(margin)).otherwise(0.0),
        "_n_off": F.when(F.col(absent), 1).otherwise(0),
    }
    out = running_sums(df, keys, DAY, TIE, sums)
    checked = out
    usable = (F.col("_n_on") >= min_on) & (F.col("_n_off") >= min_off)
    value = F.when(usable, F.col("_on") / F.col("_n_on") - F.col("_off") / F.col("_n_off"))
    return inherit(out.withColumn("on_off", value).drop(*sums), checked)


def absence_weights(df: DataFrame, min_minutes: float = 1.0) -> DataFrame:
    """Weight variants of an absence: minutes, PRA, PRA per minute above a floor, on/off with fallback."""
    rate = F.when(F.col("roll_mins") >= min_minutes, F.col("roll_pra") / F.col("roll_mins"))
    return df.select(
        "*",
        F.col("roll_mins").alias("w_minutes"),
        F.col("roll_pra").alias("w_pra"),
        rate.alias("w_rate"),
        F.coalesce(F.col("on_off"), rate).alias("w_on_off"),
    )


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def openers(df: DataFrame, keys: list[str], day: str = DAY, tie: list[str] = TIE) -> DataFrame:
    """First row per key. A struct minimum, so a hot key is combined map-side and never sorted."""
    order = [day, *[t for t in tie if t != day]]
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def identity_changes(df: DataFrame, key: list[str], season: str, label: str) -> DataFrame:
    """One row per team and season: previous label, whether it changed, first-season flag."""
    seasons = df.groupBy(*key, season).agg(F.min(label).alias(label))
    w = Window.partitionBy(*key).orderBy(season)
    return seasons.select(
        *key,
        season,
        label,
        F.lag(label).over(w).alias("previous"),
        F.lag(season).over(w).isNull().alias("first_season"),
        F.coalesce(F.lag(label).over(w) != F.col(label), F.lit(False)).alias("changed"),
    )


def running_record(df: DataFrame, keys: list[str], stated: dict[str, str], reanchor: bool) -> DataFrame:
    """Cumulative W-L-T beside the stated record.

    ``stated`` maps W, L and T to the stated columns (NULL where nothing is stated). With
    ``reanchor`` only a row whose gap differs from the previous stated row's gap diverges, so one
    wrong game is reported once; without it every row after the error is.
    """
    sums = {f"cum_{k.lower()}": F.when(F.col("wl") == k, 1).otherwise(0) for k in stated}
    out = running_sums(df, keys, DAY, TIE, sums, inclusive=True)
    gap = F.struct(*[(F.col(c) - F.col(f"cum_{k.lower()}")).cast("int").alias(k) for k, c in stated.items()])
    any_stated = F.coalesce(*[F.col(c) for c in stated.values()]).isNotNull()
    zero = F.struct(*[F.lit(0).cast("int").alias(k) for k in stated])
    out = out.withColumn("_gap", F.when(any_stated, gap))
    if not reanchor:
        return out.withColumn("diverges", F.coalesce(F.col("_gap") != zero, F.lit(False))).drop("_gap")
    # The previous stated gap: carry the latest non-null gap, then look one row back.
    carried = running_last(inherit(out.withColumn("_seen", F.col("_gap")), df), keys, DAY, TIE, ["_seen"])
    scope = row_scope(carried, keys, DAY, TIE, 1)
    before = F.coalesce(F.lag("_seen").over(scope.window()), zero)
    done = scope.finish(scope.df.withColumn("_before", before))
    return done.withColumn("diverges", F.coalesce(F.col("_gap") != F.col("_before"), F.lit(False))).drop(
        "_gap", "_seen", "_before"
    )


def time_tail_split(df: DataFrame, n: int | None = None, fraction: float | None = None, by: list[str] | None = None) -> DataFrame:
    """``is_tail``: the last ``n`` rows, or the last ``fraction`` of rows, in (date, id) order.

    No global sort in one task: days are counted, the running total over days locates the cut day,
    and only rows of that day are ranked.
    """
    by = by or []
    per_day = df.groupBy(*by, DAY).agg(F.count(F.lit(1)).alias("_n"))
    # One row per day: the window below is over the calendar, not over the data.
    later = Window.partitionBy(*by).orderBy(F.col(DAY).desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*by)
    size = F.lit(n) if n is not None else F.floor(F.sum("_n").over(total) * F.lit(fraction))
    plan = per_day.select(
        *by, DAY, size.alias("_size"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later")
    )
    joined = df.join(plan, [*by, DAY])
    rank = F.row_number().over(Window.partitionBy(*by, DAY).orderBy(*[F.col(t).desc() for t in TIE]))
    return joined.withColumn("is_tail", F.col("_later") + rank <= F.col("_size")).drop("_later", "_size")


def sample_dates(df: DataFrame, season: str = "season", positions: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Dates at the given positions of each season's distinct dates."""
    dates = df.select(season, DAY).distinct()
    w = Window.partitionBy(season)
    ranked = dates.select(
        season,
        DAY,
        (F.row_number().over(w.orderBy(DAY)) - 1).alias("_i"),
        F.count(F.lit(1)).over(w).alias("_n"),
    )
    hit = F.lit(False)
    for p in positions:
        hit = hit | (F.col("_i") == F.floor((F.col("_n") - 1) * F.lit(p)))
    return ranked.filter(hit).select(season, DAY)


