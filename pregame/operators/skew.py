"""Ordered windows that survive hot keys.

A plain window puts every row of a key into one task. The helpers here first ask, with one
map-side-combined count over the key columns, whether any key exceeds ``pregame.maxGroupRows``.
If none does, the plain window is used (one shuffle). Otherwise each key is cut into blocks of
consecutive rows, numbered from per-day counts, and the rows just before a block are copied into
it, so a frame that looks back ``reach`` rows sees exactly what it would have seen uncut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DEFAULT_MAX_GROUP_ROWS = 2_000_000
_seen: dict[tuple, bool] = {}


def max_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("pregame.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))


def has_hot_group(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """True when some key holds more than ``limit`` rows (one partial aggregate, one row back).

    The answer is remembered: for equal plans, and on frames that operators derive row by row from a
    checked one (:func:`inherit`). Keys that refine keys known not to be hot are not hot either.
    """
    limit = limit or max_group_rows(df)
    known = getattr(df, "_known_groups", {})
    for (seen_keys, seen_limit), hot in known.items():
        if seen_limit == limit and (seen_keys == frozenset(keys) or (not hot and seen_keys <= frozenset(keys))):
            return hot
    memo = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if memo not in _seen:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        _seen[memo] = len(counts.filter(F.col("n") > limit).take(1)) > 0
    known = {**known, (frozenset(keys), limit): _seen[memo]}
    df._known_groups = known
    return _seen[memo]


def inherit(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` has the rows of ``old`` (or fewer): what is known about group sizes still holds."""
    new._known_groups = getattr(old, "_known_groups", {})
    return new


@dataclass
class Scope:
    """Rows ready for a look-back window, with the keys to partition by."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    halo: bool = False
    helpers: list[str] = field(default_factory=list)
    source: DataFrame | None = None

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.window().rowsBetween(start, end)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop copied rows and helper columns once the window columns exist."""
        if self.halo:
            df = df.filter(~F.col("_halo"))
        out = df.drop(*self.helpers)
        return out if self.source is None else inherit(out, self.source)


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right["_k_" + c])
    return cond


def number_rows(df: DataFrame, keys: list[str], day: str, tie: list[str]) -> DataFrame:
    """``_pos``: 0-based position of a row within its key, without gathering a key in one task.

    Rows are ranked inside (key, day) and shifted by the count of all earlier days, which comes
    from a summary with one row per key and day.
    """
    per_day = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    base = per_day.select(
        *[F.col(c).alias("_k_" + c) for c in [*keys, day]],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
    )
    ranked = df.withColumn("_in_day", F.row_number().over(Window.partitionBy(*keys, day).orderBy(*tie)))
    joined = ranked.join(base, _same(ranked, base, [*keys, day]), "inner")
    return joined.withColumn("_pos", F.col("_base") + F.col("_in_day") - 1).drop(
        "_base", "_in_day", *["_k_" + c for c in [*keys, day]]
    )


def row_scope(df: DataFrame, keys: list[str], day: str, tie: list[str], reach: int) -> Scope:
    """Scope for frames of at most ``reach`` rows back."""
    limit = max_group_rows(df)
    if not has_hot_group(df, keys, limit):
        return Scope(df, keys, [day, *tie], source=df)
    size = max(limit, reach)
    numbered = number_rows(df, keys, day, tie)
    block = F.floor(F.col("_pos") / size)
    tail = (F.col("_pos") % size) >= size - reach
    cut = (
        numbered.withColumn("_own", block)
        .withColumn(
            "_blk",
            F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))),
        )
        .withColumn("_halo", F.col("_blk") > F.col("_own"))
    )
    return Scope(cut, [*keys, "_blk"], [day, *tie], True, ["_blk", "_own", "_halo", "_pos"], df)


def day_scope(df: DataFrame, keys: list[str], day: str, tie: list[str], days: int, span: int = 64) -> Scope:
    """Scope for range frames over ``_day`` (days since the epoch) reaching ``days`` back.

    Blocks are spans of the calendar, so one plan serves every key size and nothing runs while it is built.
    """
    source = df
    df = df.withColumn("_day", F.unix_date(F.col(day)))
    span = max(span, days)
    block = F.floor(F.col("_day") / span)
    tail = F.pmod(F.col("_day"), F.lit(span)) >= span - days
    cut = (
        df.withColumn("_own", block)
        .withColumn(
            "_blk",
            F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))),
        )
        .withColumn("_halo", F.col("_blk") > F.col("_own"))
    )
    return Scope(cut, [*keys, "_blk"], ["_day"], True, ["_day", "_blk", "_own", "_halo"], source)


def running_sums(
    df: DataFrame, keys: list[str], day: str, tie: list[str], sums: dict[str, Column], inclusive: bool = False
) -> DataFrame:
    """Cumulative sums per key (0 before the first row), current row excluded unless ``inclusive``.

    Hot keys: sums inside a block plus the exclusive running total of earlier blocks.
    """
    end = 0 if inclusive else -1
    if not has_hot_group(df, keys):
        w = Window.partitionBy(*keys).orderBy(day, *tie).rowsBetween(Window.unboundedPreceding, end)
        return inherit(df.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()]), df)
    numbered = number_rows(df, keys, day, tie).withColumn("_blk", F.floor(F.col("_pos") / max_group_rows(df)))
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, end)
    inner = numbered.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias("_r_" + n) for n, e in sums.items()])
    totals = numbered.groupBy(*keys, "_blk").agg(*[F.sum(e).alias("_t_" + n) for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias("_k_" + c) for c in [*keys, "_blk"]],
        *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_o_" + n) for n in sums],
    )
    out = inner.join(offsets, _same(inner, offsets, [*keys, "_blk"]), "inner")
    return inherit(out.select(*df.columns, *[(F.col("_r_" + n) + F.col("_o_" + n)).alias(n) for n in sums]), df)


def running_last(df: DataFrame, keys: list[str], day: str, tie: list[str], values: list[str]) -> DataFrame:
    """Fill each of ``values`` forward: the latest non-null value up to and including the row."""
    if not has_hot_group(df, keys):
        w = Window.partitionBy(*keys).orderBy(day, *tie).rowsBetween(Window.unboundedPreceding, 0)
        keep = [c for c in df.columns if c not in values]
        return inherit(df.select(*keep, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]), df)
    numbered = number_rows(df, keys, day, tie).withColumn("_blk", F.floor(F.col("_pos") / max_group_rows(df)))
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = numbered.select("*", *[F.last(v, ignorenulls=True).over(w).alias("_r_" + v) for v in values])
    ends = numbered.groupBy(*keys, "_blk").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_pos"))).alias("_t_" + v) for v in values]
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(c).alias("_k_" + c) for c in [*keys, "_blk"]],
        *[F.last("_t_" + v, ignorenulls=True).over(before).alias("_o_" + v) for v in values],
    )
    out = inner.join(carried, _same(inner, carried, [*keys, "_blk"]), "inner")
    keep = [c for c in df.columns if c not in values]
    return inherit(out.select(*keep, *[F.coalesce(F.col("_r_" + v), F.col("_o_" + v)).alias(v) for v in values]), df)
