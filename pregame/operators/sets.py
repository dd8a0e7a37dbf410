"""Set operations and ordering on keyed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_competitions(parts: dict[str, DataFrame], tag: str = "competition") -> DataFrame:
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def intersect_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def except_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, labelled; repeated keys count once."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (
        left.exceptAll(right).withColumn("side", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key in a stated order (a total order gives one answer); combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on which two selections differ; empty when they agree."""
    return except_keys(a, b, keys)


def assert_same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    bad = same_rows(a, b, keys).take(1)
    if bad:
        raise ValueError(f"selections differ: {bad[0].asDict()}")


def chrono(day: str = "game_date", tie: str = "game_id") -> list[Column]:
    """The order every sequence uses; the id makes it total."""
    return [F.col(day), F.col(tie)]


def top_per_group(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def leaderboard(df: DataFrame, stat: str, tie: list[str], n: int) -> DataFrame:
    """Top ``n`` by a stat, missing counted as 0."""
    return df.orderBy(F.coalesce(F.col(stat), F.lit(0.0)).desc(), *tie).limit(n)


def examples(df: DataFrame, keys: list[str], col: str, k: int = 5) -> DataFrame:
    """Count and the ``k`` smallest distinct examples per issue, without collecting a whole group.

    Distinct values are counted per key; the examples come from a limited ranking.
    """
    distinct = df.select(*keys, col).distinct()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    first = (
        top_per_group(distinct, keys, [F.col(col)], k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.col(col))).alias("examples"))
    )
    return counts.join(first, keys)
