"""Small helpers shared by the query modules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.session import shared_dir

TEAM = ["league", "team"]
TEAM_SEASON = ["league", "team", "season"]
WEEK_SQL = "CAST(1 + (game_date - make_date(season, 8, 1)) // 7 AS INT)"


def r6(col: Column | str, alias: str | None = None) -> Column:
    """Rounded for comparison across engines; adding 0 turns a negative zero into zero."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6) + F.lit(0.0)
    name = alias or (col if isinstance(col, str) else None)
    return out.alias(name) if name else out


def with_week(df: DataFrame) -> DataFrame:
    """Week of the season, counted from its first of August."""
    start = F.make_date(F.col("season"), F.lit(8), F.lit(1))
    return df.withColumn("week", (F.floor(F.datediff("game_date", start) / 7) + 1).cast("int"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table a query derives from the given ones."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
