"""Rest, schedule density, venues, travel and time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalar import haversine_km, utc_offset_hours
from pregame.operators.rolling import DAY, TIE
from pregame.operators.skew import day_scope, has_hot_group, inherit, row_scope, running_last, running_sums


def _previous(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Columns of the previous game of a key."""
    scope = row_scope(df, keys, DAY, TIE, 1)
    return scope.finish(
        scope.df.select("*", *[F.lag(c).over(scope.window()).alias(n) for n, c in cols.items()])
    )


def rest_days(df: DataFrame, keys: list[str], cap: int = 7) -> DataFrame:
    """Days since the previous game, capped. Without the season in ``keys`` it crosses the off-season."""
    out = _previous(df, keys, {"_prev": DAY})
    raw = F.datediff(F.col(DAY), F.col("_prev"))
    return out.withColumns(
        {
            "rest_days": F.least(raw, F.when(raw.isNotNull(), F.lit(cap))),
            "is_back_to_back": F.coalesce(raw == 1, F.lit(False)),
        }
    ).drop("_prev")


def season_rest(
    df: DataFrame, keys: list[str], cap: int = 7, long_break: int = 10, null_opener: bool = False
) -> DataFrame:
    """Season-scoped rest with the raw gap and a long-break flag.

    At a season opener the flag is False, or NULL with ``null_opener``.
    """
    out = _previous(df, keys, {"_prev": DAY})
    raw = F.datediff(F.col(DAY), F.col("_prev"))
    long = raw > long_break
    return out.withColumns(
        {
            "rest_raw": raw,
            "rest_days": F.least(raw, F.when(raw.isNotNull(), F.lit(cap))),
            "is_long_break": long if null_opener else F.coalesce(long, F.lit(False)),
            "is_back_to_back": F.coalesce(raw == 1, F.lit(False)),
        }
    ).drop("_prev")


def weekly_rest(df: DataFrame, keys: list[str], week: str = "week", short: int = 5, bye_gap: int = 2) -> DataFrame:
    """Days of rest, short week, bye (by week number, not by days) and opener flag."""
    out = _previous(df, keys, {"_prev": DAY, "_prev_week": week})
    days = F.datediff(F.col(DAY), F.col("_prev"))
    return out.withColumns(
        {
            "rest_days": days,
            "short_week": F.coalesce((days <= short).cast("int"), F.lit(0)),
            "off_bye": F.coalesce((F.col(week) - F.col("_prev_week") >= bye_gap).cast("int"), F.lit(0)),
            "season_opener": F.col("_prev").isNull().cast("int"),
        }
    ).drop("_prev", "_prev_week")


def games_in_window(df: DataFrame, keys: list[str], days: int = 7, out: str | None = None) -> DataFrame:
    """Games in the last ``days`` days: strictly earlier, lower bound exclusive."""
    scope = day_scope(df, keys, DAY, TIE, days)
    frame = scope.window().rangeBetween(-(days - 1), -1)
    return scope.finish(scope.df.withColumn(out or f"games_last_{days}", F.count(F.lit(1)).over(frame)))


def dense_rest(df: DataFrame, keys: list[str], cap: int = 7) -> DataFrame:
    """Capped rest, back-to-back (at most one day) and third game in four nights. NULL without a previous game."""
    counted = games_in_window(df, keys, 4, "_last3")
    out = _previous(counted, keys, {"_prev": DAY})
    raw = F.datediff(F.col(DAY), F.col("_prev"))
    known = raw.isNotNull()
    return out.withColumns(
        {
            "rest_days": F.when(known, F.least(raw, F.lit(cap))),
            "is_back_to_back": F.when(known, raw <= 1),
            "is_third_in_four": F.when(known, F.col("_last3") >= 2),
        }
    ).drop("_prev", "_last3")


def attach_venue(df: DataFrame) -> DataFrame:
    """Venue of a game is its home team: known on both rows without a join."""
    return df.withColumn("venue", F.when(F.col("is_home"), F.col("team")).otherwise(F.col("opp")))


def attach_arena(df: DataFrame, arenas: DataFrame, venue: str = "venue") -> DataFrame:
    """Coordinates and zone of the venue; an unknown venue is fatal."""
    a = arenas.withColumnRenamed("team", "_arena_team")
    out = df.join(a, F.col(venue) == F.col("_arena_team"), "left")
    known = F.when(
        F.col("_arena_team").isNull(), F.raise_error(F.concat(F.lit("unknown venue "), F.col(venue).cast("string")))
    ).otherwise(F.col("lat"))
    return out.withColumn("lat", known).drop("_arena_team")


def travel(df: DataFrame, keys: list[str], arenas: DataFrame) -> DataFrame:
    """Kilometres and clock shift from the previous venue; NULL at the first game of ``keys``.

    Coordinates are attached once, before the window, so the previous venue's come from ``lag``.
    """
    has_hot_group(df, keys)  # before the arena join, which keeps the rows
    placed = attach_arena(attach_venue(df), arenas)
    placed = placed.withColumn("offset_h", utc_offset_hours(F.col(DAY), F.col("zone")))
    out = _previous(inherit(placed, df), keys, {"_lat": "lat", "_lon": "lon", "_zone": "zone", "prev_venue": "venue"})
    km = F.when(
        F.col("prev_venue") == F.col("venue"), F.lit(0.0)
    ).otherwise(haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return out.withColumns(
        {
            "travel_km": F.when(F.col("prev_venue").isNotNull(), km),
            "tz_shift": F.col("offset_h") - utc_offset_hours(F.col(DAY), F.col("_zone")),
        }
    ).drop("_lat", "_lon", "_zone", "offset_h")


def road_trip(df: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive away games so far, this one included; 0 at home."""
    counted = running_sums(
        df,
        keys,
        DAY,
        TIE,
        {"_away": (~F.col("is_home")).cast("int")},
        inclusive=True,
    )
    # Away games up to here minus those up to the latest home game.
    mark = counted.withColumn("_at_home", F.when(F.col("is_home"), F.col("_away")))
    filled = running_last(inherit(mark, counted), keys, DAY, TIE, ["_at_home"])
    trip: Column = F.when(F.col("is_home"), F.lit(0)).otherwise(
        F.col("_away") - F.coalesce(F.col("_at_home"), F.lit(0))
    )
    return filled.withColumn("road_trip", trip.cast("int")).drop("_away", "_at_home")
