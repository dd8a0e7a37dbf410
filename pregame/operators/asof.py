"""As-of joins: the state a team or player had strictly before a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pregame.operators.joins import null_list


def asof_before(
    requests: DataFrame, states: DataFrame, keys: list[str], values: list[str], day: str = "game_date", tie: list[str] | None = None
) -> DataFrame:
    """Each request row gets the key's latest ``values`` dated strictly before it.

    Both sides are reduced to one row per key and day before the window: states to their last
    row of the day, requests to the days asked for. The window therefore runs over at most the
    calendar per key however many rows a key has; the answer is joined back on key and day.
    """
    order = F.struct(day, *(tie or ["game_id"]))
    daily = states.groupBy(*keys, day).agg(F.max_by(F.struct(*values), order).alias("_state"))
    asked = requests.select(*keys, day).distinct()
    timeline = daily.unionByName(asked, allowMissingColumns=True).groupBy(*keys, day).agg(
        F.max("_state").alias("_state")
    )
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    known = timeline.select(
        *keys,
        day,
        F.last("_state", ignorenulls=True).over(w).alias("_known"),
        F.last(F.when(F.col("_state").isNotNull(), F.col(day)), ignorenulls=True).over(w).alias("as_of"),
    )
    return requests.join(known, [*keys, day], "left").select(
        *requests.columns, "as_of", *[F.col(f"_known.{v}").alias(v) for v in values]
    )


def trailing_state(tg: DataFrame, keys: list[str], metrics: list[str], w: int, prefix: str = "form") -> DataFrame:
    """Form after each game: mean of the last ``w`` games including it; NULL below ``w``.

    This is the state a later fixture reads through :func:`asof_before`.
    """
    from pregame.operators.rolling import DAY, TIE
    from pregame.operators.skew import row_scope

    scope = row_scope(tg, keys, DAY, TIE, w)
    frame = scope.rows(-(w - 1), 0)
    new = [F.when(F.count(m).over(frame) == w, F.avg(m).over(frame)).alias(f"{prefix}{w}_{m}") for m in metrics]
    return scope.finish(scope.df.select("*", *new))


def fixture_form(
    fixture_sides: DataFrame, tg: DataFrame, keys: list[str], metrics: list[str], w: int, prefix: str = "form"
) -> DataFrame:
    states = trailing_state(tg, keys, metrics, w, prefix)
    return asof_before(fixture_sides, states, keys, [f"{prefix}{w}_{m}" for m in metrics])


def current_roster(players: DataFrame, before: dt.date, season: int, role: str) -> DataFrame:
    """Each player's latest row before a date, kept when of that season and with a known role."""
    rest = [c for c in players.columns if c != "player_id"]
    latest = (
        players.filter(F.col("game_date") < F.lit(before))
        .groupBy("player_id")
        .agg(F.max_by(F.struct(*rest), F.struct("game_date", "game_id")).alias("r"))
        .select("player_id", "r.*")
    )
    return latest.filter((F.col("season") == season) & F.col(role).isNotNull())


def trailing_minutes_asof(rolled: DataFrame, season: int, before: dt.date, col: str) -> DataFrame:
    """Each player's in-season trailing value as of a date, from rows that already carry it."""
    return (
        rolled.filter((F.col("season") == season) & (F.col("game_date") < F.lit(before)))
        .groupBy("player_id")
        .agg(F.max_by(col, F.struct("game_date", "game_id")).alias(col), F.max("game_date").alias("last_game"))
    )


def split_report(report: DataFrame, statuses: dict[str, bool]) -> DataFrame:
    """Report rows with ``pending`` and ``absent``; an unknown status of a real row is fatal."""
    from pregame.operators.projections import map_strict

    pending = F.col("player_id").isNull()
    absent = F.when(pending, F.lit(None).cast("boolean")).otherwise(map_strict(F.col("report_status"), statuses))
    return report.withColumns({"pending": pending, "absent": absent})


def live_availability(report: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Absent count and weighted minutes per team; NULL, not 0, for a team whose report is pending."""
    w = weights.select("player_id", F.col("roll_mins").alias("_w"))
    j = report.join(w, "player_id", "left")
    agg = j.groupBy(*keys).agg(
        F.bool_or("pending").alias("pending"),
        F.count_if(F.coalesce("absent", F.lit(False))).alias("_n"),
        F.sum(F.when(F.col("absent"), F.coalesce("_w", F.lit(0.0))).otherwise(0.0)).alias("_s"),
    )
    known = ~F.col("pending")
    return agg.select(
        *keys, "pending", F.when(known, F.col("_n")).alias("absent"), F.when(known, F.col("_s")).alias("absent_minutes")
    )


def latest_report(reports: DataFrame, as_of: dt.datetime, key: list[str], at: str = "ts", hours: int = 12, grid_minutes: int = 15) -> DataFrame:
    """Newest report per key not after ``as_of`` and at most ``hours`` old, on the publication grid."""
    step = grid_minutes * 60
    slot = (F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / step) * step).cast("timestamp")
    inside = reports.withColumn("slot", slot).filter(
        (F.col("slot") <= F.lit(as_of)) & (F.col("slot") >= F.lit(as_of - dt.timedelta(hours=hours)))
    )
    rest = [c for c in inside.columns if c not in key]
    best = inside.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("slot", at)).alias("r"))
    return best.select(*key, "r.*")


def assemble_fixture_features(fx: DataFrame, side_features: DataFrame, features: list[str], require: bool = False) -> DataFrame:
    """Fixtures with both sides' features in declared order and the names of missing ones.

    With ``require`` incomplete fixtures are left out.
    """
    home = F.col("side") == "home"
    wide = side_features.groupBy("game_id").agg(
        *[F.max(F.when(home, F.col(c))).alias(f"home_{c}") for c in features],
        *[F.max(F.when(~home, F.col(c))).alias(f"away_{c}") for c in features],
    )
    declared = [f"{s}_{c}" for s in ("home", "away") for c in features]
    out = fx.join(wide, "game_id", "left").select(*fx.columns, *declared).withColumn("missing", null_list(declared))
    return out.filter(F.size("missing") == 0) if require else out


