"""Which fixtures can be predicted, what blocks the others, what is late."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalar import day_end_utc
from pregame.operators.rolling import DAY, TIE
from pregame.operators.skew import running_sums

KEEP = ["game_id", "game_date"]


def unpivot_sides(fx: DataFrame, keep: list[str]) -> DataFrame:
    home = F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team"))
    away = F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"))
    return fx.select(*keep, F.explode(F.array(home, away)).alias("s")).select(*keep, "s.*")


def predictable(fx: DataFrame, scope: list[str]) -> DataFrame:
    """Fixtures neither of whose sides has an earlier unplayed one, in (date, id) order.

    A side is free when the fixture is the team's first; firsts are a struct minimum (combined
    map-side), then counted per game.
    """
    sides = unpivot_sides(fx, [*scope, *KEEP])
    first = sides.groupBy(*scope, "team").agg(F.min(F.struct(*KEEP[::-1])).alias("f"))
    free = first.groupBy(F.col("f.game_id").alias("_g")).agg(F.count(F.lit(1)).alias("_free"))
    out = fx.join(free, F.col("game_id") == F.col("_g"), "left")
    return out.withColumn("predictable", F.coalesce(F.col("_free") == 2, F.lit(False))).drop("_g", "_free")


def blocking(fx: DataFrame, scope: list[str]) -> DataFrame:
    """Per side: the team's first earlier unplayed fixture. Sides that nothing blocks are left out."""
    sides = unpivot_sides(fx, [*scope, *KEEP])
    first = sides.groupBy(*scope, "team").agg(F.min(F.struct("game_date", "game_id")).alias("_f"))
    j = sides.join(first, [*scope, "team"])
    return j.filter(F.col("_f.game_id") != F.col("game_id")).select(
        *scope, "game_id", "game_date", "side", "team",
        F.col("_f.game_id").alias("blocked_by"), F.col("_f.game_date").alias("blocked_by_date"),
    )


def fixture_status(fx: DataFrame, history: DataFrame, scope: list[str]) -> DataFrame:
    """Status code per fixture in priority order, with every blocking side as an array.

    Codes: same_team, unknown_team, date_out_of_range, season_opener, previous_game_pending, ok.
    ``history`` holds team-games (scope, team, game_id, game_date). Pending dates are those of the
    team's unplayed fixtures before this one.
    """
    played_ids = history.select(F.col("game_id").alias("_p")).distinct()
    open_fx = fx.join(played_ids, F.col("game_id") == F.col("_p"), "left_anti")
    sides = unpivot_sides(open_fx, [*scope, *KEEP])
    span = history.groupBy(*scope, "team").agg(F.min("game_date").alias("_first"))
    cutoff = history.groupBy(*scope).agg(F.max("game_date").alias("_cutoff"))
    # A team's unplayed days are one list; a fixture holds the length of its part of the list, which is cut out at the end.
    days = sides.select(*scope, "team", "game_date").distinct()
    lists = days.groupBy(*scope, "team").agg(F.transform(F.array_sort(F.collect_list("game_date")), lambda d: d.cast("string")).alias("_days"))
    days = days.withColumn("earlier", F.row_number().over(Window.partitionBy(*scope, "team").orderBy("game_date")) - 1)
    j = (
        sides.join(span, [*scope, "team"], "left")
        .join(cutoff, scope, "left")
        .join(days, [*scope, "team", "game_date"])
    )
    code = (
        F.when(F.coalesce(F.col("_first") >= F.col("game_date"), F.lit(True)), "season_opener")
        .when(F.col("earlier") > 0, "previous_game_pending")
    )
    per = j.withColumn("code", code).groupBy("game_id").agg(
        F.count_if(F.col("_first").isNull()).alias("_unknown"),
        F.max("_cutoff").alias("_cutoff"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("code").isNotNull(),
                    F.struct(
                        (F.col("side") == "away").alias("o"),
                        "side",
                        F.col("team").alias("franchise_id"),
                        "code",
                        F.when(F.col("code") == "season_opener", 0).otherwise(F.col("earlier")).alias("earlier"),
                    ),
                )
            )
        ).alias("_b"),
    )
    out = open_fx.join(per, "game_id", "left")
    for side in ("home", "away"):
        mine = lists.select(*scope, F.col("team").alias(f"{side}_team"), F.col("_days").alias(f"_{side}_days"))
        out = out.join(mine, [*scope, f"{side}_team"], "left")
    whole = (
        F.when(F.col("home_team") == F.col("away_team"), "same_team")
        .when(F.col("_unknown") > 0, "unknown_team")
        .when(F.col("game_date") <= F.col("_cutoff"), "date_out_of_range")
    )
    own_days = lambda x: F.when(x["side"] == "home", F.col("_home_days")).otherwise(F.col("_away_days"))
    blocked = F.transform(
        "_b", lambda x: F.struct(x["side"].alias("side"), x["franchise_id"].alias("franchise_id"), x["code"].alias("code"), F.slice(own_days(x), 1, x["earlier"]).alias("pending"))
    )
    first_code = F.get(F.col("_b"), F.lit(0))["code"]
    return out.select(
        *fx.columns,
        F.coalesce(whole, first_code, F.lit("ok")).alias("status_code"),
        F.when(whole.isNull(), blocked).otherwise(F.slice(blocked, 1, 0)).alias("blocked_by"),
    )


def predictable_by_date(fx: DataFrame, cutoff: dt.date) -> DataFrame:
    """Date rule: predictable up to the day after the last complete day."""
    return fx.filter(F.col("game_date") <= F.lit(cutoff + dt.timedelta(days=1)))


def dependency_report(fx: DataFrame, scope: list[str], week: str = "week") -> DataFrame:
    """Predictable and waiting fixtures per week: a fixture waits when a side has an earlier open week."""
    sides = unpivot_sides(fx, [*scope, "game_id", week])
    first = sides.groupBy(*scope, "team").agg(F.min(week).alias("_first"))
    per = (
        sides.join(first, [*scope, "team"])
        .groupBy(*scope, "game_id", week)
        .agg(F.bool_and(F.col("_first") == F.col(week)).alias("ready"))
    )
    return per.groupBy(*scope, week).agg(
        F.count_if("ready").alias("predictable"), F.count_if(~F.col("ready")).alias("waiting")
    )


def missing_results(fx: DataFrame, played_ids: DataFrame, now: dt.datetime, hours: int = 5) -> DataFrame:
    """Fixtures that should have a result: kick-off plus ``hours`` passed, or no time and over a day old."""
    open_fx = fx.join(played_ids.select("game_id"), "game_id", "left_anti")
    deadline = F.lit(now - dt.timedelta(hours=hours))
    late = F.when(F.col("kickoff_utc").isNotNull(), F.col("kickoff_utc") <= deadline).otherwise(
        F.datediff(F.lit(now.date()), F.col("game_date")) > 1
    )
    return open_fx.filter(late)


def missing_results_by_day(fx: DataFrame, played_ids: DataFrame, now: dt.datetime, hours: int = 6) -> DataFrame:
    """The same judged by the end of the date on the Pacific coast plus ``hours``."""
    open_fx = fx.join(played_ids.select("game_id"), "game_id", "left_anti")
    return open_fx.filter(day_end_utc(F.col("game_date")) + F.expr(f"INTERVAL {hours} HOURS") <= F.lit(now))


def freshness(history: DataFrame, keys: list[str], today: dt.date, stale_after: int = 2) -> DataFrame:
    out = history.groupBy(*keys).agg(F.max("game_date").alias("data_as_of"))
    behind = F.datediff(F.lit(today), F.col("data_as_of"))
    return out.withColumns({"days_behind": behind, "stale": behind > stale_after})


def freshness_by_missing(history: DataFrame, late: DataFrame, keys: list[str], today: dt.date) -> DataFrame:
    """Stale only when a result is missing; the age is reported, not judged."""
    n = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("late"))
    out = history.groupBy(*keys).agg(F.max("game_date").alias("data_as_of")).join(n, keys, "left")
    return out.select(
        *keys, "data_as_of", F.datediff(F.lit(today), F.col("data_as_of")).alias("days_behind"),
        F.coalesce("late", F.lit(0)).alias("late"), (F.coalesce("late", F.lit(0)) > 0).alias("stale"),
    )


def season_state(fx: DataFrame, keys: list[str], today: dt.date, publish_by: dt.date) -> DataFrame:
    """not_started when the first scheduled game is ahead; an unpublished schedule excuses only before ``publish_by``."""
    out = fx.groupBy(*keys).agg(F.min("game_date").alias("first_game"))
    unpublished = "unreadable" if today >= publish_by else "not_started"
    verdict = (
        F.when(F.col("first_game").isNull(), unpublished)
        .when(F.col("first_game") > F.lit(today), "not_started")
        .otherwise("started")
    )
    return out.withColumn("verdict", verdict)


def open_seasons(df: DataFrame, today: dt.date, first_month: int, season: str = "season") -> DataFrame:
    """Rows of the current and previous season: a partition filter when the table is laid out by season."""
    current = today.year - (1 if today.month < first_month else 0)
    return df.filter(F.col(season) >= current - 1)


def season_coverage(tables: dict[str, DataFrame], today: dt.date, first_month: int) -> DataFrame:
    """Newest season per table beside the one the calendar says is under way."""
    from pregame.operators.sets import union_all

    current = today.year - (1 if today.month < first_month else 0)
    parts = [
        df.groupBy("league").agg(F.max("season").alias("newest_season")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return union_all(parts).withColumns(
        {"calendar_season": F.lit(current), "covered": F.col("newest_season") == F.lit(current)}
    )


def full_window_date(fixture_sides: DataFrame, played: DataFrame, scope: list[str], n: int) -> DataFrame:
    """Per fixture: when both teams will have played ``n`` games, from the schedule's own dates.

    ``played`` counts games per (scope, team). A team short of ``n`` with too few scheduled games gives NULL;
    two teams already there give NULL too (nothing to wait for), told apart by ``short``.
    """
    have = fixture_sides.select(*scope, "team").distinct().join(played, [*scope, "team"], "left")
    have = have.select(*scope, "team", F.coalesce("played", F.lit(0)).alias("_have"))
    ranked = running_sums(fixture_sides, [*scope, "team"], DAY, TIE, {"_rank": F.lit(1)}, inclusive=True)
    reach = (
        ranked.join(have, [*scope, "team"])
        .filter(F.col("_rank") == F.lit(n) - F.col("_have"))
        .groupBy(*scope, "team")
        .agg(F.min("game_date").alias("_reach"))
    )
    side = fixture_sides.join(have, [*scope, "team"]).join(reach, [*scope, "team"], "left")
    short: Column = F.col("_have") < n
    return side.groupBy(*scope, "game_id").agg(
        F.max(F.greatest(F.lit(n) - F.col("_have"), F.lit(0))).alias("short"),
        F.when(
            F.count_if(short & F.col("_reach").isNull()) == 0, F.max(F.when(short, F.col("_reach")))
        ).alias("full_window_date"),
    )


