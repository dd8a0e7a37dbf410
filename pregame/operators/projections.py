"""Projections, labels, filters and status columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalar import day_end_utc, is_home_matchup, type_digit


def with_is_home(df: DataFrame, matchup: str = "matchup") -> DataFrame:
    return df.withColumn("is_home", is_home_matchup(F.col(matchup)))


def only_competition(df: DataFrame, digit: str, game_id: str = "game_id") -> DataFrame:
    return df.filter(type_digit(F.col(game_id)) == digit)


def prefix_columns(df: DataFrame, side: str, keep: list[str]) -> DataFrame:
    """Every column but ``keep`` renamed to ``{side}_{column}``."""
    return df.select(*[F.col(c).alias(c if c in keep else f"{side}_{c}") for c in df.columns])


def keep_columns(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Columns whose whole name matches one of the patterns."""
    found = [c for c in df.columns if any(re.fullmatch(p, c) for p in patterns)]
    return df.select(*found)


def with_game_labels(gm: DataFrame) -> DataFrame:
    """Margin, total and the winner label (NULL for a tie or an unplayed game)."""
    h, a = F.col("home_pts"), F.col("away_pts")
    return gm.withColumns({"margin": h - a, "total": h + a, "home_win": F.when(h != a, (h > a).cast("int"))})


def with_period_labels(gm: DataFrame, period: str) -> DataFrame:
    """The same for one period's columns ``home_{period}`` / ``away_{period}``."""
    h, a = F.col(f"home_{period}"), F.col(f"away_{period}")
    return gm.withColumns(
        {
            f"{period}_margin": h - a,
            f"{period}_total": h + a,
            f"{period}_home_win": F.when(h != a, (h > a).cast("int")),
        }
    )


def drop_category(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows of one category removed; rows with a NULL category stay."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def map_strict(col: Column, mapping: dict[str, float | str | int | bool]) -> Column:
    """Category to value; a category outside the mapping is fatal."""
    out: Column | None = None
    for key, value in mapping.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(col, F.lit("NULL")))))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def complete_case_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows kept and dropped by :func:`complete_cases`, in one pass."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def apply_relocations(df: DataFrame, mapping: dict[int, int], team: str = "team", season: str = "season") -> DataFrame:
    """Old team ids replaced; refused when old and new id both play in one season."""
    pairs = [(int(o), int(n)) for o, n in mapping.items()]
    if not pairs:
        return df
    ids = [i for p in pairs for i in p]
    seasons = df.filter(F.col(team).isin(ids)).select(team, season).distinct()
    target = _remap(F.col(team), pairs)
    clash = seasons.groupBy(target.alias("target"), season).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad = clash.take(1)
    if bad:
        raise ValueError(f"relocated ids overlap in season {bad[0][season]}")
    return df.withColumn(team, _remap(F.col(team), pairs))


def _remap(col: Column, pairs: list[tuple[int, int]]) -> Column:
    out = col
    for old, new in pairs:
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def with_split_role(df: DataFrame, validation: list[int], test: list[int], season: str = "season") -> DataFrame:
    """train / validation / test / served by season; later than every listed season is served."""
    s = F.col(season)
    last = max([*validation, *test])
    role = (
        F.when(s.isin(test), "test").when(s.isin(validation), "validation").when(s > last, "served").otherwise("train")
    )
    return df.withColumn("role", role)


def upcoming(fx: DataFrame, today: dt.date, days: int) -> DataFrame:
    """Fixtures dated from ``today`` to ``today + days``."""
    return fx.filter(F.col("game_date").between(F.lit(today), F.lit(today + dt.timedelta(days=days))))


def rows_for_market(df: DataFrame, market: str) -> DataFrame:
    """Ties leave the winner market only."""
    return df.filter(F.col("home_pts") != F.col("away_pts")) if market == "winner" else df


def with_route(df: DataFrame, decide_on: list[str]) -> DataFrame:
    """``linear`` when every deciding feature is known, else ``trees``."""
    ok = F.lit(True)
    for c in decide_on:
        ok = ok & F.col(c).isNotNull()
    return df.withColumn("route", F.when(ok, "linear").otherwise("trees"))


def current_weeks(fx: DataFrame, keys: list[str], week: str = "week") -> DataFrame:
    """Fixtures of the first unplayed week and the one after it, per key.

    The minimum is a small aggregate joined back, so no key is gathered for a window.
    """
    first = fx.groupBy(*keys).agg(F.min(week).alias("_first"))
    return fx.join(first, keys).filter(F.col(week) <= F.col("_first") + 1).drop("_first")


def with_division_game(gm: DataFrame, divisions: DataFrame) -> DataFrame:
    """Both sides in one division; a team outside the membership table is fatal."""
    d = divisions.select("team", "division")
    h = d.select(F.col("team").alias("_ht"), F.col("division").alias("_hd"))
    a = d.select(F.col("team").alias("_at"), F.col("division").alias("_ad"))
    out = gm.join(h, F.col("home_team") == F.col("_ht"), "left").join(a, F.col("away_team") == F.col("_at"), "left")
    missing = F.col("_hd").isNull() | F.col("_ad").isNull()
    same = F.when(missing, F.raise_error(F.lit("team without a division"))).otherwise(F.col("_hd") == F.col("_ad"))
    return out.withColumn("is_division", same.cast("int")).drop("_ht", "_hd", "_at", "_ad")


def league_slate(fx: DataFrame, pred: DataFrame) -> DataFrame:
    """Every fixture, its scored twin where there is one, and the league's first date and predictable count."""
    scored = pred.select(F.col("game_id").alias("_g"), "p_home")
    per = fx.groupBy("league").agg(F.min("game_date").alias("first_date"))
    joined = fx.join(scored, F.col("game_id") == F.col("_g"), "left").drop("_g")
    counts = joined.groupBy("league").agg(F.count("p_home").alias("predictable"))
    return joined.join(per, "league").join(counts, "league")


def with_row_status(rows: DataFrame, now: dt.datetime, hours_until_final: int = 5) -> DataFrame:
    """played / in_progress / voided / fixture.

    A score is final only once kick-off plus the margin has passed; without a kick-off, once the date has ended.
    """
    instant = F.lit(now)
    over = F.coalesce(
        F.col("kickoff_utc") + F.expr(f"INTERVAL {hours_until_final} HOURS") <= instant,
        day_end_utc(F.col("game_date")) <= instant,
    )
    status = (
        F.when(F.col("voided"), "voided")
        .when(F.col("home_pts").isNull(), "fixture")
        .when(over, "played")
        .otherwise("in_progress")
    )
    return rows.withColumn("row_status", status)


def merge_flex(copies: DataFrame, keys: list[str]) -> DataFrame:
    """One fixture per key: flexible when any copy says so, the earlier candidate date is served."""
    return copies.groupBy(*keys).agg(F.bool_or("flex").alias("flex"), F.min("copy_date").alias("copy_date"))


