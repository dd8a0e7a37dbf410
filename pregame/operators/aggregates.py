"""Aggregations over team-games, players, shots and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.operators.order_stats import exact_quantiles


GAME_TEAM = ["game_id", "team"]


# ---- absence and availability -------------------------------------------------------------------


def _absent_weight(weight: str) -> Column:
    return F.coalesce(F.when(F.col("is_absent"), F.col(weight)), F.lit(0.0))


def reduce_absence(players: DataFrame, weight: str, how: str = "sum", keys: list[str] = GAME_TEAM) -> DataFrame:
    """Absent players' weights per team-game: sum or max; an unknown weight counts 0."""
    fn = {"sum": F.sum, "max": F.max}[how]
    return players.groupBy(*keys).agg(fn(_absent_weight(weight)).alias(f"absent_{how}"))


def top_n_sum(players: DataFrame, weight: str, n: int = 2, keys: list[str] = GAME_TEAM) -> DataFrame:
    """Sum of the ``n`` largest absent weights per team-game; 0 where nobody is absent."""
    w = Window.partitionBy(*keys).orderBy(F.col("_w").desc(), "player_id")
    top = (
        players.select(*keys, "player_id", _absent_weight(weight).alias("_w"))
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= n)
    )
    return top.groupBy(*keys).agg(F.sum("_w").alias(f"absent_top{n}"))


def team_availability(players: DataFrame, weight: str, keys: list[str] = GAME_TEAM) -> DataFrame:
    """Absence count and weighted absence in one aggregate."""
    return players.groupBy(*keys).agg(
        F.count_if("is_absent").alias("absent"), F.sum(_absent_weight(weight)).alias("absent_weight")
    )


def zero_weight_report(players: DataFrame, weights: list[str]) -> DataFrame:
    """Per variant: absences, unknown weights, their share, negative weights. One pass, one row per variant."""
    absent = players.filter("is_absent")
    aggs = [F.count(F.lit(1)).alias("absences")]
    for w in weights:
        aggs += [F.count_if(F.col(w).isNull()).alias(f"{w}_u"), F.count_if(F.col(w) < 0).alias(f"{w}_n")]
    one = absent.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(w).alias("variant"), F.col(f"{w}_u").alias("unknown"), F.col(f"{w}_n").alias("negative"))
            for w in weights
        ]
    )
    return one.select("absences", F.explode(rows).alias("r")).select(
        "r.variant",
        "absences",
        "r.unknown",
        F.try_divide(F.col("r.unknown"), F.col("absences")).alias("unknown_share"),
        "r.negative",
    )


def clean_games(players: DataFrame, weights: list[str], key: str = "game_id") -> DataFrame:
    """Games in which every absent player has every weight."""
    ok = F.lit(True)
    for w in weights:
        ok = ok & F.col(w).isNotNull()
    return players.groupBy(key).agg(F.bool_and(~F.col("is_absent") | ok).alias("_ok")).filter("_ok").select(key)


def coincidence_share(players: DataFrame, keys: list[str] = GAME_TEAM) -> DataFrame:
    """Share of team-games with at most one absentee, where sum and max agree by construction."""
    per = players.groupBy(*keys).agg(F.count_if("is_absent").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("team_games"),
        F.count_if(F.col("n") <= 1).alias("coincide"),
        F.avg((F.col("n") <= 1).cast("double")).alias("share"),
    )


# ---- shots --------------------------------------------------------------------------------------

SHOT_VALUE = {"3PT": 1.5, "2PT": 1.0}  # effective field-goal weights


def zone_baseline(shots: DataFrame, seasons: list[int]) -> DataFrame:
    """Conversion per zone from the training seasons only."""
    return (
        shots.filter(F.col("season").isin(seasons))
        .groupBy("zone")
        .agg(F.count(F.lit(1)).alias("attempts"), F.sum("made").alias("made"))
        .withColumn("rate", F.col("made") / F.col("attempts"))
    )


def shot_quality(shots: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and actual value per attempt and their difference; a zone without a rate is fatal."""
    from pregame.operators.projections import map_strict

    rates = baseline.select(F.col("zone").alias("_z"), F.col("rate").alias("_r"))
    # Attempts are first counted per zone and type, so the join meets groups, not shots.
    per = shots.groupBy(*keys, "zone", "shot_type").agg(F.count(F.lit(1)).alias("n"), F.sum("made").alias("m"))
    j = per.join(rates, F.col("zone") == F.col("_z"), "left")
    rate = F.when(F.col("_r").isNull(), F.raise_error(F.concat(F.lit("no rate for zone "), F.col("zone")))).otherwise(
        F.col("_r")
    )
    value = map_strict(F.col("shot_type"), SHOT_VALUE)
    return (
        j.withColumns({"_e": rate * value * F.col("n"), "_a": value * F.col("m")})
        .groupBy(*keys)
        .agg(F.sum("n").alias("shots"), F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
        .select(
            *keys,
            "shots",
            (F.col("_e") / F.col("shots")).alias("shot_quality"),
            (F.col("_a") / F.col("shots")).alias("actual_efg"),
            ((F.col("_a") - F.col("_e")) / F.col("shots")).alias("shooting_luck"),
        )
    )


# ---- standings ----------------------------------------------------------------------------------


def standings_totals(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Games, W/L/OTL and goals per team from rows with ``result``, ``pts``, ``opp_pts``."""
    return sides.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("result") == "W").alias("win"),
        F.count_if(F.col("result") == "L").alias("loss"),
        F.count_if(F.col("result") == "OTL").alias("otl"),
        F.sum("pts").cast("bigint").alias("gf"),
        F.sum("opp_pts").cast("bigint").alias("ga"),
    )


STANDING_FIELDS = ["win", "loss", "otl", "gf", "ga"]


def standings_diff(computed: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """Computed minus stated per field; ``fields`` lists only those that differ. Equal teams are left out.

    A stated team without computed games counts as zeros; a field that is not stated does not differ.
    """
    s = stated.select(*keys, *[F.col(f).alias(f"_{f}") for f in STANDING_FIELDS])
    j = computed.join(s, keys, "right")
    d = {f: F.coalesce(F.col(f), F.lit(0)) - F.col(f"_{f}") for f in STANDING_FIELDS}
    parts = [F.when(v != 0, F.struct(F.lit(f).alias("field"), v.alias("delta"))) for f, v in d.items()]
    out = j.select(*keys, *[v.alias(f"d_{f}") for f, v in d.items()], F.array_compact(F.array(*parts)).alias("fields"))
    return out.filter(F.size("fields") > 0)


# ---- coverage and distributions -----------------------------------------------------------------


def coverage_by_season(df: DataFrame, cols: list[str], season: str = "season", approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(season).agg(*[fn(c).alias(f"{c}s") for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def modal_by_group(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie.

    Counts per (key, value) first, then the best count per key, so no key's values are held at once.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct((-F.col("_n")).alias("_o"), F.col(col).alias("_v"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(F.col(col).alias("_v"), "_n"), order).alias("_b"))
    return best.select(*keys, F.col("_b._v").alias(f"modal_{col}"), F.col("_b._n").alias("modal_count"))


def first_seasons(tg: DataFrame, keys: list[str]) -> DataFrame:
    return tg.groupBy(*keys).agg(F.min("season").alias("first_season"))


def newcomers(tg: DataFrame, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """Teams whose first season is later than the first season on record of their scope."""
    first = first_seasons(tg, keys)
    scope = scope or []
    start = first.groupBy(*scope).agg(F.min("first_season").alias("_s"))
    joined = first.join(start, scope) if scope else first.crossJoin(F.broadcast(start))  # one row
    return joined.filter(F.col("first_season") > F.col("_s")).drop("_s")


def home_advantage(gm: DataFrame, keys: list[str]) -> DataFrame:
    """Home-win rate over games with a winner, per key."""
    won = (F.col("home_pts") > F.col("away_pts")).cast("double")
    return (
        gm.filter(F.col("home_pts") != F.col("away_pts"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("games"), F.avg(won).alias("home_win_rate"))
    )


def win_share_spread(tg: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation, least and greatest of the teams' win shares."""
    share = tg.groupBy(*keys, "team").agg(F.avg((F.col("wl") == "W").cast("double")).alias("s"))
    return share.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("teams"),
        F.stddev_pop("s").alias("spread"),
        F.min("s").alias("lowest"),
        F.max("s").alias("highest"),
    )


def retention(tg: DataFrame, candidates: list[str], season: str = "season") -> DataFrame:
    """Share of games complete on both sides per candidate column; the NULL season is the overall row."""
    per = tg.groupBy(season, "game_id").agg(*[F.bool_and(F.col(c).isNotNull()).alias(c) for c in candidates])
    return per.rollup(season).agg(
        F.count(F.lit(1)).alias("games"), *[F.avg(F.col(c).cast("double")).alias(f"keep_{c}") for c in candidates]
    )


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation per pair over rows where both are known; one pass."""
    one = df.agg(
        *[F.corr(a, b).alias(f"{a}|{b}|r") for a, b in pairs],
        *[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}|n") for a, b in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"),
                F.col(f"`{a}|{b}|n`").alias("n"), F.col(f"`{a}|{b}|r`").alias("r"),
            )
            for a, b in pairs
        ]
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


def bucket_by_edges(df: DataFrame, value: str, edges: Column, out: str = "bucket") -> DataFrame:
    """Right-closed bucket number 1.. from an array of inner edges: edges strictly below the value, plus one."""
    below = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(e < F.col(value), 1).otherwise(0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), below + 1))


def quartile_summary(df: DataFrame, by: str, of: str) -> DataFrame:
    """Mean of ``of`` per quartile of ``by``: exact linear edges, right-closed, equal edges merged."""
    edges = exact_quantiles(df, {by: [0.25, 0.5, 0.75]})[by]
    cut = bucket_by_edges(df.select(by, of), by, F.array_distinct(F.array(*[F.lit(e).cast("double") for e in edges])))
    return (
        cut.filter("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(of).alias(f"mean_{of}"))
    )


def describe_distribution(df: DataFrame, col: str, quantiles: list[float], thresholds: list[float]) -> DataFrame:
    """Exact quantiles and the shares above the thresholds, one row."""
    q = exact_quantiles(df, {col: quantiles})[col]
    one = df.agg(F.count(col).alias("n"), *[F.avg((F.col(col) > t).cast("double")).alias(f"above_{t:g}") for t in thresholds])
    return one.select(
        "n",
        *[F.lit(q[i]).cast("double").alias(f"q{round(x * 100):02d}") for i, x in enumerate(quantiles)],
        *[F.col(f"`above_{t:g}`") for t in thresholds],
    )


def collapse_partial_lines(
    df: DataFrame, keys: list[str], counters: list[str], minutes: str, valid: Column, rest: list[str], tie: list[str]
) -> DataFrame:
    """One row per key: counters summed, other columns from the row with most minutes among valid rows.

    The choice depends on values only, never on row order.
    """
    order = F.struct(valid.cast("int").alias("v"), F.coalesce(F.col(minutes), F.lit(-1.0)).alias("m"), *tie)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.sum(c).alias(c) for c in counters],
        F.max_by(F.struct(*rest), order).alias("_main"),
    )
    return out.select(*keys, "lines", *counters, "_main.*")


def schedule_shape(tg: DataFrame, scope: list[str]) -> DataFrame:
    """Per season: uniform, short-only or unbalanced, and whether the game count reconciles."""
    per = tg.groupBy(*scope, "team").agg(F.countDistinct("game_id").alias("n"))
    games = tg.groupBy(*scope).agg(F.countDistinct("game_id").alias("games"))
    modal = modal_by_group(per, scope, "n").select(*scope, F.col("modal_n").alias("modal"))
    stats = (
        per.join(modal, scope)
        .groupBy(*scope, "modal")
        .agg(
            F.count(F.lit(1)).alias("teams"),
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.sum("n").alias("_sum"),
            F.sum(F.greatest(F.col("modal") - F.col("n"), F.lit(0))).alias("shortfall"),
        )
        .join(games, scope)
    )
    expected = F.col("teams") * F.col("modal") / 2
    verdict = (
        F.when(F.col("low") == F.col("high"), "uniform").when(F.col("high") == F.col("modal"), "short-only").otherwise("unbalanced")
    )
    ok = (
        F.when(verdict == "uniform", F.col("games") == expected)
        .when(verdict == "short-only", F.col("shortfall") / 2 == expected - F.col("games"))
    )
    return stats.select(
        *scope, "teams", "games", "modal", "low", "high", "shortfall",
        (F.col("_sum") == 2 * F.col("games")).alias("identity_holds"),
        verdict.alias("verdict"), ok.alias("reconciles"),
    )


def division_counts(gm: DataFrame, keys: list[str]) -> DataFrame:
    """Division games per team, from game rows with ``is_division``."""
    side = F.explode(F.array("home_team", "away_team")).alias("team")
    return gm.select(*keys, "is_division", side).groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("games"), F.sum("is_division").alias("division_games")
    )


def residual_moments(df: DataFrame, col: str, split: str) -> DataFrame:
    """Moments per split and the deviation relative to the train split's."""
    m = df.groupBy(split).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("sd"),
        F.skewness(col).alias("skew"),
        F.kurtosis(col).alias("excess_kurtosis"),
    )
    base = m.filter(F.col(split) == "train").select(F.col("sd").alias("_base"))
    return m.crossJoin(F.broadcast(base)).withColumn("sd_ratio", F.col("sd") / F.col("_base")).drop("_base")  # one row


def cutoffs(tables: dict[str, DataFrame], day: str = "game_date") -> DataFrame:
    """Latest date, rows and newest season per table and league."""
    from pregame.operators.sets import union_all

    return union_all(
        [
            df.groupBy("league").agg(
                F.max(day).alias("data_as_of"), F.count(F.lit(1)).alias("rows"), F.max("season").alias("newest_season")
            ).withColumn("table", F.lit(name))
            for name, df in tables.items()
        ]
    )


def completeness_by_week(gm: DataFrame, cols: list[str], weeks: int = 4) -> DataFrame:
    """Share of complete rows in the first weeks beside the whole."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    early = F.col("week") <= weeks
    return gm.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(ok.cast("double")).alias("complete"),
        F.count_if(early).alias("early_rows"),
        F.avg(F.when(early, ok.cast("double"))).alias("early_complete"),
    )


def break_clusters(rested: DataFrame, scope: list[str], min_days: int) -> DataFrame:
    """Overlapping idle spans merged, with the teams idle and the cause.

    ``rested`` has ``rest_raw``. Spans are first reduced to one row per start day (latest end), so the
    merge runs over the calendar of a season and not over its rows.
    """
    gaps = rested.filter(F.col("rest_raw") > min_days).select(
        *scope, "team", F.date_sub("game_date", F.col("rest_raw")).alias("start"), F.col("game_date").alias("end")
    )
    days = gaps.groupBy(*scope, "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy(*scope).orderBy("start")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = days.withColumn("_new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))).withColumn(
        "cluster", F.sum("_new").over(w)
    )
    spans = gaps.select(*scope, "team", "start", F.col("end").alias("_end")).join(
        numbered.select(*scope, "start", "cluster"), [*scope, "start"]
    )
    merged = spans.groupBy(*scope, "cluster").agg(
        F.min("start").alias("idle_from"), F.max("_end").alias("idle_to"), F.countDistinct("team").alias("teams")
    )
    total = rested.groupBy(*scope).agg(F.countDistinct("team").alias("league_teams"))
    cause = (
        F.when(F.col("teams") >= F.col("league_teams") - 1, "league-wide break")
        .when(F.col("teams") <= 2, "excluded game or cancellation")
        .otherwise("partial break")
    )
    return merged.join(total, scope).withColumn("cause", cause)


def tie_share(gm: DataFrame, periods: list[str]) -> DataFrame:
    """Share of games level in each period; one pass, one row per period."""
    one = gm.agg(
        F.count(F.lit(1)).alias("games"),
        *[F.count_if(F.col(f"home_{p}") == F.col(f"away_{p}")).alias(p) for p in periods],
    )
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("ties")) for p in periods])
    return one.select("games", F.explode(rows).alias("r")).select(
        "r.period", "games", "r.ties", F.try_divide(F.col("r.ties"), F.col("games")).alias("share")
    )
