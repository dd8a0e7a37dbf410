"""The engine's input tables, derived from the driver tables (see FIXTURES.md section 2).

A game is an order, a league is a market segment, a team is a nation within a league. The SQL twin
of every view is in ``pregame.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.functions.scalar import canon_id, season_from_date

SEASON_START_MONTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of both sides per order: odd lines score for the home side, even lines for the away side."""
    odd = F.col("l_linenumber") % 2 == 1
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.when(odd, F.col("l_quantity")).otherwise(0.0)).alias("home_pts"),
            F.sum(F.when(odd, 0.0).otherwise(F.col("l_quantity"))).alias("away_pts"),
        )
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every game without its score."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    home = F.col("c_nationkey").cast("int")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("game_id"),
        F.col("c_mktsegment").alias("league"),
        F.to_date("o_orderdate").alias("game_date"),
        season_from_date(F.to_date("o_orderdate"), SEASON_START_MONTH).alias("season"),
        home.alias("home_team"),
        ((home + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away_team"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game; ``home_pts`` is NULL for an unplayed fixture."""
    pts = game_points(spark, sf_dir)
    gm = schedule(spark, sf_dir)
    return gm.join(pts, gm["game_id"] == pts["l_orderkey"], "left").drop("l_orderkey")


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).filter(F.col("home_pts").isNotNull())


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played games without a tie."""
    return played(spark, sf_dir).filter(F.col("home_pts") != F.col("away_pts"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games still without a result: orders that have no line (an anti join, no aggregation)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    gm = schedule(spark, sf_dir)
    return gm.join(lines, gm["game_id"] == lines["l_orderkey"], "left_anti")


def result_letter(own: Column, other: Column) -> Column:
    return F.when(own > other, "W").when(own < other, "L").otherwise("T")


def sides(gm: DataFrame, keep: list[str]) -> DataFrame:
    """Game rows to one row per side, in a single pass over the games."""
    home = F.struct(
        F.col("home_team").alias("team"),
        F.col("away_team").alias("opp"),
        F.lit(True).alias("is_home"),
        F.col("home_pts").alias("pts"),
        F.col("away_pts").alias("opp_pts"),
    )
    away = F.struct(
        F.col("away_team").alias("team"),
        F.col("home_team").alias("opp"),
        F.lit(False).alias("is_home"),
        F.col("away_pts").alias("pts"),
        F.col("home_pts").alias("opp_pts"),
    )
    return gm.select(*keep, F.explode(F.array(home, away)).alias("s")).select(*keep, "s.*")


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per played game."""
    tg = sides(played(spark, sf_dir), ["league", "season", "game_id", "game_date"])
    return tg.withColumn("wl", result_letter(F.col("pts"), F.col("opp_pts")))


def fixture_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per unplayed fixture."""
    fx = fixtures(spark, sf_dir)
    home = F.struct(F.col("home_team").alias("team"), F.lit("home").alias("side"))
    away = F.struct(F.col("away_team").alias("team"), F.lit("away").alias("side"))
    keep = ["league", "season", "game_id", "game_date"]
    return fx.select(*keep, F.explode(F.array(home, away)).alias("s")).select(*keep, "s.*")


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team-games as a provider would send them: text id, matchup text, stated margin."""
    tg = team_games(spark, sf_dir)
    sep = F.when(F.col("is_home"), " vs. T").otherwise(" @ T")
    return tg.select(
        "league",
        "season",
        "game_date",
        "team",
        canon_id(F.col("game_id")).alias("raw_id"),
        F.concat(F.lit("T"), F.col("team").cast("string"), sep, F.col("opp").cast("string")).alias("matchup"),
        "wl",
        "pts",
        F.when(F.col("game_id") % 17 == 0, F.col("pts") - F.col("opp_pts") + 1)
        .otherwise(F.col("pts") - F.col("opp_pts"))
        .alias("plus_minus"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-games: lines of one order and supplier; absent when every line is returned."""
    orders = schedule(spark, sf_dir).select("game_id", "league", "season", "game_date")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("team"))
    box = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.bool_and(F.col("l_returnflag") == "R").alias("is_absent"),
            F.sum("l_quantity").alias("mins"),
            F.sum((F.col("l_partkey") % 30).cast("double")).alias("pts"),
            F.sum(F.round(F.col("l_discount") * 100)).alias("reb"),
            F.sum(F.round(F.col("l_tax") * 100)).alias("ast"),
        )
    )
    stats = ["mins", "pts", "reb", "ast"]
    return (
        box.join(orders, box["l_orderkey"] == orders["game_id"])
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "league",
            "season",
            "game_id",
            "game_date",
            "team",
            F.col("l_suppkey").alias("player_id"),
            "is_absent",
            *[F.when(~F.col("is_absent"), F.col(c)).alias(c) for c in stats],
        )
    )


def quarter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per side and quarter: quarter = line number modulo 4, side = odd or even line."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    home = n % 2 == 1
    cols = []
    for side, own in (("home", home), ("away", ~home)):
        for q in range(1, 5):
            hit = own & (F.floor((n - 1) / 2) % 4 == q - 1)
            cols.append(F.sum(F.when(hit, F.col("l_quantity")).otherwise(0.0)).alias(f"{side}_q{q}"))
    box = lines.groupBy(F.col("l_orderkey").alias("game_id")).agg(*cols)
    return played(spark, sf_dir).join(box, "game_id")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts: zone = line number, made when not returned, type from the line status."""
    orders = schedule(spark, sf_dir).select("game_id", "league", "season", "home_team", "away_team")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("game_id")).select(
        "league",
        "season",
        "game_id",
        F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        F.concat(F.lit("Z"), F.col("l_linenumber").cast("string")).alias("zone"),
        F.when(F.col("l_linestatus") == "O", "3PT").otherwise("2PT").alias("shot_type"),
        (F.col("l_returnflag") == "N").cast("int").alias("made"),
    )


def arenas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home venue of a team: coordinates and time zone."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("int").alias("team"),
        F.col("n_name").alias("arena"),
        (k + 25).cast("double").alias("lat"),
        (k * 2 - 125).cast("double").alias("lon"),
        F.when(k % 4 == 0, "America/New_York")
        .when(k % 4 == 1, "America/Chicago")
        .when(k % 4 == 2, "America/Denver")
        .otherwise("America/Phoenix")
        .alias("zone"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two articles' copies of each played game: copy B may be a day late or have another away score."""
    gm = played(spark, sf_dir)
    a = F.struct(F.lit("A").alias("copy"), F.col("game_date").alias("copy_date"), F.col("away_pts").alias("copy_away"))
    b = F.struct(
        F.lit("B").alias("copy"),
        F.date_add(F.col("game_date"), (F.col("game_id") % 2).cast("int")).alias("copy_date"),
        F.when(F.col("game_id") % 97 == 0, F.col("away_pts") + 1).otherwise(F.col("away_pts")).alias("copy_away"),
    )
    both = F.when(F.col("game_id") % 89 == 0, F.array(a)).otherwise(F.array(a, b))
    keep = ["league", "season", "game_id", "home_team", "away_team", "home_pts"]
    return gm.select(*keep, F.explode(both).alias("c")).select(*keep, "c.*")


def ended_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided games with an end type; an overtime game ends one point apart."""
    gm = decided(spark, sf_dir)
    end = F.when(F.col("game_id") % 11 == 0, "OT").when(F.col("game_id") % 13 == 0, "SO").otherwise("REG")
    home_wins = F.col("home_pts") > F.col("away_pts")
    close = F.col("game_id") % 11 != 0
    close = close & (F.col("game_id") % 13 != 0)
    return gm.select(
        "league",
        "season",
        "game_id",
        "game_date",
        "home_team",
        "away_team",
        F.when(close, F.col("home_pts"))
        .when(home_wins, F.col("away_pts") + 1)
        .otherwise(F.col("home_pts"))
        .alias("home_pts"),
        F.when(close, F.col("away_pts"))
        .when(home_wins, F.col("away_pts"))
        .otherwise(F.col("home_pts") + 1)
        .alias("away_pts"),
        end.alias("game_end"),
    )
