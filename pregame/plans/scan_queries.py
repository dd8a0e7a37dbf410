"""Sources and sinks, on files Spark derives from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.operators import drift
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import scratch
from pregame.sources import files, views

SEASON_FILE = T.StructType(
    [
        T.StructField("league", T.StringType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("game_date", T.DateType()),
        T.StructField("team", T.IntegerType()),
        T.StructField("pts", T.DoubleType()),
    ]
)
_COLS = [f.name for f in SEASON_FILE]


def _season_files(spark, sf_dir: str) -> str:
    """Team-games written as one CSV folder per season."""
    path = scratch(spark, "seasons")
    tg = views.team_games(spark, sf_dir).select(*_COLS, "season")
    files.write_csv(tg, path, ["season"])
    return path


@query(
    "season_file_scan",
    "S-01 S-03",
    oracle("team_games", "SELECT league, game_id, game_date, team, pts, season AS file_season FROM team_games"),
)
def _scan_seasons(spark, sf_dir):
    df = files.scan_seasons(spark, _season_files(spark, sf_dir), SEASON_FILE)
    return files.with_season_from_path(df).drop("file")


@query(
    "lossless_game_file_scan",
    "S-02 F-07",
    oracle(
        "players",
        """SELECT LPAD(CAST(game_id AS VARCHAR), 10, '0') AS game_id, CAST(player_id AS VARCHAR) AS player_id,
        CASE WHEN mins IS NULL THEN '' ELSE CAST(CAST(mins AS BIGINT) AS VARCHAR) || ':30' END AS mins, NOT is_absent AS took_part FROM players""",
    ),
)
def _scan_games(spark, sf_dir):
    from pregame.functions.scalar import canon_id, has_value

    p = views.players(spark, sf_dir)
    clock = F.concat(F.col("mins").cast("bigint").cast("string"), F.lit(":30"))
    text = p.select(
        canon_id(F.col("game_id")).alias("game_id"),
        F.col("player_id").cast("string").alias("player_id"),
        F.coalesce(clock, F.lit("")).alias("mins"),
        (F.col("game_id") % 16).alias("bucket"),
    )
    path = scratch(spark, "boxes")
    files.write_csv(text, path, ["bucket"])
    back = files.scan_game_files(spark, path, ["game_id", "player_id", "mins"]).drop("file")
    return back.withColumn("took_part", has_value(F.col("mins")))


@query(
    "projection_scan",
    "S-04",
    "SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey",
)
def _projection(spark, sf_dir):
    df = files.scan_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return df.filter(F.col("l_quantity") > 25).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))


@query(
    "partitioned_table_sink",
    "S-06",
    oracle("played", "SELECT league, season, COUNT(*) AS games, SUM(home_pts) AS home_pts FROM played WHERE season = 1997 GROUP BY ALL"),
)
def _sink(spark, sf_dir):
    path = scratch(spark, "table")
    files.write_table(views.played(spark, sf_dir), path, ["league", "season"], ["game_date", "game_id"])
    back = spark.read.parquet(path).filter(F.col("season") == 1997)
    return back.groupBy("league", "season").agg(F.count(F.lit(1)).alias("games"), F.sum("home_pts").alias("home_pts"))


@query(
    "failure_log_scan",
    "S-07",
    oracle("fixtures", "SELECT LPAD(CAST(game_id AS VARCHAR), 10, '0') AS game_id, 'no lines' AS reason FROM fixtures"),
)
def _failure_log(spark, sf_dir):
    from pregame.functions.scalar import canon_id

    path = scratch(spark, "log")
    fx = views.fixtures(spark, sf_dir).select(canon_id(F.col("game_id")).alias("g"))
    twice = fx.unionByName(fx).select(F.concat_ws("\t", "g", F.lit("no lines")).alias("value"))
    twice.write.text(path)
    return files.scan_failure_log(spark, path)


@query(
    "manifest_windows",
    "S-08",
    oracle("team_games", "SELECT league, MAX(season) AS newest_season, [5, 10] AS windows FROM team_games GROUP BY league"),
)
def _manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    tg = views.team_games(spark, sf_dir).groupBy("league").agg(F.max("season").alias("newest_season"))
    doc = tg.select(F.to_json(F.struct("league", "newest_season", F.array(F.lit(5), F.lit(10)).alias("windows"))).alias("value"))
    doc.write.text(path)
    schema = T.StructType(
        [
            T.StructField("league", T.StringType()),
            T.StructField("newest_season", T.IntegerType()),
            T.StructField("windows", T.ArrayType(T.IntegerType())),
        ]
    )
    # One line per league is one document per row, so the multi-line option is not needed here.
    return spark.read.schema(schema).json(path)


def manifest_of(spark, sf_dir: str) -> dict:
    """One manifest document derived from the tables, read back on the driver."""
    path = scratch(spark, "manifest")
    one = views.played(spark, sf_dir).agg(F.max("season").alias("newest"), F.min("season").alias("oldest"))
    one.select(F.to_json(F.struct("newest", "oldest")).alias("value")).coalesce(1).write.text(path)
    found = files.read_manifest(spark, f"{path}/part-*")
    return json.loads(json.dumps(found))


@query(
    "fixture_store_upsert",
    "S-10",
    oracle(
        "games",
        """, old AS (SELECT home_team, away_team, game_date, MIN(priority) AS priority FROM games WHERE game_id % 3 <> 0 GROUP BY ALL),
        inc AS (SELECT home_team, away_team, game_date, MAX(CASE WHEN game_id % 7 = 0 THEN '1-URGENT' ELSE priority END) AS priority
                FROM games WHERE game_id % 2 = 0 GROUP BY ALL)
        SELECT home_team, away_team, game_date,
        CASE WHEN i.priority IS NULL THEN 'kept' WHEN home_team = 24 OR away_team = 24 THEN 'skipped' WHEN o.priority IS NULL THEN 'insert'
             WHEN i.priority = o.priority THEN 'unchanged' ELSE 'update' END AS action,
        CASE WHEN i.priority IS NULL OR home_team = 24 OR away_team = 24 THEN o.priority ELSE i.priority END AS priority
        FROM old o FULL JOIN inc i USING (home_team, away_team, game_date)""",
    ),
)
def _upsert(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    keys = ["home_team", "away_team", "game_date"]
    old = gm.filter(F.col("game_id") % 3 != 0).groupBy(*keys).agg(F.min("priority").alias("priority"))
    new_priority = F.when(F.col("game_id") % 7 == 0, "1-URGENT").otherwise(F.col("priority"))
    inc = gm.filter(F.col("game_id") % 2 == 0).groupBy(*keys).agg(F.max(new_priority).alias("priority"))
    known = views.arenas(spark, sf_dir).select("team").filter(F.col("team") != 24)
    return drift.upsert_fixtures(old, inc, known, keys, ["priority"])
