"""Streaming operators run over file streams of the given tables until everything is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators.ratings import EloParams
from pregame.plans.oracle import oracle
from pregame.plans.rating_queries import elo_ctes
from pregame.plans.recon_queries import pairing_sql
from pregame.plans.registry import query
from pregame.plans.util import r6, scratch
from pregame.sources import views
from pregame.streaming import pipelines as P


def _event_source(spark, sf_dir):
    return P.Source(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, "ts", "events.parquet")


def _typed(stream):
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark, sf_dir):
    return _typed(P.file_stream(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, "events.parquet"))


def _source(spark, df, name: str):
    """``df`` written as a table, to be streamed and closed."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return P.Source(spark, path, df.schema, "ts")


def _table_stream(spark, df, name: str, files_per_batch: int = P.WHOLE_SLICE):
    """``df`` written as a table and streamed back."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return P.file_stream(spark, path, df.schema, "*.parquet", files_per_batch)


@query(
    "stream_deduplication",
    "X-01",
    "SELECT user_id, event_type, COUNT(*) AS kept FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY ALL",
)
def _dedupe(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts"))
    s = _events(spark, sf_dir).select("user_id", "event_type", day.alias("day"), "ts")
    out = P.run_to_table(P.dedupe_results(s, ["user_id", "event_type", "day"], "ts", "2 days"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("kept"))


def _shuffled_slices(df, day: str, n: int, spread: int):
    """``n`` slices in order of arrival; a row arrives up to ``spread`` days after its day, in no order."""
    kept = df.withColumn("ts", F.col(day).cast("timestamp")).withColumn("arrival", F.unix_date(day) + F.pmod(F.col("game_id") * 7919, F.lit(spread)))
    first, last = kept.agg(F.min("arrival"), F.max("arrival")).first()
    step = ((last or 0) - (first or 0)) // n + 1
    return [kept.filter(F.floor((F.col("arrival") - F.lit(first)) / step) == k).drop("arrival") for k in range(n)]


@query(
    "stream_elo",
    "X-02 V-05",
    oracle(
        "decided",
        f", {elo_ctes(EloParams(), 'decided')} SELECT league, game_id, ROUND(hr, 6) AS home_elo, ROUND(ar, 6) AS away_elo, FALSE AS late FROM r WHERE n > 0",
        recursive=True,
    ),
)
def _elo(spark, sf_dir):
    gm = views.decided(spark, sf_dir).select("league", "season", "game_id", "game_date", "home_team", "away_team", "home_pts", "away_pts")
    slices = _shuffled_slices(gm, "game_date", 3, 30)
    out = P.run_in_slices(slices, lambda s: P.live_elo(s, EloParams(), "30 days"), stateful=True, ts="ts")
    return out.select("league", "game_id", r6("home_elo"), r6("away_elo"), "late")


def _season_slices(df):
    """Three time ranges; the second and third arrive after the state of the first was committed."""
    s = F.col("season")
    return [df.filter(s < 1996), df.filter((s >= 1996) & (s < 1998)), df.filter(s >= 1998)]


@query(
    "stream_form",
    "X-03 V-05",
    oracle(
        "team_games",
        """SELECT league, team, game_id, ROUND(CASE WHEN COUNT(*) OVER w = 5 THEN AVG(pts) OVER w END, 6) AS form FROM team_games
        WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    ),
)
def _form(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).select("league", "team", "season", "game_id", "game_date", "pts")
    out = P.run_in_slices(_season_slices(tg), lambda s: P.live_form(s, 5), stateful=True)
    return out.withColumn("form", r6("form")).drop("late")


@query(
    "stream_missing_results",
    "X-04 V-05",
    oracle("games", "SELECT game_id, CAST(EPOCH(game_date::TIMESTAMP) * 1000 AS BIGINT) AS kickoff_ms FROM games WHERE home_pts IS NULL"),
)
def _alarm(spark, sf_dir):
    gm = views.games(spark, sf_dir)
    day = F.col("game_date").cast("timestamp")
    fixture = gm.select("game_id", day.alias("ts"), F.lit("fixture").alias("kind"))
    result = gm.filter("home_pts IS NOT NULL").select("game_id", (day + F.expr("INTERVAL 3 HOURS")).alias("ts"), F.lit("result").alias("kind"))
    s = _source(spark, fixture.unionByName(result), "alarm")
    return P.run_to_end([s], lambda x: P.missing_result_alarm(x, 5, "1 hour"), stateful=True)


@query(
    "stream_copy_pairing",
    "X-05 V-05",
    oracle("copies", f", {pairing_sql('league')} SELECT league, pair, game_id, copy, copy_date, slot FROM paired", recursive=True),
)
def _pair(spark, sf_dir):
    c = views.copies(spark, sf_dir).select("league", "home_team", "away_team", "game_id", "copy", "copy_date")
    return P.run_in_slices(_shuffled_slices(c, "copy_date", 3, 10), lambda s: P.live_pairing(s, "10 days"), stateful=True, ts="ts")


@query(
    "stream_window_counts",
    "X-06",
    """WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * k) HOUR AS window_start FROM events, range(4) t(k))
    SELECT window_start, event_type, COUNT(*) AS rows, COUNT(*) FILTER (value > 50) AS violations FROM w GROUP BY ALL""",
)
def _windows(spark, sf_dir):
    out = P.run_to_end(
        [_event_source(spark, sf_dir)],
        lambda s: P.windowed_counts(_typed(s).withColumn("violates", F.col("value") > 50), "ts", ["event_type"], "1 day", "6 hours", "1 hour"),
    )
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "rows", "violations")


@query(
    "stream_sessions",
    "X-07",
    """WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS rows FROM s GROUP BY user_id, k""",
)
def _sessions(spark, sf_dir):
    out = P.run_to_end([_event_source(spark, sf_dir)], lambda s: P.sessions(_typed(s), "ts", ["user_id"], "6 hours", "1 hour"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "rows")


LATE_SQL = """, c AS (SELECT game_id, team, season, pts + CASE WHEN game_id % 3 = 0 THEN 1 ELSE 0 END AS pts, CASE WHEN game_id % 5 = 0 THEN 'X' ELSE wl END AS wl,
      season + game_id % 5 AS arrival FROM team_games WHERE game_id % 7 = 0),
    b AS (SELECT arrival, (SELECT MAX(season) FROM c x WHERE x.arrival < y.arrival) AS newest, ROW_NUMBER() OVER (ORDER BY arrival) - 1 AS batch FROM (SELECT DISTINCT arrival FROM c) y),
    late AS (SELECT c.*, batch FROM c JOIN b USING (arrival) WHERE season <= newest - 2)"""


def _late_corrections(spark, sf_dir):
    """Applied and late rows of a stream of corrections that arrive up to four seasons after their game, and the served table."""
    tg = views.team_games(spark, sf_dir).select("game_id", "team", "season", "pts", "wl")
    g = F.col("game_id")
    sent = tg.filter(g % 7 == 0).withColumns({"pts": F.col("pts") + F.when(g % 3 == 0, 1.0).otherwise(0.0), "wl": F.when(g % 5 == 0, "X").otherwise(F.col("wl")), "arrival": F.col("season") + g % 5})
    pool, path, base = (scratch(spark, f"corrections-{x}") for x in ("pool", "source", "split"))
    sent.write.partitionBy("arrival").parquet(pool)  # joined once, by all tasks
    fields = sent.drop("arrival").schema
    held = spark.read.schema(sent.schema).parquet(pool)
    for r in held.select("arrival").distinct().orderBy("arrival").collect():  # a handful of seasons
        held.filter(F.col("arrival") == r.arrival).select(*fields.names).write.mode("append").parquet(path)
        applied, late = P.split_late(P.file_stream(spark, path, fields, files_per_batch=P.WHOLE_SLICE), base=base)
    return tg, applied, late


@query(
    "stream_late_rows",
    "X-01",
    oracle("team_games", f"{LATE_SQL} SELECT game_id, team, season, pts, wl, batch FROM late"),
)
def _late(spark, sf_dir):
    return _late_corrections(spark, sf_dir)[2].select("game_id", "team", "season", "pts", "wl", "batch")


@query(
    "stream_late_drift",
    "X-01 D-01 D-02",
    oracle(
        "team_games",
        f"""{LATE_SQL}, df AS (SELECT l.season, concat_ws(',', CASE WHEN l.pts <> t.pts THEN 'pts' END, CASE WHEN l.wl <> t.wl THEN 'wl' END) AS changed
        FROM late l JOIN team_games t ON t.game_id = l.game_id AND t.team = l.team)
        SELECT season, changed, COUNT(*) AS rows FROM df WHERE changed <> '' GROUP BY ALL""",
    ),
)
def _late_drift(spark, sf_dir):
    served, _, late = _late_corrections(spark, sf_dir)
    diff = P.late_drift(late, served, ["game_id", "team"])
    return diff.groupBy("season", F.array_join("changed_columns", ",").alias("changed")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_applied_corrections",
    "X-01 X-08",
    oracle("team_games", f"{LATE_SQL} SELECT season, COUNT(*) AS rows, SUM(pts) AS pts FROM c WHERE (game_id, team) NOT IN (SELECT (game_id, team) FROM late) GROUP BY season"),
)
def _applied(spark, sf_dir):
    applied = _late_corrections(spark, sf_dir)[1]
    return applied.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum("pts").alias("pts"))


@query(
    "stream_upsert",
    "X-08 S-10",
    """SELECT user_id, event_type, ARG_MAX(value, ts) AS value FROM events GROUP BY user_id, event_type""",
)
def _upsert(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    ev = ev.repartition(6, "event_type", "user_id")
    s = _table_stream(spark, ev, "upsert", files_per_batch=2)
    out = P.upsert_batches(s, ["user_id", "event_type"], ["ts", "value"], "ts")
    return out.select("user_id", "event_type", "value")

