"""Table comparison, fingerprints and refresh outcomes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pregame.operators import drift
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.sources import views

KEYS = ["game_id", "team"]
DIFF_SQL = """sv AS (SELECT game_id, team, season, pts, CAST(opp_pts AS VARCHAR) AS opp_pts, wl FROM team_games WHERE game_id % 1000 <> 0),
    fr AS (SELECT game_id, team, season, pts + CASE WHEN game_id % 1000 = 2 THEN 1 ELSE 0 END AS pts, CAST(opp_pts AS VARCHAR) AS opp_pts,
           CASE WHEN game_id % 1000 = 3 THEN 'X' ELSE wl END AS wl FROM team_games WHERE game_id % 1000 <> 1),
    df AS (SELECT CAST(game_id AS DOUBLE) AS game_id, CAST(team AS DOUBLE) AS team, COALESCE(f.season, s.season) AS season,
    CASE WHEN s.wl IS NULL THEN 'added' WHEN f.wl IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN s.wl IS NULL OR f.wl IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f.pts <> s.pts THEN 'pts' END, CASE WHEN f.wl <> s.wl THEN 'wl' END) END AS changed
    FROM fr f FULL JOIN sv s USING (game_id, team) WHERE s.wl IS NULL OR f.wl IS NULL OR f.pts <> s.pts OR f.wl <> s.wl)"""


def _snapshots(spark, sf_dir):
    """A served table and a fresh one with added, removed and changed games; numbers spelt differently."""
    tg = views.team_games(spark, sf_dir).select(*KEYS, "season", "pts", "opp_pts", "wl")
    k = F.col("game_id") % 1000
    served = tg.filter(k != 0).withColumn("opp_pts", F.col("opp_pts").cast("string"))
    fresh = tg.filter(k != 1).withColumns(
        {
            "pts": F.col("pts") + F.when(k == 2, 1.0).otherwise(0.0),
            "wl": F.when(k == 3, "X").otherwise(F.col("wl")),
            "opp_pts": F.col("opp_pts").cast("int").cast("string"),
        }
    )
    return fresh, served


def _diff(spark, sf_dir):
    fresh, served = _snapshots(spark, sf_dir)
    out = drift.table_diff(fresh.drop("season"), served.drop("season"), KEYS)
    seasons = views.schedule(spark, sf_dir).select(F.col("game_id").cast("double").alias("game_id"), "season")
    return out.withColumns({"game_id": F.col("game_id").cast("double"), "team": F.col("team").cast("double")}).join(seasons, "game_id")


@query("table_diff", "D-01 F-28 U-02 U-03", oracle("team_games", f", {DIFF_SQL} SELECT game_id, team, change, changed FROM df"))
def _table_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select("game_id", "team", "change", F.array_join("changed_columns", ",").alias("changed"))


@query(
    "column_changes",
    "D-01",
    oracle("team_games", f""", {DIFF_SQL}, x AS (SELECT unnest(string_split(changed, ',')) AS c FROM df WHERE changed <> '') SELECT c AS "column", COUNT(*) AS rows FROM x GROUP BY c"""),
)
def _columns(spark, sf_dir):
    return drift.column_changes(_diff(spark, sf_dir))


@query(
    "diff_by_season",
    "D-02 L-06",
    oracle(
        "team_games",
        f", {DIFF_SQL} SELECT season, change, COUNT(*) AS rows, (list(DISTINCT game_id ORDER BY game_id))[1:8] AS examples FROM df GROUP BY ALL",
    ),
)
def _by_season(spark, sf_dir):
    return drift.diff_by_season(_diff(spark, sf_dir), "game_id")


def _catalogs(spark, sf_dir):
    fresh, served = _snapshots(spark, sf_dir)
    return drift.fingerprint(fresh, ["season"]), drift.fingerprint(served, ["season"])


@query(
    "table_fingerprints",
    "D-03",
    None,
)
def _fingerprint(spark, sf_dir):
    return drift.fingerprint(views.team_games(spark, sf_dir), ["league", "season"])


@query(
    "fingerprint_stability",
    "D-03",
    oracle("team_games", "SELECT league, season, COUNT(*) AS rows, TRUE AS same FROM team_games GROUP BY ALL"),
)
def _stability(spark, sf_dir):
    """The hash must not depend on row order, partitioning or the spelling of numbers."""
    tg = views.team_games(spark, sf_dir)
    a = drift.fingerprint(tg, ["league", "season"])
    other = tg.withColumn("pts", F.col("pts").cast("decimal(10,2)")).repartition(13, "opp")
    b = drift.fingerprint(other, ["league", "season"]).withColumnRenamed("hash", "hash_b").drop("rows")
    return a.join(b, ["league", "season"]).select("league", "season", "rows", (F.col("hash") == F.col("hash_b")).alias("same"))


@query(
    "catalog_comparison",
    "D-04",
    oracle(
        "team_games",
        f""", {DIFF_SQL} SELECT season, CASE WHEN NOT EXISTS (SELECT 1 FROM sv WHERE sv.season = df.season) THEN 'only_left'
        WHEN NOT EXISTS (SELECT 1 FROM fr WHERE fr.season = df.season) THEN 'only_right' ELSE 'differs' END AS state FROM df GROUP BY season""",
    ),
)
def _catalog(spark, sf_dir):
    a, b = _catalogs(spark, sf_dir)
    return drift.compare_catalogs(a, b, ["season"])


@query(
    "refresh_outcomes",
    "D-05",
    oracle(
        "played",
        """, b AS (SELECT league, MAX(game_date) AS was FROM played WHERE season < 2000 AND league <> 'MACHINERY' GROUP BY league),
        a AS (SELECT league, MAX(game_date) AS now FROM played WHERE season < CASE WHEN league = 'BUILDING' THEN 2000 ELSE 2001 END GROUP BY league)
        SELECT league, was, now, CASE WHEN league = 'FURNITURE' THEN 'carried' WHEN league = 'MACHINERY' THEN 'failed' WHEN was = now THEN 'unchanged' ELSE 'advanced' END AS outcome
        FROM b FULL JOIN a USING (league)""",
    ),
)
def _outcomes(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    last = F.max("game_date").alias("data_as_of")
    before = gm.filter("season < 2000 AND league <> 'MACHINERY'").groupBy("league").agg(last)
    after = gm.filter(F.col("season") < F.when(F.col("league") == "BUILDING", 2000).otherwise(2001)).groupBy("league").agg(last)
    failed = gm.filter("league IN ('FURNITURE', 'MACHINERY')").select("league").distinct()
    return drift.refresh_outcomes(before, after, failed)


@query(
    "corpus_fingerprint",
    "D-20",
    oracle("played", "SELECT league, COUNT(*) AS rows FROM played WHERE game_date <= DATE '1999-06-30' GROUP BY league"),
)
def _corpus(spark, sf_dir):
    gm = views.played(spark, sf_dir).select("league", "game_id", "game_date", "home_pts", "away_pts")
    return drift.corpus_fingerprint(gm, dt.date(1999, 6, 30), "league").drop("hash")
