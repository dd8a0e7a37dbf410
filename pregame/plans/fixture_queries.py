"""Fixture dependency, freshness, as-of reads and injury availability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pregame.functions.udtf import register
from pregame.operators import asof, fixtures, rolling
from pregame.operators.ratings import EloParams
from pregame.plans.feature_queries import _PW, _mean_sql
from pregame.plans.oracle import oracle
from pregame.plans.projection_queries import KICK_SQL, with_kickoff
from pregame.plans.rating_queries import elo_ctes
from pregame.plans.registry import query
from pregame.plans.util import TEAM, TEAM_SEASON, WEEK_SQL, r6, with_week
from pregame.sources import views

LEAGUE = ["league"]


@query(
    "elo_table_function",
    "V-03",
    oracle(
        "decided",
        f", {elo_ctes(EloParams(), 'decided')} SELECT league, game_id, ROUND(hr, 6) AS home_elo, ROUND(ar, 6) AS away_elo FROM r WHERE n > 0",
        recursive=True,
    ),
)
def _udtf(spark, sf_dir):
    register(spark)
    gm = views.decided(spark, sf_dir).select("league", "game_id", "season", "game_date", "home_team", "away_team", "home_pts", "away_pts")
    gm.createOrReplaceTempView("pregame_decided")
    out = spark.sql("SELECT * FROM elo(TABLE(pregame_decided))")
    return out.select("league", "game_id", r6("home_elo"), r6("away_elo"))


_FIRST = "ROW_NUMBER() OVER (PARTITION BY league, team ORDER BY game_date, game_id)"


@query(
    "predictable_fixtures",
    "D-06",
    oracle(
        "fixtures fixture_sides",
        f""", f AS (SELECT game_id, {_FIRST} AS n FROM fixture_sides)
        SELECT game_id, MAX(n) = 1 AS predictable FROM f GROUP BY game_id""",
    ),
)
def _predictable(spark, sf_dir):
    return fixtures.predictable(views.fixtures(spark, sf_dir), LEAGUE).select("game_id", "predictable")


@query(
    "blocking_fixtures",
    "D-07",
    oracle(
        "fixture_sides",
        """, f AS (SELECT *, FIRST_VALUE(game_id) OVER w AS blocked_by, FIRST_VALUE(game_date) OVER w AS blocked_by_date FROM fixture_sides
        WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT league, game_id, game_date, side, team, blocked_by, blocked_by_date FROM f WHERE blocked_by IS NOT NULL""",
    ),
)
def _blocking(spark, sf_dir):
    return fixtures.blocking(views.fixtures(spark, sf_dir), LEAGUE)


CUT = dt.date(1997, 6, 1)


@query(
    "fixture_status",
    "D-08",
    oracle(
        "fixtures fixture_sides team_games",
        """, h AS (SELECT * FROM team_games WHERE game_date < DATE '1997-06-01' AND team <> 24 AND NOT (team = 3 AND league = 'BUILDING')),
        sp AS (SELECT league, team, MIN(game_date) AS f FROM h GROUP BY ALL), cu AS (SELECT league, MAX(game_date) AS c FROM h GROUP BY ALL),
        pd AS (SELECT s.league, s.game_id, s.side, s.team, s.game_date, f, c, (SELECT COUNT(DISTINCT o.game_date) FROM fixture_sides o
               WHERE o.league = s.league AND o.team = s.team AND o.game_date < s.game_date) AS pending
               FROM fixture_sides s LEFT JOIN sp USING (league, team) LEFT JOIN cu USING (league)),
        co AS (SELECT *, CASE WHEN COALESCE(f >= game_date, TRUE) THEN 'season_opener' WHEN pending > 0 THEN 'previous_game_pending' END AS code FROM pd),
        pg AS (SELECT game_id, COUNT(*) FILTER (f IS NULL) AS unknown, MAX(c) AS c, MAX(game_date) AS d,
               COALESCE(string_agg(side || ':' || code || ':' || CASE WHEN code = 'season_opener' THEN 0 ELSE pending END, ',' ORDER BY side DESC) FILTER (code IS NOT NULL), '') AS b,
               (list(code ORDER BY side DESC) FILTER (code IS NOT NULL))[1] AS first_code FROM co GROUP BY game_id)
        SELECT game_id, CASE WHEN unknown > 0 THEN 'unknown_team' WHEN d <= c THEN 'date_out_of_range' ELSE COALESCE(first_code, 'ok') END AS status_code,
        CASE WHEN unknown > 0 OR d <= c THEN '' ELSE b END AS blocked FROM pg""",
    ),
)
def _status(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).filter(F.col("game_date") < F.lit(CUT))
    history = tg.filter((F.col("team") != 24) & ~((F.col("team") == 3) & (F.col("league") == "BUILDING")))
    out = fixtures.fixture_status(views.fixtures(spark, sf_dir), history, LEAGUE)
    text = F.transform("blocked_by", lambda x: F.concat_ws(":", x["side"], x["code"], F.size(x["pending"]).cast("string")))
    return out.select("game_id", "status_code", F.array_join(text, ",").alias("blocked"))


@query(
    "dependency_report",
    "D-10",
    oracle(
        "fixtures",
        f""", w AS (SELECT league, season, game_id, home_team, away_team, {WEEK_SQL} AS week FROM fixtures),
        s AS (SELECT league, season, game_id, week, home_team AS team FROM w UNION ALL SELECT league, season, game_id, week, away_team FROM w),
        f AS (SELECT *, MIN(week) OVER (PARTITION BY league, season, team) AS fw FROM s),
        g AS (SELECT league, season, game_id, week, BOOL_AND(fw = week) AS ready FROM f GROUP BY ALL)
        SELECT league, season, week, COUNT(*) FILTER (ready) AS predictable, COUNT(*) FILTER (NOT ready) AS waiting FROM g GROUP BY ALL""",
    ),
)
def _dependency(spark, sf_dir):
    return fixtures.dependency_report(with_week(views.fixtures(spark, sf_dir)), ["league", "season"])


NOW = dt.datetime(1998, 3, 2, 4, 0, 0)
LATE_SQL = f"""k AS (SELECT *, CASE WHEN game_id % 5 <> 0 THEN {KICK_SQL} END AS kick FROM fixtures WHERE game_id % 3 <> 0),
    late AS (SELECT * FROM k WHERE CASE WHEN kick IS NOT NULL THEN EPOCH(kick) <= EPOCH(TIMESTAMP '1998-03-01 23:00:00') ELSE DATE '1998-03-02' - game_date > 1 END)"""


def _late(spark, sf_dir):
    fx = with_kickoff(views.fixtures(spark, sf_dir))
    arrived = fx.filter(F.col("game_id") % 3 == 0).select("game_id")
    return fixtures.missing_results(fx, arrived, NOW)


@query("missing_results", "D-11", oracle("fixtures", f", {LATE_SQL} SELECT league, game_id FROM late"))
def _missing(spark, sf_dir):
    return _late(spark, sf_dir).select("league", "game_id")


@query(
    "missing_results_by_day",
    "D-11 F-16",
    oracle(
        "fixtures",
        """SELECT league, game_id FROM fixtures WHERE game_id % 3 <> 0
        AND EPOCH(timezone('America/Los_Angeles', game_date::TIMESTAMP + INTERVAL 1 DAY)) + 6 * 3600 <= EPOCH(TIMESTAMP '1998-03-02 04:00:00')""",
    ),
)
def _missing_day(spark, sf_dir):
    fx = views.fixtures(spark, sf_dir)
    arrived = fx.filter(F.col("game_id") % 3 == 0).select("game_id")
    return fixtures.missing_results_by_day(fx, arrived, NOW).select("league", "game_id")


TODAY = dt.date(2001, 8, 5)


@query(
    "freshness",
    "D-12",
    oracle(
        "fixtures played",
        f""", {LATE_SQL}, a AS (SELECT league, MAX(game_date) AS data_as_of FROM played GROUP BY league), n AS (SELECT league, COUNT(*) AS late FROM late GROUP BY league)
        SELECT league, data_as_of, CAST(DATE '2001-08-05' - data_as_of AS INT) AS days_behind, DATE '2001-08-05' - data_as_of > 2 AS stale_by_age,
        COALESCE(late, 0) AS late, COALESCE(late, 0) > 0 AS stale FROM a LEFT JOIN n USING (league)""",
    ),
)
def _freshness(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    age = fixtures.freshness(gm, LEAGUE, TODAY).select("league", F.col("stale").alias("stale_by_age"))
    by_missing = fixtures.freshness_by_missing(gm, _late(spark, sf_dir), LEAGUE, TODAY)
    return by_missing.join(age, "league")


@query(
    "season_state",
    "D-13",
    oracle(
        "games",
        """SELECT league, season, MIN(game_date) AS first_game, CASE WHEN MIN(game_date) > DATE '2000-08-01' THEN 'not_started' ELSE 'started' END AS verdict
        FROM games GROUP BY ALL""",
    ),
)
def _season_state(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    return fixtures.season_state(gm, ["league", "season"], dt.date(2000, 8, 1), dt.date(2000, 10, 1))


@query("open_seasons", "D-14", oracle("games", "SELECT season, COUNT(*) AS games FROM games WHERE season >= 1999 GROUP BY season"))
def _open(spark, sf_dir):
    out = fixtures.open_seasons(views.schedule(spark, sf_dir), dt.date(2000, 10, 1), 8)
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "season_coverage",
    "D-19",
    oracle(
        "games played",
        """SELECT 'schedule' AS "table", league, MAX(season) AS newest_season, 2000 AS calendar_season, MAX(season) = 2000 AS covered FROM games GROUP BY league
        UNION ALL SELECT 'played', league, MAX(season), 2000, MAX(season) = 2000 FROM played WHERE season < 2001 GROUP BY league""",
    ),
)
def _coverage(spark, sf_dir):
    tables = {"schedule": views.schedule(spark, sf_dir), "played": views.played(spark, sf_dir).filter("season < 2001")}
    return fixtures.season_coverage(tables, dt.date(2000, 11, 5), 8)


@query(
    "full_window_dates",
    "W-23",
    oracle(
        "fixture_sides team_games",
        """, p AS (SELECT league, team, COUNT(*) % 4 AS have FROM team_games GROUP BY ALL),
        s AS (SELECT f.*, COALESCE(have, 0) AS have FROM fixture_sides f LEFT JOIN p USING (league, team)),
        k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY league, team ORDER BY game_date, game_id) AS rk FROM s),
        r AS (SELECT league, team, MIN(game_date) AS reach FROM k WHERE rk = 3 - have GROUP BY ALL)
        SELECT league, game_id, MAX(GREATEST(3 - have, 0)) AS short,
        CASE WHEN COUNT(*) FILTER (have < 3 AND reach IS NULL) = 0 THEN MAX(CASE WHEN have < 3 THEN reach END) END AS full_window_date
        FROM s LEFT JOIN r USING (league, team) GROUP BY ALL""",
    ),
)
def _full_window(spark, sf_dir):
    have = views.team_games(spark, sf_dir).groupBy("league", "team").agg((F.count(F.lit(1)) % 4).alias("played"))
    return fixtures.full_window_date(views.fixture_sides(spark, sf_dir), have, LEAGUE, 3)


# ---- as-of --------------------------------------------------------------------------------------

FORM_SQL = """st AS (SELECT *, CASE WHEN COUNT(pts) OVER w = 5 THEN AVG(pts) OVER w END AS form5_pts, CASE WHEN COUNT(opp_pts) OVER w = 5 THEN AVG(opp_pts) OVER w END AS form5_opp_pts
    FROM team_games WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    ff AS (SELECT f.league, f.season, f.game_id, f.game_date, f.team, f.side, s.game_date AS as_of, form5_pts, form5_opp_pts FROM fixture_sides f
    LEFT JOIN st s ON s.league = f.league AND s.team = f.team AND s.game_date < f.game_date
    QUALIFY ROW_NUMBER() OVER (PARTITION BY f.game_id, f.side ORDER BY s.game_date DESC, s.game_id DESC) = 1)"""


def fixture_form(spark, sf_dir):
    return asof.fixture_form(
        views.fixture_sides(spark, sf_dir), views.team_games(spark, sf_dir), TEAM, ["pts", "opp_pts"], 5
    )


@query(
    "fixture_form",
    "J-11",
    oracle("fixture_sides team_games", f", {FORM_SQL} SELECT game_id, side, team, as_of, ROUND(form5_pts, 6) AS form5_pts, ROUND(form5_opp_pts, 6) AS form5_opp_pts FROM ff"),
)
def _form(spark, sf_dir):
    return fixture_form(spark, sf_dir).select("game_id", "side", "team", "as_of", r6("form5_pts"), r6("form5_opp_pts"))


@query(
    "fixture_features",
    "M-16",
    oracle(
        "fixture_sides team_games",
        f""", {FORM_SQL} SELECT game_id, {', '.join(f"ROUND(MAX(form5_{c}) FILTER (side = '{s}'), 6) AS {s}_form5_{c}" for s in ('home', 'away') for c in ('pts', 'opp_pts'))},
        CAST(COUNT(*) FILTER (form5_pts IS NULL) * 2 AS INT) AS missing FROM ff GROUP BY game_id""",
    ),
)
def _features(spark, sf_dir):
    names = ["form5_pts", "form5_opp_pts"]
    out = asof.assemble_fixture_features(views.fixtures(spark, sf_dir).select("game_id"), fixture_form(spark, sf_dir), names)
    declared = [f"{s}_{c}" for s in ("home", "away") for c in names]
    return out.select("game_id", *[r6(c) for c in declared], F.size("missing").alias("missing"))


@query(
    "current_roster",
    "J-12",
    oracle(
        "players",
        """, l AS (SELECT * FROM players WHERE game_date < DATE '1999-01-15' QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) = 1)
        SELECT player_id, league, team, game_id, game_date FROM l WHERE season = 1998 AND mins IS NOT NULL""",
    ),
)
def _roster(spark, sf_dir):
    out = asof.current_roster(views.players(spark, sf_dir), dt.date(1999, 1, 15), 1998, "mins")
    return out.select("player_id", "league", "team", "game_id", "game_date")


MINUTES_SQL = f"""app AS (SELECT player_id, season, game_id, {_mean_sql('mins', 5, _PW, 'a_mins').replace('ROUND(', '(').replace(', 6)', ')')} FROM players WHERE NOT is_absent),
    ff AS (SELECT p.*, LAST_VALUE(a_mins IGNORE NULLS) OVER w AS roll5_mins FROM players p LEFT JOIN app USING (player_id, season, game_id)
    WINDOW w AS (PARTITION BY p.player_id, p.season ORDER BY p.game_date, p.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    tm AS (SELECT player_id, MAX_BY(roll5_mins, (game_date, game_id)) AS roll_mins, MAX(game_date) AS last_game FROM ff
    WHERE season = 1998 AND game_date < DATE '1999-01-15' AND roll5_mins IS NOT NULL GROUP BY player_id)"""


def trailing_minutes(spark, sf_dir):
    p = views.players(spark, sf_dir).withColumn("played", ~F.col("is_absent"))
    rolled = rolling.trailing_appearance_mean(p, ["player_id", "season"], "played", ["mins"], 5)
    known = rolled.filter(F.col("roll5_mins").isNotNull())
    out = asof.trailing_minutes_asof(known, 1998, dt.date(1999, 1, 15), "roll5_mins")
    return out.withColumnRenamed("roll5_mins", "roll_mins")


@query("trailing_minutes_as_of", "D-18", oracle("players", f", {MINUTES_SQL} SELECT player_id, ROUND(roll_mins, 6) AS roll_mins, last_game FROM tm"))
def _minutes(spark, sf_dir):
    return trailing_minutes(spark, sf_dir).select("player_id", r6("roll_mins"), "last_game")


# ---- injury reports -----------------------------------------------------------------------------

STATUSES = {"Out": True, "Doubtful": True, "Questionable": False, "Probable": False, "Available": False}
_STATUS_SQL = "CASE s_suppkey % 5 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' WHEN 2 THEN 'Questionable' WHEN 3 THEN 'Probable' ELSE 'Available' END"
REPORT_SQL = f"""rep AS (SELECT CAST(s_nationkey AS INT) AS team, s_suppkey AS player_id, {_STATUS_SQL} AS report_status FROM supplier WHERE s_nationkey % 6 <> 0
    UNION ALL SELECT CAST(n_nationkey AS INT), NULL, NULL FROM nation WHERE n_nationkey % 6 = 0),
    sp AS (SELECT *, player_id IS NULL AS pending, CASE WHEN player_id IS NOT NULL THEN report_status IN ('Out', 'Doubtful') END AS absent FROM rep)"""


def injury_report(spark, sf_dir):
    """One row per supplier as a player; every sixth team's report is pending."""
    s = views.table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") % 6 != 0)
    names = list(STATUSES)
    status = F.get(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % 5).cast("int"))
    real = s.select(F.col("s_nationkey").cast("int").alias("team"), F.col("s_suppkey").alias("player_id"), status.alias("report_status"))
    n = views.table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 6 == 0)
    pending = n.select(
        F.col("n_nationkey").cast("int").alias("team"), F.lit(None).cast("bigint").alias("player_id"), F.lit(None).cast("string").alias("report_status")
    )
    return asof.split_report(real.unionByName(pending), STATUSES)


@query("injury_report_rows", "D-16 P-09", oracle("", f"WITH {REPORT_SQL} SELECT team, player_id, pending, absent FROM sp"))
def _report(spark, sf_dir):
    return injury_report(spark, sf_dir).select("team", "player_id", "pending", "absent")


@query(
    "live_availability",
    "D-15",
    oracle(
        "players",
        f""", {MINUTES_SQL}, {REPORT_SQL} SELECT team, BOOL_OR(pending) AS pending, CASE WHEN NOT BOOL_OR(pending) THEN COUNT(*) FILTER (COALESCE(absent, FALSE)) END AS absent,
        CASE WHEN NOT BOOL_OR(pending) THEN ROUND(SUM(CASE WHEN absent THEN COALESCE(roll_mins, 0) ELSE 0 END), 6) END AS absent_minutes
        FROM sp LEFT JOIN tm USING (player_id) GROUP BY team""",
    ),
)
def _availability(spark, sf_dir):
    out = asof.live_availability(injury_report(spark, sf_dir), trailing_minutes(spark, sf_dir), ["team"])
    return out.select("team", "pending", "absent", r6("absent_minutes"))


@query(
    "latest_report",
    "D-17",
    """WITH s AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS slot FROM events)
    SELECT user_id, event_id, slot FROM s WHERE slot <= TIMESTAMP '2024-01-15 12:07:00' AND slot >= TIMESTAMP '2024-01-15 00:07:00'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY slot DESC, ts DESC) = 1""",
)
def _latest(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = asof.latest_report(ev, dt.datetime(2024, 1, 15, 12, 7), ["user_id"])
    return out.select("user_id", "event_id", F.col("slot").cast("timestamp_ntz").alias("slot"))
