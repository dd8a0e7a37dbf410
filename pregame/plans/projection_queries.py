"""Projections, labels, filters and status columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pregame.functions.scalar import kickoff_utc
from pregame.operators import joins, projections, rolling
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import TEAM_SEASON, WEEK_SQL, r6, with_week
from pregame.sources import views


@query(
    "home_flag_and_ids",
    "P-01 P-02 P-03",
    oracle(
        "raw_games",
        """SELECT raw_id, team, CONTAINS(matchup, 'vs.') AS is_home, CAST(raw_id AS BIGINT) AS id_number, SUBSTR(raw_id, 3, 1) AS digit
        FROM raw_games WHERE SUBSTR(raw_id, 3, 1) = '0'""",
    ),
)
def _home_flag(spark, sf_dir):
    from pregame.functions.scalar import id_number, type_digit

    raw = projections.with_is_home(views.raw_games(spark, sf_dir))
    raw = projections.only_competition(raw, "0", "raw_id")
    return raw.select(
        "raw_id", "team", "is_home", id_number(F.col("raw_id")).alias("id_number"), type_digit(F.col("raw_id")).alias("digit")
    )


@query(
    "prefix_and_keep_columns",
    "P-04 P-05",
    oracle("team_games", "SELECT game_id, pts AS home_pts, opp_pts AS home_opp_pts FROM team_games WHERE is_home"),
)
def _prefix(spark, sf_dir):
    home = views.team_games(spark, sf_dir).filter("is_home")
    return projections.keep_columns(projections.prefix_columns(home, "home", ["game_id"]), ["game_id", r"home_(opp_)?pts"])


@query(
    "game_labels",
    "P-06",
    oracle(
        "games",
        """SELECT game_id, home_pts - away_pts AS margin, home_pts + away_pts AS total,
        CASE WHEN home_pts <> away_pts THEN CAST(home_pts > away_pts AS INT) END AS home_win FROM games""",
    ),
)
def _labels(spark, sf_dir):
    return projections.with_game_labels(views.games(spark, sf_dir)).select("game_id", "margin", "total", "home_win")


@query(
    "period_labels",
    "P-07",
    oracle(
        "quarter_scores",
        """SELECT game_id, home_q1 - away_q1 AS q1_margin, home_q1 + away_q1 AS q1_total,
        CASE WHEN home_q1 <> away_q1 THEN CAST(home_q1 > away_q1 AS INT) END AS q1_home_win FROM quarter_scores""",
    ),
)
def _period_labels(spark, sf_dir):
    out = projections.with_period_labels(views.quarter_scores(spark, sf_dir), "q1")
    return out.select("game_id", "q1_margin", "q1_total", "q1_home_win")


@query(
    "category_exclusion_and_mapping",
    "P-08 P-09",
    oracle(
        "shots",
        """SELECT zone, shot_type, COUNT(*) AS shots, SUM(CASE shot_type WHEN '3PT' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS value
        FROM shots WHERE zone <> 'Z7' GROUP BY ALL""",
    ),
)
def _category(spark, sf_dir):
    kept = projections.drop_category(views.shots(spark, sf_dir), "zone", "Z7")
    value = projections.map_strict(F.col("shot_type"), {"3PT": 1.5, "2PT": 1.0})
    return kept.groupBy("zone", "shot_type").agg(F.count(F.lit(1)).alias("shots"), F.sum(value).alias("value"))


@query(
    "complete_cases",
    "P-10",
    oracle(
        "players",
        "SELECT COUNT(*) FILTER (mins IS NOT NULL AND reb IS NOT NULL) AS kept, COUNT(*) FILTER (mins IS NULL OR reb IS NULL) AS dropped FROM players",
    ),
)
def _complete(spark, sf_dir):
    return projections.complete_case_counts(views.players(spark, sf_dir), ["mins", "reb"])


@query(
    "relocations",
    "P-11",
    oracle(
        "team_games",
        """, s AS (SELECT *, CASE WHEN team = 3 AND season <= 1996 THEN 103 ELSE team END AS club FROM team_games WHERE NOT (team = 3 AND season = 1997))
        SELECT CASE WHEN club = 103 THEN 3 ELSE club END AS club, season, COUNT(*) AS games FROM s GROUP BY ALL""",
    ),
)
def _relocations(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).filter(~((F.col("team") == 3) & (F.col("season") == 1997)))
    old = (F.col("team") == 3) & (F.col("season") <= 1996)
    moved = tg.withColumn("club", F.when(old, 103).otherwise(F.col("team")))
    out = projections.apply_relocations(moved, {103: 3}, "club")
    return out.groupBy("club", "season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "split_roles",
    "P-12",
    oracle(
        "games",
        """SELECT season, CASE WHEN season IN (1999, 2000) THEN 'test' WHEN season = 1998 THEN 'validation' WHEN season > 2000 THEN 'served'
        ELSE 'train' END AS role, COUNT(*) AS games FROM games GROUP BY ALL""",
    ),
)
def _roles(spark, sf_dir):
    out = projections.with_split_role(views.schedule(spark, sf_dir), [1998], [1999, 2000])
    return out.groupBy("season", "role").agg(F.count(F.lit(1)).alias("games"))


@query(
    "upcoming_fixtures",
    "P-13 D-09",
    oracle(
        "fixtures",
        """SELECT game_id, game_date, game_date <= DATE '1998-03-02' AS by_date FROM fixtures
        WHERE game_date BETWEEN DATE '1998-03-01' AND DATE '1998-08-28'""",
    ),
)
def _upcoming(spark, sf_dir):
    from pregame.operators.fixtures import predictable_by_date

    fx = projections.upcoming(views.fixtures(spark, sf_dir), dt.date(1998, 3, 1), 180)
    near = predictable_by_date(fx, dt.date(1998, 3, 1)).select("game_id", F.lit(True).alias("by_date"))
    out = fx.join(near, "game_id", "left")
    return out.select("game_id", "game_date", F.coalesce("by_date", F.lit(False)).alias("by_date"))


@query("winner_market_rows", "P-14", oracle("played", "SELECT game_id FROM played WHERE home_pts <> away_pts"))
def _market(spark, sf_dir):
    return projections.rows_for_market(views.played(spark, sf_dir), "winner").select("game_id")


@query(
    "feature_routing",
    "P-15",
    oracle(
        "players",
        """SELECT CASE WHEN mins IS NOT NULL AND ast IS NOT NULL THEN 'linear' ELSE 'trees' END AS route, COUNT(*) AS rows FROM players GROUP BY 1""",
    ),
)
def _route(spark, sf_dir):
    return projections.with_route(views.players(spark, sf_dir), ["mins", "ast"]).groupBy("route").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "current_weeks",
    "P-16",
    oracle(
        "fixtures",
        f""", w AS (SELECT *, {WEEK_SQL} AS week FROM fixtures)
        SELECT league, season, week, game_id FROM w QUALIFY week <= MIN(week) OVER (PARTITION BY league, season) + 1""",
    ),
)
def _weeks(spark, sf_dir):
    out = projections.current_weeks(with_week(views.fixtures(spark, sf_dir)), ["league", "season"])
    return out.select("league", "season", "week", "game_id")


def divisions(spark, sf_dir):
    """Division of a team: the region of its nation."""
    return views.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("team"), F.col("n_regionkey").alias("division")
    )


@query(
    "division_games",
    "P-17 A-22",
    oracle(
        "played",
        """, d AS (SELECT p.*, CAST(h.n_regionkey = a.n_regionkey AS INT) AS is_division FROM played p
        JOIN nation h ON h.n_nationkey = home_team JOIN nation a ON a.n_nationkey = away_team),
        s AS (SELECT league, season, is_division, home_team AS team FROM d UNION ALL SELECT league, season, is_division, away_team FROM d)
        SELECT league, season, team, COUNT(*) AS games, CAST(SUM(is_division) AS BIGINT) AS division_games FROM s GROUP BY ALL""",
    ),
)
def _division(spark, sf_dir):
    from pregame.operators.aggregates import division_counts

    gm = projections.with_division_game(views.played(spark, sf_dir), divisions(spark, sf_dir))
    return division_counts(gm, ["league", "season"])


@query(
    "league_slate",
    "P-18",
    oracle(
        "fixtures",
        """, p AS (SELECT game_id, (home_team + 1) / 30.0::DOUBLE AS p_home FROM fixtures WHERE game_id % 2 = 0)
        SELECT f.game_id, f.league, ROUND(p_home, 6) AS p_home, MIN(game_date) OVER w AS first_date, COUNT(p_home) OVER w AS predictable
        FROM fixtures f LEFT JOIN p USING (game_id) WINDOW w AS (PARTITION BY league)""",
    ),
)
def _slate(spark, sf_dir):
    fx = views.fixtures(spark, sf_dir)
    pred = fx.filter(F.col("game_id") % 2 == 0).select("game_id", ((F.col("home_team") + 1) / 30.0).alias("p_home"))
    out = projections.league_slate(fx.select("game_id", "league", "game_date"), pred)
    return out.select("game_id", "league", r6("p_home"), "first_date", "predictable")


NOW = dt.datetime(1998, 3, 2, 4, 0, 0)
KICK_SQL = """timezone(CASE home_team % 2 WHEN 0 THEN 'America/New_York' ELSE 'America/Phoenix' END, game_date::TIMESTAMP + INTERVAL 20 HOUR + INTERVAL 20 MINUTE)"""


def with_kickoff(gm):
    """Kick-off 8:20 p.m. local; every fifth game has no time yet."""
    text = F.when(F.col("game_id") % 5 == 0, "TBD").otherwise("8:20 p.m.")
    zone = F.when(F.col("home_team") % 2 == 0, "America/New_York").otherwise("America/Phoenix")
    return gm.withColumn("kickoff_utc", kickoff_utc(F.col("game_date"), text, zone))


@query(
    "row_status",
    "P-19 F-15 F-16",
    oracle(
        "games",
        f""", k AS (SELECT *, CASE WHEN game_id % 5 <> 0 THEN {KICK_SQL} END AS kick FROM games)
        SELECT game_id, CASE WHEN game_id % 101 = 0 THEN 'voided' WHEN home_pts IS NULL THEN 'fixture'
        WHEN COALESCE(EPOCH(kick) + 5 * 3600, EPOCH(timezone('America/Los_Angeles', game_date::TIMESTAMP + INTERVAL 1 DAY)))
             <= EPOCH(TIMESTAMP '1998-03-02 04:00:00') THEN 'played' ELSE 'in_progress' END AS row_status FROM k""",
    ),
)
def _status(spark, sf_dir):
    gm = with_kickoff(views.games(spark, sf_dir)).withColumn("voided", F.col("game_id") % 101 == 0)
    return projections.with_row_status(gm, NOW).select("game_id", "row_status")


@query(
    "flex_merge",
    "P-20",
    oracle("copies", "SELECT league, game_id, BOOL_OR(copy = 'B' AND game_id % 3 = 0) AS flex, MIN(copy_date) AS copy_date FROM copies GROUP BY ALL"),
)
def _flex(spark, sf_dir):
    c = views.copies(spark, sf_dir).withColumn("flex", (F.col("copy") == "B") & (F.col("game_id") % 3 == 0))
    return projections.merge_flex(c, ["league", "game_id"])


@query(
    "common_rows",
    "J-20",
    oracle(
        "team_games",
        """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY league, team, season ORDER BY game_date, game_id) AS n FROM team_games)
        SELECT league, game_id, team FROM r WHERE n > 10""",
    ),
)
def _common(spark, sf_dir):
    out = rolling.add_rolling(views.team_games(spark, sf_dir), TEAM_SEASON, ["pts"], [3, 5, 10])
    cand = {"short": ["roll3_pts"], "long": ["roll5_pts", "roll10_pts"]}
    return joins.common_rows(out, cand, "pts").select("league", "game_id", "team")
