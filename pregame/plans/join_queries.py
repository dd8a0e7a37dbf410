"""Joins, set operations and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import joins, sets
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import r6
from pregame.sources import views


@query(
    "checked_join",
    "J-01 Q-32",
    oracle(
        "games line_points",
        "SELECT game_id, hp AS pts_home, hp IS NOT NULL AS matched FROM games LEFT JOIN line_points ON game_id = l_orderkey",
    ),
)
def _checked(spark, sf_dir):
    gm = views.schedule(spark, sf_dir).select("game_id")
    pts = views.game_points(spark, sf_dir).select(F.col("l_orderkey").alias("game_id"), F.col("home_pts").alias("pts_home"))
    return joins.join_checked(gm, pts, ["game_id"], "one_to_one")


@query(
    "join_with_known_gaps",
    "J-02",
    oracle(
        "games",
        """SELECT game_id, CAST(CASE WHEN game_id % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS missing,
        CASE WHEN game_id % 3 <> 0 THEN 'not listed' ELSE 'one side only' END AS problem
        FROM games WHERE home_pts IS NULL AND (game_id % 3 <> 0 OR game_id % 4 = 0)
        UNION ALL SELECT game_id, 1, 'x' FROM games WHERE FALSE""",
    ),
)
def _gaps(spark, sf_dir):
    gm = views.games(spark, sf_dir)
    both = gm.select("game_id", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"), "home_pts")
    known_side = F.col("home_pts").isNotNull() | ((F.col("game_id") % 4 == 0) & (F.col("side") == "home"))
    facts = both.filter(known_side).select("game_id", "side", F.lit(1).alias("fact"))
    listed = gm.filter(F.col("game_id") % 3 == 0).select("game_id")
    _, problems = joins.join_with_known_gaps(both.select("game_id", "side"), facts, ["game_id", "side"], listed)
    return problems


@query(
    "opponent_values",
    "J-03 J-04 J-05",
    oracle("team_games", "SELECT game_id, team, opp_pts, 'T' || opp AS opp_name FROM team_games"),
)
def _opponent(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).drop("opp_pts").withColumn("name", F.concat(F.lit("T"), F.col("team").cast("string")))
    out = joins.attach_opponent_label(joins.attach_opponent(tg, ["pts"]), "name")
    return out.select("game_id", "team", "opp_pts", "opp_name")


@query(
    "wide_game_rows",
    "J-06",
    oracle("played", "SELECT league, game_id, home_team, away_team, home_pts, away_pts FROM played"),
)
def _wide(spark, sf_dir):
    return joins.to_game_rows(views.team_games(spark, sf_dir), ["league", "game_id"], ["team", "pts"])


@query(
    "universe_reindex",
    "J-07",
    oracle("team_games", "SELECT game_id, team, CASE WHEN game_id % 10 <> 0 THEN pts END AS fact FROM team_games"),
)
def _universe(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    facts = tg.filter(F.col("game_id") % 10 != 0).select("game_id", "team", F.col("pts").alias("fact"))
    return joins.reindex_to_universe(tg.select("game_id", "team"), facts, ["game_id", "team"])


@query(
    "game_date_attach",
    "J-08",
    oracle(
        "",
        """SELECT l_orderkey AS game_id, l_linenumber, CAST(o_orderdate AS DATE) AS game_date, COUNT(*) AS lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    ),
)
def _dates(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_linenumber")
    out = joins.attach_game_date(lines, views.schedule(spark, sf_dir))
    return out.groupBy("game_id", "l_linenumber", "game_date").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "identity_as_of_season",
    "J-17",
    oracle(
        "team_games",
        """SELECT team, season, CASE WHEN team % 2 = 0 AND season >= 1998 THEN 'NEW_' ELSE 'OLD_' END || n_name AS name, COUNT(*) AS games
        FROM team_games JOIN nation ON team = n_nationkey GROUP BY ALL""",
    ),
)
def _identity(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("team"), "n_name")
    none = F.lit(None).cast("int")
    even = F.col("team") % 2 == 0
    old = n.select("team", F.concat(F.lit("OLD_"), "n_name").alias("name"), none.alias("first_season"), F.when(even, 1997).alias("last_season"))
    new = n.filter(even).select("team", F.concat(F.lit("NEW_"), "n_name").alias("name"), F.lit(1998).alias("first_season"), none.alias("last_season"))
    tg = views.team_games(spark, sf_dir).select("team", "season")
    out = joins.identity_as_of(tg, old.unionByName(new))
    return out.groupBy("team", "season", "name").agg(F.count(F.lit(1)).alias("games"))


@query(
    "key_coverage",
    "J-18",
    oracle(
        "played",
        """, e AS (SELECT game_id FROM played WHERE game_id % 50 <> 0), f AS (SELECT game_id FROM played WHERE game_id % 60 <> 0)
        SELECT game_id, 'missing' AS coverage FROM e WHERE game_id NOT IN (SELECT game_id FROM f)
        UNION ALL SELECT game_id, 'extra' FROM f WHERE game_id NOT IN (SELECT game_id FROM e)""",
    ),
)
def _coverage(spark, sf_dir):
    gm = views.played(spark, sf_dir).select("game_id")
    return joins.key_coverage(gm.filter("game_id % 50 <> 0"), gm.filter("game_id % 60 <> 0"), ["game_id"])


@query(
    "market_agreement",
    "J-19",
    oracle(
        "played",
        """, a AS (SELECT game_id, (home_team + 1) / 26.0::DOUBLE AS p FROM played), b AS (SELECT game_id, (away_team + 1) / 26.0::DOUBLE AS p FROM played WHERE game_id % 4 <> 0)
        SELECT COUNT(*) AS shared, COUNT(*) FILTER ((a.p > 0.5) <> (b.p > 0.5)) AS disagree,
        COUNT(*) FILTER ((a.p > 0.5) <> (b.p > 0.5) AND ABS(a.p - 0.5::DOUBLE) <= 0.1::DOUBLE) AS disagree_near_half FROM a JOIN b USING (game_id)""",
    ),
)
def _agreement(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    a = gm.select("game_id", ((F.col("home_team") + 1) / 26.0).alias("p_home"))
    b = gm.filter("game_id % 4 <> 0").select("game_id", ((F.col("away_team") + 1) / 26.0).alias("p_home"))
    return joins.market_agreement(a, b, 0.1)


@query(
    "enriched_fixtures",
    "J-21",
    oracle(
        "fixtures",
        """SELECT game_id, league, h.n_name AS home_name, a.n_name AS away_name FROM fixtures
        LEFT JOIN nation h ON h.n_nationkey = home_team LEFT JOIN nation a ON a.n_nationkey = away_team""",
    ),
)
def _enrich(spark, sf_dir):
    teams = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("team"), F.col("n_name").alias("name"))
    return joins.enrich_fixtures(views.fixtures(spark, sf_dir), teams).select("game_id", "league", "home_name", "away_name")


@query(
    "latest_prediction",
    "J-22",
    """SELECT user_id AS game_id, event_id, value AS p_home, ts AS predicted_at FROM events
    QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _latest(spark, sf_dir):
    log = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("game_id"), "event_id", F.col("value").alias("p_home"), F.col("ts").alias("predicted_at")
    )
    return joins.latest_prediction(log, tie=["event_id"])


@query(
    "parameter_grid",
    "J-23",
    oracle(
        "played",
        """SELECT cell, k, season, ROUND(SUM(k * (home_pts - away_pts)), 6) AS moved FROM played,
        (VALUES (0, 10.0::DOUBLE), (1, 20.0), (2, 30.0)) g(cell, k) GROUP BY ALL""",
    ),
)
def _grid(spark, sf_dir):
    g = joins.cross_grid(views.played(spark, sf_dir), [{"k": 10.0}, {"k": 20.0}, {"k": 30.0}])
    return g.groupBy("cell", "k", "season").agg(r6(F.sum(F.col("k") * (F.col("home_pts") - F.col("away_pts"))), "moved"))


@query(
    "aligned_frames",
    "J-24",
    oracle(
        "played",
        """, a AS (SELECT game_id, home_pts FROM played WHERE game_id % 3 <> 0), b AS (SELECT game_id, away_pts FROM played WHERE game_id % 4 <> 0),
        c AS (SELECT game_id, season AS s FROM played WHERE game_id % 5 = 0)
        SELECT * FROM a FULL JOIN b USING (game_id) FULL JOIN c USING (game_id)""",
    ),
)
def _align(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    return joins.align(
        [
            gm.filter("game_id % 3 <> 0").select("game_id", "home_pts"),
            gm.filter("game_id % 4 <> 0").select("game_id", "away_pts"),
            gm.filter("game_id % 5 = 0").select("game_id", F.col("season").alias("s")),
        ],
        ["game_id"],
    )


@query(
    "lookup_replacement",
    "J-25",
    oracle("team_games", "SELECT game_id, team, CAST(n_regionkey AS INT) AS rating FROM team_games JOIN nation ON team = n_nationkey"),
)
def _lookup(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).select("game_id", "team", F.lit(0).alias("rating"))
    look = views.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("team"), F.col("n_regionkey").cast("int").alias("rating")
    )
    return joins.replace_by_lookup(tg, "team", look, "rating")


@query(
    "entity_match",
    "J-13",
    """WITH roster AS (SELECT s_suppkey AS player_id, CAST(s_nationkey AS INT) AS team, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0
        UNION ALL SELECT s_suppkey + 1000000, CAST((s_nationkey + 1) % 25 AS INT), s_name FROM supplier WHERE s_suppkey % 7 = 0),
    report AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN s_nationkey ELSE (s_nationkey + 2) % 25 END AS INT) AS team,
        s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    u AS (SELECT name, MIN(player_id) AS pid FROM roster GROUP BY name HAVING COUNT(*) = 1)
    SELECT team, CASE WHEN r.player_id IS NOT NULL THEN 'team_and_name' WHEN u.pid IS NOT NULL THEN 'unique_name' ELSE 'unmatched' END AS match_kind,
    COALESCE(r.player_id, u.pid) AS player_id, COUNT(*) AS rows
    FROM report LEFT JOIN roster r USING (team, name) LEFT JOIN u USING (name) GROUP BY ALL""",
)
def _entities(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    team = F.col("s_nationkey").cast("int")
    first = s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("player_id"), team.alias("team"), F.col("s_name").alias("name"))
    second = s.filter("s_suppkey % 7 = 0").select(
        (F.col("s_suppkey") + 1000000).alias("player_id"), ((F.col("s_nationkey") + 1) % 25).cast("int").alias("team"), F.col("s_name").alias("name")
    )
    lines = views.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    named = F.when(F.col("l_linenumber") % 2 == 0, F.col("s_nationkey")).otherwise((F.col("s_nationkey") + 2) % 25)
    report = lines.select(named.cast("int").alias("team"), F.col("s_name").alias("name"))
    out = joins.match_entities(report, first.unionByName(second))
    return out.groupBy("team", "match_kind", "player_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "copy_groups",
    "J-15 F-25",
    oracle(
        "copies",
        """SELECT league, season, copy_date, LEAST(home_team, away_team) || '|' || GREATEST(home_team, away_team) AS pair,
        COUNT(*) AS copies, COUNT(DISTINCT copy_away) AS scores FROM copies GROUP BY ALL""",
    ),
)
def _copy_groups(spark, sf_dir):
    return joins.group_copies(views.copies(spark, sf_dir), ["league", "season", "copy_date"])


@query(
    "suffix_match",
    "J-16",
    oracle(
        "played",
        """, b AS (SELECT game_date, CAST(home_team AS VARCHAR) AS box_name, home_pts AS box_pts, game_id AS box_id FROM played WHERE game_id % 3 = 0)
        SELECT p.game_id, b.box_id, b.box_pts FROM played p JOIN b ON p.game_date = b.game_date AND suffix('CLUB ' || home_team, b.box_name)""",
    ),
)
def _suffix(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    games = gm.select("game_id", "game_date", F.concat(F.lit("CLUB "), F.col("home_team").cast("string")).alias("home_name"))
    boxes = gm.filter("game_id % 3 = 0").select(
        "game_date", F.col("home_team").cast("string").alias("box_name"), F.col("home_pts").alias("box_pts"), F.col("game_id").alias("box_id")
    )
    return joins.match_boxes(games, boxes, ["game_date"], "home_name", "box_name").select("game_id", "box_id", "box_pts")


@query(
    "alias_resolution",
    "J-26",
    oracle(
        "team_games",
        """SELECT CAST(team AS BIGINT) AS franchise_id, CASE team % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'alias' ELSE 'malformed' END AS resolved_by,
        CASE WHEN team % 3 = 2 THEN 'cell of ' || team END AS note, COUNT(*) AS games FROM team_games GROUP BY ALL""",
    ),
)
def _aliases(spark, sf_dir):
    team = F.col("team").cast("string")
    spelt = F.when(F.col("team") % 3 == 0, F.concat(F.lit("NATION_"), team)).when(
        F.col("team") % 3 == 1, F.concat(F.lit("N"), team)
    ).otherwise(F.concat(F.lit("??"), team))
    tg = views.team_games(spark, sf_dir).select("team", spelt.alias("label"))
    n = views.table(spark, sf_dir, "nation")
    fid = F.col("n_nationkey").cast("bigint").alias("franchise_id")
    key = F.col("n_nationkey").cast("string")
    exact = n.select(F.col("n_name").alias("label"), fid)
    alias = n.select(F.concat(F.lit("N"), key).alias("label"), fid)
    bad = n.select(F.concat(F.lit("??"), key).alias("label"), fid, F.concat(F.lit("cell of "), key).alias("note"))
    out = joins.resolve_aliases(tg, "label", exact, alias, bad)
    return out.groupBy("franchise_id", "resolved_by", "note").agg(F.count(F.lit(1)).alias("games"))


# ---- set operations and order -------------------------------------------------------------------


@query(
    "season_union",
    "U-01",
    oracle(
        "played",
        """SELECT season, COUNT(*) AS games, COUNT(extra) AS with_extra FROM (
        SELECT season, NULL AS extra FROM played WHERE season < 1998 UNION ALL SELECT season, 1 FROM played WHERE season >= 1998) GROUP BY season""",
    ),
)
def _union(spark, sf_dir):
    gm = views.played(spark, sf_dir).select("season")
    both = sets.union_all([gm.filter("season < 1998"), gm.filter("season >= 1998").withColumn("extra", F.lit(1))])
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.count("extra").alias("with_extra"))


@query(
    "key_intersection",
    "U-02",
    oracle("played", "SELECT league, home_team FROM played WHERE season = 1996 INTERSECT SELECT league, home_team FROM played WHERE season = 1999"),
)
def _intersect(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    return sets.intersect_keys(gm.filter("season = 1996"), gm.filter("season = 1999"), ["league", "home_team"])


@query(
    "key_differences",
    "U-03",
    oracle(
        "played",
        """, a AS (SELECT DISTINCT league, home_team, away_team FROM played WHERE season = 1996), b AS (SELECT DISTINCT league, home_team, away_team FROM played WHERE season = 1999)
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ),
)
def _except(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    return sets.except_keys(gm.filter("season = 1996"), gm.filter("season = 1999"), ["league", "home_team", "away_team"])


@query(
    "ordered_dedupe",
    "U-04 L-02",
    oracle(
        "team_games",
        """SELECT league, team, game_id, game_date FROM team_games
        QUALIFY ROW_NUMBER() OVER (PARTITION BY league, team ORDER BY game_date DESC, game_id DESC) = 1""",
    ),
)
def _dedupe(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).select("league", "team", "game_id", "game_date")
    return sets.dedupe(tg, ["league", "team"], ["game_date", "game_id"], keep="last")


@query(
    "selection_agreement",
    "U-05",
    oracle(
        "games",
        """, a AS (SELECT game_id FROM games WHERE status = 'F'), b AS (SELECT game_id FROM games WHERE status <> 'O')
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ),
)
def _agree(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    return sets.same_rows(gm.filter("status = 'F'"), gm.filter("status <> 'O'"), ["game_id"])


@query(
    "top_players",
    "L-03",
    oracle(
        "players",
        """SELECT game_id, team, player_id, ROW_NUMBER() OVER (PARTITION BY game_id, team ORDER BY mins DESC, player_id) AS rank
        FROM players WHERE mins IS NOT NULL QUALIFY rank <= 2""",
    ),
)
def _top(spark, sf_dir):
    p = views.players(spark, sf_dir).filter("mins IS NOT NULL")
    out = sets.top_per_group(p, ["game_id", "team"], [F.col("mins").desc(), F.col("player_id")], 2)
    return out.select("game_id", "team", "player_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "stat_leaderboard",
    "L-04",
    oracle("players", "SELECT game_id, player_id, COALESCE(pts, 0.0::DOUBLE) AS pts FROM players ORDER BY COALESCE(pts, 0) DESC, game_id, player_id LIMIT 25"),
)
def _board(spark, sf_dir):
    p = views.players(spark, sf_dir).select("game_id", "player_id", "pts")
    out = sets.leaderboard(p, "pts", ["game_id", "player_id"], 25)
    return out.withColumn("pts", F.coalesce("pts", F.lit(0.0)))


@query(
    "issue_examples",
    "L-06",
    oracle(
        "played",
        """SELECT league, season, COUNT(*) AS rows, (list(DISTINCT game_id ORDER BY game_id))[1:5] AS examples
        FROM played WHERE home_pts = away_pts GROUP BY ALL""",
    ),
)
def _examples(spark, sf_dir):
    tied = views.played(spark, sf_dir).filter("home_pts = away_pts")
    return sets.examples(tied, ["league", "season"], "game_id", 5)
