"""SQL twins of the views, composed into the oracle text of a query."""

from __future__ import annotations

_SIDES = """
SELECT league, season, game_id, game_date, home_team AS team, away_team AS opp, TRUE AS is_home,
       home_pts AS pts, away_pts AS opp_pts FROM played
UNION ALL
SELECT league, season, game_id, game_date, away_team, home_team, FALSE, away_pts, home_pts FROM played"""


def _quarters() -> str:
    out = []
    for side, odd in (("home", 1), ("away", 0)):
        for q in range(1, 5):
            out.append(
                f"SUM(CASE WHEN l_linenumber % 2 = {odd} AND ((l_linenumber - 1) // 2) % 4 = {q - 1} "
                f"THEN l_quantity ELSE 0 END) AS {side}_q{q}"
            )
    return ", ".join(out)


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "line_points": ((), """SELECT l_orderkey,
        SUM(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS hp,
        SUM(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS ap FROM lineitem GROUP BY l_orderkey"""),
    "games": (("line_points",), """SELECT o_orderkey AS game_id, c_mktsegment AS league,
        CAST(o_orderdate AS DATE) AS game_date,
        CAST(YEAR(o_orderdate) - CASE WHEN MONTH(o_orderdate) < 8 THEN 1 ELSE 0 END AS INT) AS season,
        CAST(c_nationkey AS INT) AS home_team, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS away_team,
        hp AS home_pts, ap AS away_pts, o_orderstatus AS status, o_orderpriority AS priority
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line_points ON o_orderkey = l_orderkey"""),
    "played": (("games",), "SELECT * FROM games WHERE home_pts IS NOT NULL"),
    "decided": (("played",), "SELECT * FROM played WHERE home_pts <> away_pts"),
    "fixtures": (("games",), "SELECT * FROM games WHERE home_pts IS NULL"),
    "team_games": (("played",), f"""SELECT *, CASE WHEN pts > opp_pts THEN 'W' WHEN pts < opp_pts THEN 'L'
        ELSE 'T' END AS wl FROM ({_SIDES})"""),
    "fixture_sides": (("fixtures",), """SELECT league, season, game_id, game_date, home_team AS team, 'home' AS side
        FROM fixtures UNION ALL
        SELECT league, season, game_id, game_date, away_team, 'away' FROM fixtures"""),
    "raw_games": (("team_games",), """SELECT league, season, game_date, team,
        LPAD(CAST(game_id AS VARCHAR), 10, '0') AS raw_id,
        'T' || team || CASE WHEN is_home THEN ' vs. T' ELSE ' @ T' END || opp AS matchup, wl, pts,
        pts - opp_pts + CASE WHEN game_id % 17 = 0 THEN 1 ELSE 0 END AS plus_minus FROM team_games"""),
    "players": (("games",), """SELECT league, season, game_id, game_date, CAST(s_nationkey AS INT) AS team,
        l_suppkey AS player_id, absent AS is_absent,
        CASE WHEN NOT absent THEN m END AS mins, CASE WHEN NOT absent THEN p END AS pts,
        CASE WHEN NOT absent THEN r END AS reb, CASE WHEN NOT absent THEN a END AS ast
        FROM (SELECT l_orderkey, l_suppkey, BOOL_AND(l_returnflag = 'R') AS absent, SUM(l_quantity) AS m,
                     SUM(CAST(l_partkey % 30 AS DOUBLE)) AS p, SUM(ROUND(l_discount * 100)) AS r,
                     SUM(ROUND(l_tax * 100)) AS a FROM lineitem GROUP BY l_orderkey, l_suppkey) b
        JOIN games ON l_orderkey = game_id JOIN supplier ON l_suppkey = s_suppkey"""),
    "quarter_scores": (("played",), f"""SELECT played.*, q.* EXCLUDE (l_orderkey) FROM played JOIN
        (SELECT l_orderkey, {_quarters()} FROM lineitem GROUP BY l_orderkey) q ON game_id = l_orderkey"""),
    "shots": (("games",), """SELECT league, season, game_id,
        CASE WHEN l_linenumber % 2 = 1 THEN home_team ELSE away_team END AS team,
        'Z' || l_linenumber AS zone, CASE WHEN l_linestatus = 'O' THEN '3PT' ELSE '2PT' END AS shot_type,
        CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS made FROM lineitem JOIN games ON l_orderkey = game_id"""),
    "arenas": ((), """SELECT CAST(n_nationkey AS INT) AS team, n_name AS arena,
        CAST(n_nationkey + 25 AS DOUBLE) AS lat, CAST(n_nationkey * 2 - 125 AS DOUBLE) AS lon,
        CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
             WHEN 2 THEN 'America/Denver' ELSE 'America/Phoenix' END AS zone FROM nation"""),
    "copies": (("played",), """SELECT league, season, game_id, home_team, away_team, home_pts, 'A' AS copy,
        game_date AS copy_date, away_pts AS copy_away FROM played UNION ALL
        SELECT league, season, game_id, home_team, away_team, home_pts, 'B',
        CAST(game_date + CAST(game_id % 2 AS INT) AS DATE),
        away_pts + CASE WHEN game_id % 97 = 0 THEN 1 ELSE 0 END FROM played WHERE game_id % 89 <> 0"""),
    "ended_games": (("decided",), """SELECT league, season, game_id, game_date, home_team, away_team,
        CASE WHEN game_id % 11 <> 0 AND game_id % 13 <> 0 THEN home_pts
             WHEN home_pts > away_pts THEN away_pts + 1 ELSE home_pts END AS home_pts,
        CASE WHEN game_id % 11 <> 0 AND game_id % 13 <> 0 THEN away_pts
             WHEN home_pts > away_pts THEN away_pts ELSE home_pts + 1 END AS away_pts,
        CASE WHEN game_id % 11 = 0 THEN 'OT' WHEN game_id % 13 = 0 THEN 'SO' ELSE 'REG' END AS game_end
        FROM decided"""),
}


def _needed(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _needed(VIEWS[name][0], done)
            done.append(name)
    return done


def oracle(views: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the CTEs it needs. A body of its own CTEs starts with a comma."""
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in _needed(tuple(views.split()), []))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}\n{body}" if ctes else body
