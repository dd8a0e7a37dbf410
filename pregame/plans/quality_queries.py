"""Quality gates over the tables, with defects planted by id so that every gate has something to report."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import aggregates as agg
from pregame.operators import asof, projections, quality, rolling
from pregame.plans.aggregate_queries import ENDED_SIDES_SQL, SHAPE_SQL, ended_sides
from pregame.plans.feature_queries import SEASON_W, TEAM_W, _mean_sql
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import TEAM, TEAM_SEASON, WEEK_SQL, r6, scratch, with_week
from pregame.sources import files, views


@query(
    "header_mismatches",
    "Q-01",
    oracle("played", "SELECT season, 'game_date' AS missing, 'day' AS extra FROM played WHERE season IN (1996, 1999) GROUP BY season"),
)
def _headers(spark, sf_dir):
    path = scratch(spark, "headers")
    gm = views.played(spark, sf_dir).select("league", "game_id", "game_date", "season")
    good = gm.filter("season NOT IN (1996, 1999)")
    bad = gm.filter("season IN (1996, 1999)").withColumnRenamed("game_date", "day")
    files.write_csv(good, f"{path}/a", ["season"])
    files.write_csv(bad, f"{path}/b", ["season"])
    out = files.with_season_from_path(quality.header_mismatches(files.scan_lines(spark, path)))
    return out.select(
        F.col("file_season").alias("season"), F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra")
    ).distinct()


@query(
    "missing_values",
    "Q-03",
    oracle(
        "players",
        """SELECT 'mins' AS "column", COUNT(*) FILTER (mins IS NULL) AS nulls FROM players HAVING COUNT(*) FILTER (mins IS NULL) > 0
        UNION ALL SELECT 'pts', COUNT(*) FILTER (pts IS NULL) FROM players HAVING COUNT(*) FILTER (pts IS NULL) > 0""",
    ),
)
def _missing(spark, sf_dir):
    return quality.missing_values(views.players(spark, sf_dir), ["game_id", "team", "mins", "pts"])


@query(
    "date_problems",
    "Q-04 F-05",
    oracle(
        "games",
        """SELECT game_id, season, CASE WHEN game_id % 301 = 0 THEN 'unparseable' ELSE 'outside season' END AS problem FROM games
        WHERE game_id % 301 = 0 OR NOT game_date BETWEEN make_date(season, 9, 1) AND make_date(season + 1, 8, 31)""",
    ),
)
def _dates(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    text = F.when(F.col("game_id") % 301 == 0, "not a date").otherwise(F.col("game_date").cast("string"))
    return quality.date_problems(gm.withColumn("text", text), "text", "season", ["game_id"]).drop("text")


@query(
    "ids_of_another_season",
    "Q-05 F-02",
    oracle(
        "games",
        """, g AS (SELECT *, (YEAR(game_date) // 100) * 100 + (season + 1) % 100 AS guess FROM games WHERE game_id % 41 = 0)
        SELECT game_id, season, CAST(CASE WHEN YEAR(game_date) - guess BETWEEN 0 AND 1 THEN guess ELSE guess - 100 END AS INT) AS season_by_id FROM g""",
    ),
)
def _wrong_season(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    bump = F.when(F.col("game_id") % 41 == 0, 100000).otherwise(0)
    raw = gm.withColumn("raw_id", F.lit(20000000) + (F.col("season") % 100) * 100000 + bump + F.col("game_id") % 100000)
    return quality.wrong_season_ids(raw, "raw_id", "game_date", "season").select("game_id", "season", "season_by_id")


@query(
    "domain_violations",
    "Q-06",
    oracle(
        "team_games",
        """SELECT 'wl' AS "column", wl AS value, COUNT(*) AS rows FROM team_games WHERE wl NOT IN ('W', 'L') GROUP BY wl
        UNION ALL SELECT 'league', league, COUNT(*) FROM team_games WHERE league NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD') GROUP BY league""",
    ),
)
def _domain(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    return quality.domain_violations(tg, {"wl": ["W", "L"], "league": ["BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]})


def planted_sides(spark, sf_dir):
    """Team-games with a row removed, a row doubled and two home rows, by game id."""
    tg = views.team_games(spark, sf_dir)
    k = F.col("game_id") % 500
    kept = tg.filter(~((k == 1) & F.col("is_home")))
    twice = kept.withColumn("_n", F.explode(F.when((k == 2) & F.col("is_home"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")
    return twice.withColumn("is_home", F.when(k == 3, True).otherwise(F.col("is_home")))


@query(
    "game_side_violations",
    "Q-07",
    oracle(
        "played",
        """SELECT game_id, CASE game_id % 500 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS rows,
        CASE game_id % 500 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 2 END AS home_rows FROM played WHERE game_id % 500 IN (1, 2, 3)""",
    ),
)
def _sides(spark, sf_dir):
    return quality.game_sides(planted_sides(spark, sf_dir))


@query("duplicate_line_keys", "Q-08", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def _dup_keys(spark, sf_dir):
    return quality.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_rows",
    "Q-08",
    "SELECT l_orderkey, l_linenumber, l_quantity, COUNT(*) AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
)
def _dup_rows(spark, sf_dir):
    return quality.duplicate_rows(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))


@query(
    "derived_margins",
    "Q-09 J-04",
    oracle(
        "team_games",
        """SELECT game_id, team, pts - opp_pts AS margin, pts - opp_pts + CASE WHEN game_id % 17 = 0 THEN 1 ELSE 0 END AS plus_minus_source,
        CASE WHEN pts = opp_pts THEN 'tie' WHEN game_id % 17 = 0 THEN 'source disagrees' END AS problem FROM team_games WHERE pts = opp_pts OR game_id % 17 = 0""",
    ),
)
def _margins(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    stated = F.col("pts") - F.col("opp_pts") + F.when(F.col("game_id") % 17 == 0, 1.0).otherwise(0.0)
    derived = quality.with_derived_margin(tg.withColumn("plus_minus", stated), "plus_minus")
    return quality.margin_problems(derived, "plus_minus").select("game_id", "team", "margin", "plus_minus_source", "problem")


@query(
    "served_margin_violations",
    "Q-10",
    oracle("team_games", "SELECT game_id, team, pts - opp_pts + 1 AS margin FROM team_games WHERE game_id % 211 = 0 AND is_home"),
)
def _served_margin(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    off = F.when((F.col("game_id") % 211 == 0) & F.col("is_home"), 1.0).otherwise(0.0)
    served = tg.withColumn("margin", F.col("pts") - F.col("opp_pts") + off)
    return quality.derived_margin_violations(served, "margin").select("game_id", "team", "margin")


@query(
    "irreconcilable_games",
    "Q-11",
    oracle(
        "played",
        """SELECT game_id, CASE WHEN home_pts = away_pts THEN 'tied' WHEN game_id % 307 = 0 THEN 'not one winner' ELSE 'wl contradicts points' END AS problem
        FROM played WHERE home_pts = away_pts OR game_id % 307 = 0 OR game_id % 311 = 0""",
    ),
)
def _irreconcilable(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    flipped = F.when(F.col("wl") == "W", "L").when(F.col("wl") == "L", "W").otherwise(F.col("wl"))
    wl = F.when(F.col("game_id") % 307 == 0, "W").when(F.col("game_id") % 311 == 0, flipped).otherwise(F.col("wl"))
    return quality.irreconcilable_games(tg.withColumn("wl", wl)).select("game_id", "problem")


@query(
    "box_total_mismatches",
    "Q-12",
    """WITH b AS (SELECT l_orderkey AS game_id, SUM(l_quantity) AS s FROM lineitem GROUP BY 1)
    SELECT game_id, s AS box_sum, s + 1 AS stated FROM b WHERE game_id % 97 = 0""",
)
def _box_total(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_quantity")
    total = F.col("home_pts") + F.col("away_pts") + F.when(F.col("game_id") % 97 == 0, 1.0).otherwise(0.0)
    stated = views.played(spark, sf_dir).select("game_id", total.alias("total"))
    return quality.box_total_mismatches(li, stated, ["game_id"], "l_quantity", "total")


@query(
    "participation_conflicts",
    "Q-13",
    oracle("players", "SELECT game_id, player_id, is_absent FROM players WHERE game_id % 103 = 0"),
)
def _participation(spark, sf_dir):
    p = views.players(spark, sf_dir)
    mins = F.when(F.col("game_id") % 103 != 0, F.col("mins")).when(F.col("is_absent"), 1.0)
    return quality.participation_conflicts(p.withColumn("mins", mins), "mins", ["pts", "reb"]).select("game_id", "player_id", "is_absent")


@query(
    "implausible_boxes",
    "Q-14",
    oracle(
        "players",
        """, b AS (SELECT game_id, team, player_id FROM players UNION ALL SELECT game_id, team, player_id FROM players WHERE player_id % 50 = 0)
        SELECT game_id, COUNT(*) AS rows, COUNT(DISTINCT team) AS teams, COUNT(*) - COUNT(DISTINCT player_id) AS repeated FROM b GROUP BY game_id
        HAVING COUNT(*) NOT BETWEEN 2 AND 6 OR COUNT(DISTINCT team) <> 2 OR COUNT(*) > COUNT(DISTINCT player_id)""",
    ),
)
def _boxes(spark, sf_dir):
    p = views.players(spark, sf_dir).select("game_id", "team", "player_id")
    return quality.rows_per_game(p.unionByName(p.filter("player_id % 50 = 0")), 2, 6)


QP_SQL = """qs AS (SELECT game_id, home_q1, home_q2, home_q3, home_q4, home_q1 + home_q2 + home_q3 + home_q4
    + CASE WHEN game_id % 53 = 0 THEN -1 WHEN game_id % 59 = 0 THEN 61 WHEN game_id % 16 = 0 THEN 7 ELSE 0 END AS final FROM quarter_scores),
    qk AS (SELECT game_id, CASE WHEN game_id % 53 = 0 THEN 'quarters exceed final' WHEN game_id % 59 = 0 THEN 'implausible overtime' WHEN game_id % 16 = 0 THEN 'overtime' ELSE 'regulation' END AS kind,
    final - home_q1 - home_q2 - home_q3 - home_q4 AS gap FROM qs)"""


def quarter_kinds(spark, sf_dir):
    q = views.quarter_scores(spark, sf_dir)
    k = F.col("game_id")
    off = F.when(k % 53 == 0, -1.0).when(k % 59 == 0, 61.0).when(k % 16 == 0, 7.0).otherwise(0.0)
    names = [f"home_q{i}" for i in range(1, 5)]
    q = q.withColumn("final", sum((F.col(c) for c in names), F.lit(0.0)) + off)
    return quality.quarter_problems(q, names, "final")


@query("quarters_against_final", "Q-15 Q-28", oracle("quarter_scores", f", {QP_SQL} SELECT game_id, gap, kind FROM qk WHERE kind <> 'regulation'"))
def _quarters(spark, sf_dir):
    return quarter_kinds(spark, sf_dir).filter("kind <> 'regulation'").select("game_id", "gap", "kind")


@query(
    "overtime_signals",
    "Q-16 U-03",
    oracle(
        "quarter_scores",
        f""", {QP_SQL}, s AS (SELECT game_id, kind IN ('overtime', 'implausible overtime') AS a, game_id % 16 = 0 AND game_id % 5 <> 0 AS b FROM qk)
        SELECT COUNT(*) FILTER (a AND b) AS "both", COUNT(*) FILTER (a AND NOT b) AS score_only, COUNT(*) FILTER (b AND NOT a) AS minutes_only, COUNT(*) AS games,
        ROUND(COUNT(*) FILTER (a) / COUNT(*), 6) AS share, COUNT(*) FILTER (a) / COUNT(*) BETWEEN 0.02 AND 0.12 AS plausible FROM s""",
    ),
)
def _overtime(spark, sf_dir):
    k = quarter_kinds(spark, sf_dir)
    by_score = k.filter("kind IN ('overtime', 'implausible overtime')")
    by_minutes = k.filter("game_id % 16 = 0 AND game_id % 5 <> 0")
    out = quality.overtime_agreement(by_score, by_minutes, k)
    return out.withColumn("share", r6("share"))


ADV_SQL = """ad AS (SELECT game_id, team, pts, 50.0::DOUBLE + CASE WHEN game_id % 61 = 0 AND is_home THEN 0.5 ELSE 0 END AS pace, 80.0::DOUBLE AS possessions,
    pts * 100 / 80.0 + CASE WHEN game_id % 71 = 0 THEN 10 ELSE 0 END AS o, opp_pts * 100 / 80.0 AS d FROM team_games),
    ap AS (SELECT *, o - d + CASE WHEN game_id % 67 = 0 THEN 1 ELSE 0 END AS net, MAX(pace) OVER (PARTITION BY game_id) - MIN(pace) OVER (PARTITION BY game_id) AS sp FROM ad)"""


@query(
    "advanced_stat_violations",
    "Q-17 F-26",
    oracle(
        "team_games",
        f""", {ADV_SQL} SELECT game_id, team, CASE WHEN sp > 0.05 THEN 'pace differs' WHEN ABS(net - (o - d)) > 0.15 THEN 'net is not off - def' ELSE 'implied points' END AS problem
        FROM ap WHERE sp > 0.05 OR ABS(net - (o - d)) > 0.15 OR ABS(o * possessions / 100.0 - pts) > 2""",
    ),
)
def _advanced(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    k = F.col("game_id")
    off = F.col("pts") * 100 / 80.0 + F.when(k % 71 == 0, 10.0).otherwise(0.0)
    dfn = F.col("opp_pts") * 100 / 80.0
    adv = tg.select(
        "game_id", "team", "pts", (F.lit(50.0) + F.when((k % 61 == 0) & F.col("is_home"), 0.5).otherwise(0.0)).alias("pace"),
        F.lit(80.0).alias("possessions"), off.alias("off"), dfn.alias("def"),
        (off - dfn + F.when(k % 67 == 0, 1.0).otherwise(0.0)).alias("net"),
    )
    return quality.advanced_violations(adv).select("game_id", "team", "problem")


@query(
    "period_structure",
    "Q-18",
    oracle(
        "quarter_scores",
        """, h AS (SELECT home_q1 AS q, home_q1 + home_q2 - CASE WHEN game_id % 83 = 0 THEN 60 ELSE 0 END AS h FROM quarter_scores)
        SELECT COUNT(*) AS rows, COUNT(*) FILTER (q IS NULL OR h IS NULL) AS nulls, COUNT(*) FILTER (q < 0 OR h < 0) AS negative,
        COUNT(*) FILTER (h < q) AS half_below_period, COUNT(*) FILTER (q > 60 OR h > 110) AS implausible FROM h""",
    ),
)
def _periods(spark, sf_dir):
    q = views.quarter_scores(spark, sf_dir)
    half = F.col("home_q1") + F.col("home_q2") - F.when(F.col("game_id") % 83 == 0, 60.0).otherwise(0.0)
    return quality.period_problems(q.withColumn("half", half), "home_q1", "half", 60, 110)


@query(
    "identity_conflicts",
    "Q-19",
    oracle(
        "team_games",
        """, l AS (SELECT DISTINCT league, season, CAST(team AS VARCHAR) AS id, CASE WHEN team = 9 THEN 'T8' WHEN team = 11 AND month(game_date) = 12 THEN 'TX' ELSE 'T' || team END AS label FROM team_games)
        SELECT league, season, 'id with several labels' AS problem, id AS subject, COUNT(*) AS n FROM l GROUP BY ALL HAVING COUNT(*) > 1
        UNION ALL SELECT league, season, 'label of several ids', label, COUNT(*) FROM l GROUP BY ALL HAVING COUNT(*) > 1""",
    ),
)
def _identity(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    label = F.when(F.col("team") == 9, "T8").when((F.col("team") == 11) & (F.month("game_date") == 12), "TX").otherwise(
        F.concat(F.lit("T"), F.col("team").cast("string"))
    )
    return quality.identity_conflicts(tg.withColumn("label", label), "team", "label", ["league", "season"])


@query(
    "overlapping_id_ranges",
    "Q-20",
    oracle(
        "games",
        """, k AS (SELECT league, CASE league WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 100 WHEN 'FURNITURE' THEN 120 WHEN 'HOUSEHOLD' THEN 300 ELSE 400 END + home_team AS id FROM games),
        s AS (SELECT league, MIN(id) AS low, MAX(id) AS high FROM k GROUP BY league)
        SELECT a.league, a.low, a.high, b.league AS overlaps, b.high AS overlaps_to FROM s a JOIN s b ON b.low < a.low AND b.high >= a.low""",
    ),
)
def _ranges(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    base = F.when(F.col("league") == "AUTOMOBILE", 0).when(F.col("league") == "BUILDING", 100).when(F.col("league") == "FURNITURE", 120).when(
        F.col("league") == "HOUSEHOLD", 300
    ).otherwise(400)
    return quality.overlapping_id_ranges(gm.withColumn("id", base + F.col("home_team")), "league", "id")


@query(
    "exception_drift",
    "Q-21 J-18",
    oracle(
        "played",
        """SELECT game_id, 'unlisted' AS coverage FROM played WHERE home_pts = away_pts AND game_id % 4 = 0
        UNION ALL SELECT game_id, 'stale' FROM played WHERE home_pts <> away_pts AND game_id % 400 = 0""",
    ),
)
def _exceptions(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    tied = F.col("home_pts") == F.col("away_pts")
    failing = gm.filter(tied)
    listed = gm.filter((tied & (F.col("game_id") % 4 != 0)) | (~tied & (F.col("game_id") % 400 == 0)))
    return quality.exception_drift(listed, failing, ["game_id"])


@query(
    "mirror_violations",
    "Q-22",
    oracle(
        "played",
        """SELECT game_id, 2 AS rows, CASE WHEN game_id % 223 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS margin_sum,
        CASE WHEN game_id % 227 = 0 THEN 100 ELSE 0 END AS team_sum, CASE WHEN game_id % 229 = 0 THEN 2 ELSE 1 END AS home_rows
        FROM played WHERE game_id % 223 = 0 OR game_id % 227 = 0 OR game_id % 229 = 0""",
    ),
)
def _mirror(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    k = F.col("game_id")
    bad = tg.withColumns(
        {
            "pts": F.col("pts") + F.when((k % 223 == 0) & F.col("is_home"), 1.0).otherwise(0.0),
            "team": F.col("team") + F.when((k % 227 == 0) & F.col("is_home"), 100).otherwise(0),
            "is_home": (k % 229 == 0) | F.col("is_home"),
        }
    )
    # All three plants read the original home flag, because the columns are replaced together.
    return quality.mirror_violations(bad)


@query(
    "double_bookings",
    "Q-23",
    oracle("team_games", "SELECT league, team, game_date, COUNT(*) AS games FROM team_games GROUP BY ALL HAVING COUNT(*) > 1"),
)
def _bookings(spark, sf_dir):
    return quality.double_bookings(views.team_games(spark, sf_dir), ["league", "team", "game_date"])


@query(
    "double_bookings_by_week",
    "Q-23",
    oracle("team_games", f", w AS (SELECT *, {WEEK_SQL} AS week FROM team_games) SELECT league, team, season, week, COUNT(*) AS games FROM w GROUP BY ALL HAVING COUNT(*) > 1"),
)
def _bookings_week(spark, sf_dir):
    return quality.double_bookings(with_week(views.team_games(spark, sf_dir)), ["league", "team", "season", "week"])


@query(
    "end_type_violations",
    "Q-24 F-21",
    oracle(
        "ended_games",
        f""", {ENDED_SIDES_SQL}, p AS (SELECT game_id, team, is_home, CASE WHEN game_id % 233 = 0 AND result = 'L' THEN 'OTL' ELSE result END AS result,
        pts + CASE WHEN game_id % 143 = 0 AND pts > opp_pts THEN 1 ELSE 0 END AS pts, opp_pts, game_end, result AS right_result FROM er)
        SELECT game_id, team, CASE WHEN game_end IN ('OT', 'SO') AND ABS(pts - opp_pts) <> 1 THEN 'overtime margin is not one' ELSE 'result does not follow' END AS problem
        FROM p WHERE (game_end IN ('OT', 'SO') AND ABS(pts - opp_pts) <> 1) OR result <> right_result""",
    ),
)
def _ends(spark, sf_dir):
    es = ended_sides(spark, sf_dir)
    k = F.col("game_id")
    bad = es.withColumns(
        {
            "result": F.when((k % 233 == 0) & (F.col("result") == "L"), "OTL").otherwise(F.col("result")),
            "pts": F.col("pts") + F.when((k % 143 == 0) & (F.col("pts") > F.col("opp_pts")), 1.0).otherwise(0.0),
        }
    )
    return quality.end_type_violations(bad).select("game_id", "team", "problem")


@query(
    "tie_flag_violations",
    "Q-25",
    oracle("team_games", "SELECT game_id, team FROM team_games WHERE game_id % 239 = 0"),
)
def _tie_flags(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    tie = F.col("pts") == F.col("opp_pts")
    flagged = tg.withColumn("is_tie", F.when(F.col("game_id") % 239 == 0, ~tie).otherwise(tie))
    return quality.tie_violations(flagged).select("game_id", "team")


@query(
    "outcome_marker_violations",
    "Q-26",
    oracle("team_games", "SELECT game_id, team, 'W' AS marker FROM team_games WHERE game_id % 241 = 0 AND wl <> 'W'"),
)
def _markers(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    marker = F.when(F.col("game_id") % 241 == 0, "W").when(F.col("game_id") % 2 == 0, F.col("wl"))
    return quality.marker_violations(tg.withColumn("marker", marker), "marker").select("game_id", "team", "marker")


@query(
    "schedule_completeness",
    "Q-29 A-20",
    oracle(
        "team_games",
        f""", {SHAPE_SQL.replace('FROM team_games', "FROM (SELECT * FROM team_games WHERE NOT (game_id % 251 = 0 AND is_home))")}
        SELECT league, season, verdict, identity_holds FROM shape WHERE NOT identity_holds OR NOT COALESCE(reconciles, TRUE) OR (verdict = 'short-only' AND shortfall % 2 <> 0)""",
    ),
)
def _completeness(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).filter(~((F.col("game_id") % 251 == 0) & F.col("is_home")))
    shape = agg.schedule_shape(tg, ["league", "season"])
    return quality.schedule_completeness(shape).select("league", "season", "verdict", "identity_holds")


@query(
    "linear_identity",
    "Q-30",
    oracle("players", "SELECT game_id, player_id FROM players WHERE game_id % 257 = 0 AND NOT is_absent"),
)
def _identity_sum(spark, sf_dir):
    p = views.players(spark, sf_dir)
    off = F.when(F.col("game_id") % 257 == 0, 0.5).otherwise(0.0)
    p = p.withColumn("pra", F.col("pts") + F.col("reb") + F.col("ast") + off)
    return quality.linear_identity(p, "pra", ["pts", "reb", "ast"]).select("game_id", "player_id")


@query(
    "constant_features",
    "Q-31 W-22",
    oracle("team_games", """SELECT 'k' AS "column", '1' AS lo, '1' AS hi UNION ALL SELECT 'z', NULL, NULL FROM (SELECT COUNT(*) FROM team_games)"""),
)
def _constant(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).withColumns({"k": F.lit(1), "z": F.lit(None).cast("double")})
    return quality.constant_features(tg, ["pts", "opp_pts", "k", "z"])


@query(
    "nulls_beyond_warmup",
    "Q-31 W-06",
    oracle(
        "team_games",
        f""", u AS (SELECT *, CASE WHEN game_id % 29 <> 0 THEN pts END AS fact FROM team_games),
        r AS (SELECT game_id, team, {_mean_sql('fact', 5, SEASON_W, 'm')}, ROW_NUMBER() OVER ({SEASON_W}) - 1 AS prior FROM u)
        SELECT game_id, team FROM r WHERE m IS NULL AND prior >= 5""",
    ),
)
def _beyond(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).withColumn("fact", F.when(F.col("game_id") % 29 != 0, F.col("pts")))
    out = rolling.prior_counts(rolling.trailing_mean(tg, TEAM_SEASON, "fact", 5, "m"), TEAM)
    return quality.nulls_beyond_warmup(out, "m", "prior_season", 5).select("game_id", "team")


@query(
    "row_count_preserved",
    "Q-32",
    oracle("played", "SELECT COUNT(*) AS rows_before, COUNT(*) * 2 AS rows_after, TRUE AS preserved FROM played"),
)
def _preserved(spark, sf_dir):
    return quality.row_count_change(views.played(spark, sf_dir), views.team_games(spark, sf_dir), 2)


@query(
    "rolling_regression_guard",
    "Q-42",
    oracle(
        "team_games",
        f""", r AS (SELECT game_id, team, {_mean_sql('pts', 5, SEASON_W, 'm')} FROM team_games)
        SELECT game_id, team, m AS "old", ROUND(m + 0.01, 6) AS "new" FROM r WHERE game_id % 263 = 0 AND m IS NOT NULL""",
    ),
)
def _guard(spark, sf_dir):
    old = rolling.trailing_mean(views.team_games(spark, sf_dir), TEAM_SEASON, "pts", 5, "m").select("game_id", "team", r6("m"))
    new = old.withColumn("m", F.when(F.col("game_id") % 263 == 0, F.round(F.col("m") + 0.01, 6)).otherwise(F.col("m")))
    return quality.value_changes(old, new, ["game_id", "team"], "m")


CUT = "1998-02-01"


def _form(df):
    return rolling.trailing_mean(df, TEAM_SEASON, "pts", 5, "roll5_pts")


@query(
    "future_corruption_effect",
    "Q-43",
    oracle("team_games", "SELECT league, game_id, team FROM team_games WHERE FALSE"),
)
def _future(spark, sf_dir):
    """Poisoning later rows moves no earlier value: empty."""
    day = F.col("game_date")
    out = quality.corruption_effect(
        views.team_games(spark, sf_dir), _form, ["league", "game_id", "team"], "roll5_pts", day >= CUT, "pts", day < CUT
    )
    return out.select("league", "game_id", "team")


@query(
    "past_corruption_effect",
    "Q-43 Q-47",
    oracle(
        "team_games",
        f""", p AS (SELECT *, CASE WHEN game_date < DATE '{CUT}' AND league = 'BUILDING' THEN pts * 1000 + 12345 ELSE pts END AS bad FROM team_games),
        r AS (SELECT league, game_id, team, game_date, {_mean_sql('pts', 5, SEASON_W, 'a')}, {_mean_sql('bad', 5, SEASON_W, 'b')} FROM p)
        SELECT league, game_id, team FROM r WHERE game_date >= DATE '{CUT}' AND a <> b""",
    ),
)
def _past(spark, sf_dir):
    """Positive control: poisoning one league's past moves that league's later values, and no other league's."""
    day = F.col("game_date")
    poison = (day < CUT) & (F.col("league") == "BUILDING")
    out = quality.corruption_effect(
        views.team_games(spark, sf_dir), _form, ["league", "game_id", "team"], "roll5_pts", poison, "pts", day >= CUT
    )
    return out.select("league", "game_id", "team")


@query(
    "group_isolation",
    "Q-47",
    oracle("players", "SELECT game_id, team FROM players WHERE FALSE"),
)
def _isolation(spark, sf_dir):
    """Poisoning other games' players moves no team-game's availability: empty."""
    reduce = lambda df: agg.team_availability(df, "weight", ["game_id", "team"])
    odd = F.col("game_id") % 2 == 1
    p = views.players(spark, sf_dir).withColumn("weight", F.col("player_id").cast("double"))
    out = quality.corruption_effect(p, reduce, ["game_id", "team"], "absent_weight", odd, "weight", ~odd)
    return out.select("game_id", "team")


@query(
    "truncation_test",
    "Q-44 J-11 W-25",
    oracle(
        "team_games",
        f""", r AS (SELECT league, game_id, team, game_date, {_mean_sql('pts', 5, TEAM_W, 'm')} FROM team_games),
        s AS (SELECT league, team, game_date, game_id, CASE WHEN COUNT(pts) OVER w = 5 THEN AVG(pts) OVER w END AS f FROM team_games
              WINDOW w AS (PARTITION BY league, team ORDER BY game_date, game_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        d AS (SELECT league, team, game_date, MAX_BY(f, game_id) AS f FROM s GROUP BY ALL),
        a AS (SELECT r.league, r.game_id, r.team, m, d.f FROM r LEFT JOIN d ON d.league = r.league AND d.team = r.team AND d.game_date < r.game_date
              QUALIFY ROW_NUMBER() OVER (PARTITION BY r.league, r.game_id, r.team ORDER BY d.game_date DESC) = 1)
        SELECT league, game_id, team, 'carry5_pts' AS "column" FROM a WHERE ROUND(f, 6) <> m OR (f IS NULL) <> (m IS NULL)""",
    ).replace("MAX_BY(f, game_id)", "MAX_BY(f, game_id)"),
)
def _truncation(spark, sf_dir):
    """Stored windows against those rebuilt from strictly earlier days: only double-header rows differ."""
    tg = views.team_games(spark, sf_dir)
    stored = rolling.add_rolling(tg, TEAM, ["pts"], [5], "carry").select("league", "game_id", "team", r6("carry5_pts"))
    rebuilt = asof.fixture_form(tg.select("league", "game_id", "game_date", "team"), tg, TEAM, ["pts"], 5, "carry")
    rebuilt = rebuilt.select("league", "game_id", "team", r6("carry5_pts"))
    out = quality.truncation_differences(stored, rebuilt, ["league", "game_id", "team"], ["carry5_pts"])
    return out.select("league", "game_id", "team", "column")


@query(
    "window_candidates_equal_before_cup",
    "Q-45 W-04",
    oracle("team_games", "SELECT game_id, team FROM team_games WHERE FALSE"),
)
def _candidates(spark, sf_dir):
    """Before the first cup game the cup-inclusive and the regular window agree: empty."""
    tg = views.team_games(spark, sf_dir)
    cup = (F.col("game_id") % 5 == 0) & (F.col("season") >= 1998)
    both = tg.withColumn("competition", F.when(cup, "cup").otherwise("regular"))
    a = rolling.add_rolling_all_competitions(both, TEAM, ["pts"], [5], "competition", "regular", "cup")
    b = rolling.add_rolling(both.filter("competition = 'regular'"), TEAM, ["pts"], [5], "carry").select("game_id", "team", "carry5_pts")
    j = a.join(b, ["game_id", "team"])
    return quality.differing_windows(j, "cup5_pts", "carry5_pts", F.col("season") < 1998).select("game_id", "team")


@query(
    "label_gates",
    "Q-46",
    oracle(
        "played",
        """SELECT game_id, CASE WHEN league = 'HOUSEHOLD' AND game_id % 10 = 0 THEN 'foreign competition' WHEN home_pts = away_pts THEN 'tie' ELSE 'label contradicts margin' END AS problem
        FROM played WHERE (league = 'HOUSEHOLD' AND game_id % 10 = 0) OR home_pts = away_pts OR game_id % 269 = 0""",
    ),
)
def _label_gates(spark, sf_dir):
    gm = projections.with_game_labels(views.played(spark, sf_dir))
    gm = gm.withColumns(
        {
            "home_win": F.when(F.col("game_id") % 269 == 0, 1 - F.col("home_win")).otherwise(F.col("home_win")),
            "league": F.when((F.col("league") == "HOUSEHOLD") & (F.col("game_id") % 10 == 0), "OTHER").otherwise(F.col("league")),
        }
    )
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return quality.label_violations(gm, known).select("game_id", "problem")


@query(
    "routing_safety",
    "Q-48 P-15",
    oracle("players", "SELECT game_id, player_id FROM players WHERE game_id % 271 = 0 AND is_absent"),
)
def _routing(spark, sf_dir):
    p = projections.with_route(views.players(spark, sf_dir), ["mins", "reb"])
    p = p.withColumn("route", F.when(F.col("game_id") % 271 == 0, "linear").otherwise(F.col("route")))
    return quality.routing_violations(p, ["mins", "reb"]).select("game_id", "player_id")


@query(
    "routing_counts",
    "Q-48",
    oracle(
        "players",
        "SELECT CASE WHEN is_absent THEN 'trees' ELSE 'linear' END AS route, COUNT(*) AS rows, CASE WHEN NOT is_absent THEN 0 END AS recorded, FALSE AS matches FROM players GROUP BY is_absent",
    ),
)
def _routing_counts(spark, sf_dir):
    p = projections.with_route(views.players(spark, sf_dir), ["mins", "reb"])
    return quality.routing_counts(p, {"linear": 0})
