"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import aggregates as agg
from pregame.operators import projections, rest_travel, rolling
from pregame.plans.feature_queries import WEIGHTS_SQL, _mean_sql, SEASON_W, weighted_players
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import TEAM_SEASON, WEEK_SQL, r6, with_week
from pregame.sources import views

_ABS = "COALESCE(CASE WHEN is_absent THEN w_minutes END, 0)"


@query(
    "absence_sum_and_max",
    "A-01 A-02 A-04",
    oracle(
        "players played",
        f""", {WEIGHTS_SQL} SELECT game_id, team, ROUND(SUM({_ABS}), 6) AS absent_sum, ROUND(MAX({_ABS}), 6) AS absent_max,
        COUNT(*) FILTER (is_absent) AS absent FROM weighted GROUP BY game_id, team""",
    ),
)
def _absence(spark, sf_dir):
    p = weighted_players(spark, sf_dir)
    # The three reductions share their keys; one aggregate each, aligned on the keys.
    from pregame.operators.joins import align

    parts = [agg.reduce_absence(p, "w_minutes"), agg.reduce_absence(p, "w_minutes", "max"), agg.team_availability(p, "w_minutes").drop("absent_weight")]
    out = align(parts, ["game_id", "team"])
    return out.select("game_id", "team", r6("absent_sum"), r6("absent_max"), "absent")


@query(
    "absence_top_two",
    "A-03",
    oracle(
        "players played",
        f""", {WEIGHTS_SQL}, r AS (SELECT game_id, team, {_ABS} AS w, ROW_NUMBER() OVER (PARTITION BY game_id, team ORDER BY {_ABS} DESC, player_id) AS n FROM weighted)
        SELECT game_id, team, ROUND(SUM(w), 6) AS absent_top2 FROM r WHERE n <= 2 GROUP BY ALL""",
    ),
)
def _top2(spark, sf_dir):
    return agg.top_n_sum(weighted_players(spark, sf_dir), "w_minutes", 2).withColumn("absent_top2", r6("absent_top2"))


@query(
    "zone_baseline",
    "A-05",
    oracle("shots", "SELECT zone, COUNT(*) AS attempts, CAST(SUM(made) AS BIGINT) AS made, ROUND(SUM(made) / COUNT(*), 6) AS rate FROM shots WHERE season IN (1995, 1996, 1997) GROUP BY zone"),
)
def _zones(spark, sf_dir):
    return agg.zone_baseline(views.shots(spark, sf_dir), [1995, 1996, 1997]).withColumn("rate", r6("rate"))


@query(
    "shot_quality",
    "A-06",
    oracle(
        "shots",
        """, z AS (SELECT zone, SUM(made) / COUNT(*) AS rate FROM shots WHERE season IN (1995, 1996, 1997) GROUP BY zone),
        v AS (SELECT s.*, rate, CASE shot_type WHEN '3PT' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS value FROM shots s JOIN z USING (zone))
        SELECT game_id, team, season, COUNT(*) AS shots, ROUND(SUM(rate * value) / COUNT(*), 6) AS shot_quality,
        ROUND(SUM(made * value) / COUNT(*), 6) AS actual_efg, ROUND((SUM(made * value) - SUM(rate * value)) / COUNT(*), 6) + 0.0 AS shooting_luck FROM v GROUP BY ALL""",
    ),
)
def _quality(spark, sf_dir):
    shots = views.shots(spark, sf_dir)
    out = agg.shot_quality(shots, agg.zone_baseline(shots, [1995, 1996, 1997]), ["game_id", "team", "season"])
    return out.select("game_id", "team", "season", "shots", r6("shot_quality"), r6("actual_efg"), r6("shooting_luck"))


ENDED_SIDES_SQL = """es AS (SELECT league, season, game_id, game_date, home_team AS team, away_team AS opp, TRUE AS is_home, home_pts AS pts, away_pts AS opp_pts, game_end FROM ended_games
    UNION ALL SELECT league, season, game_id, game_date, away_team, home_team, FALSE, away_pts, home_pts, game_end FROM ended_games),
    er AS (SELECT *, CASE WHEN pts > opp_pts THEN 'W' WHEN game_end = 'REG' THEN 'L' ELSE 'OTL' END AS result FROM es),
    computed AS (SELECT league, season, team, COUNT(*) AS games, COUNT(*) FILTER (result = 'W') AS win, COUNT(*) FILTER (result = 'L') AS loss,
    COUNT(*) FILTER (result = 'OTL') AS otl, CAST(SUM(pts) AS BIGINT) AS gf, CAST(SUM(opp_pts) AS BIGINT) AS ga FROM er GROUP BY ALL)"""

STATED_SQL = """stated AS (SELECT league, season, team, win,
    loss + CASE WHEN team = 2 AND season = 1996 THEN 1 ELSE 0 END AS loss,
    otl - CASE WHEN team = 2 AND season = 1996 THEN 1 ELSE 0 END AS otl,
    gf + CASE WHEN team = 5 AND season = 1997 THEN 2 ELSE 0 END + CASE WHEN team IN (7, 8) AND season = 1998 THEN 3 ELSE 0 END AS gf,
    ga + CASE WHEN team IN (7, 8) AND season = 1998 THEN 2 ELSE 0 END AS ga FROM computed)"""


def ended_sides(spark, sf_dir):
    from pregame.functions.scalar import result_with_end

    es = views.sides(views.ended_games(spark, sf_dir), ["league", "season", "game_id", "game_date", "game_end"])
    return es.withColumn("result", result_with_end(F.col("pts"), F.col("opp_pts"), F.col("game_end")))


def computed_standings(spark, sf_dir):
    return agg.standings_totals(ended_sides(spark, sf_dir), ["league", "season", "team"])


def stated_standings(computed):
    """Stated totals: the computed ones with a relabelled result, a changed score and missing games."""
    def at(team, season):
        return F.when(F.col("team").isin(team) & (F.col("season") == season), 1).otherwise(0)

    return computed.select(
        "league", "season", "team", "win",
        (F.col("loss") + at([2], 1996)).alias("loss"),
        (F.col("otl") - at([2], 1996)).alias("otl"),
        (F.col("gf") + 2 * at([5], 1997) + 3 * at([7, 8], 1998)).alias("gf"),
        (F.col("ga") + 2 * at([7, 8], 1998)).alias("ga"),
    )


@query("standings_totals", "A-07 F-21", oracle("ended_games", f", {ENDED_SIDES_SQL} SELECT * FROM computed"))
def _standings(spark, sf_dir):
    return computed_standings(spark, sf_dir)


@query(
    "standings_differences",
    "A-08",
    oracle(
        "ended_games",
        f""", {ENDED_SIDES_SQL}, {STATED_SQL} SELECT league, season, team, c.win - s.win AS d_win, c.loss - s.loss AS d_loss, c.otl - s.otl AS d_otl,
        c.gf - s.gf AS d_gf, c.ga - s.ga AS d_ga,
        concat_ws(',', CASE WHEN c.win <> s.win THEN 'win' END, CASE WHEN c.loss <> s.loss THEN 'loss' END, CASE WHEN c.otl <> s.otl THEN 'otl' END,
        CASE WHEN c.gf <> s.gf THEN 'gf' END, CASE WHEN c.ga <> s.ga THEN 'ga' END) AS names
        FROM computed c JOIN stated s USING (league, season, team)
        WHERE c.win <> s.win OR c.loss <> s.loss OR c.otl <> s.otl OR c.gf <> s.gf OR c.ga <> s.ga""",
    ),
)
def _standing_diff(spark, sf_dir):
    c = computed_standings(spark, sf_dir)
    out = agg.standings_diff(c, stated_standings(c), ["league", "season", "team"])
    names = F.array_join(F.transform("fields", lambda x: x["field"]), ",")
    return out.withColumn("names", names).drop("fields")


@query(
    "coverage_by_season",
    "A-09",
    oracle(
        "players",
        "SELECT season, COUNT(DISTINCT game_id) AS game_ids, COUNT(DISTINCT team) AS teams, COUNT(DISTINCT player_id) AS player_ids FROM players GROUP BY season",
    ),
)
def _coverage(spark, sf_dir):
    return agg.coverage_by_season(views.players(spark, sf_dir), ["game_id", "team", "player_id"])


@query("value_counts", "A-10", oracle("team_games", "SELECT wl, COUNT(*) AS rows FROM team_games GROUP BY wl"))
def _counts(spark, sf_dir):
    return agg.value_counts(views.team_games(spark, sf_dir), "wl")


@query(
    "modal_value",
    "A-11",
    oracle(
        "games",
        """, n AS (SELECT league, home_team, priority, COUNT(*) AS c FROM games GROUP BY ALL)
        SELECT league, home_team, priority AS modal_priority, c AS modal_count FROM n
        QUALIFY ROW_NUMBER() OVER (PARTITION BY league, home_team ORDER BY c DESC, priority) = 1""",
    ),
)
def _modal(spark, sf_dir):
    return agg.modal_by_group(views.schedule(spark, sf_dir), ["league", "home_team"], "priority")


@query(
    "newcomers",
    "A-12",
    oracle(
        "team_games",
        """, f AS (SELECT league, team, MIN(season) AS first_season FROM team_games WHERE NOT (team < 6 AND season < 1994 + team) GROUP BY ALL)
        SELECT * FROM f WHERE first_season > (SELECT MIN(first_season) FROM f g WHERE g.league = f.league)""",
    ),
)
def _newcomers(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    late = (F.col("team") < 6) & (F.col("season") < 1994 + F.col("team"))
    return agg.newcomers(tg.filter(~late), ["league", "team"], ["league"])


@query(
    "home_advantage",
    "A-13",
    oracle("decided", "SELECT season, COUNT(*) AS games, ROUND(AVG(CAST(home_pts > away_pts AS DOUBLE)), 6) AS home_win_rate FROM decided GROUP BY season"),
)
def _home(spark, sf_dir):
    return agg.home_advantage(views.played(spark, sf_dir), ["season"]).withColumn("home_win_rate", r6("home_win_rate"))


@query(
    "win_share_spread",
    "A-14",
    oracle(
        "team_games",
        """, s AS (SELECT league, season, team, AVG(CAST(wl = 'W' AS DOUBLE)) AS s FROM team_games GROUP BY ALL)
        SELECT league, season, COUNT(*) AS teams, ROUND(STDDEV_POP(s), 6) AS spread, ROUND(MIN(s), 6) AS lowest, ROUND(MAX(s), 6) AS highest FROM s GROUP BY ALL""",
    ),
)
def _spread(spark, sf_dir):
    out = agg.win_share_spread(views.team_games(spark, sf_dir), ["league", "season"])
    return out.select("league", "season", "teams", r6("spread"), r6("lowest"), r6("highest"))


_RET = f"r AS (SELECT season, game_id, league, {_mean_sql('pts', 5, SEASON_W, 'roll5_pts')}, {_mean_sql('pts', 10, SEASON_W, 'roll10_pts')} FROM team_games)"


@query(
    "window_retention",
    "A-15",
    oracle(
        "team_games",
        f""", {_RET}, p AS (SELECT season, game_id, BOOL_AND(roll5_pts IS NOT NULL) AS a, BOOL_AND(roll10_pts IS NOT NULL) AS b FROM r GROUP BY ALL)
        SELECT season, COUNT(*) AS games, ROUND(AVG(CAST(a AS DOUBLE)), 6) AS keep_roll5_pts, ROUND(AVG(CAST(b AS DOUBLE)), 6) AS keep_roll10_pts
        FROM p GROUP BY ROLLUP (season)""",
    ),
)
def _retention(spark, sf_dir):
    tg = rolling.add_rolling(views.team_games(spark, sf_dir), TEAM_SEASON, ["pts"], [5, 10])
    out = agg.retention(tg, ["roll5_pts", "roll10_pts"])
    return out.select("season", "games", r6("keep_roll5_pts"), r6("keep_roll10_pts"))


@query(
    "correlations",
    "A-16",
    oracle(
        "players",
        """SELECT 'mins' AS a, 'pts' AS b, COUNT(*) FILTER (mins IS NOT NULL AND pts IS NOT NULL) AS n, ROUND(CORR(mins, pts), 6) AS r FROM players
        UNION ALL SELECT 'mins', 'reb', COUNT(*) FILTER (mins IS NOT NULL AND reb IS NOT NULL), ROUND(CORR(mins, reb), 6) FROM players""",
    ),
)
def _corr(spark, sf_dir):
    return agg.correlations(views.players(spark, sf_dir), [("mins", "pts"), ("mins", "reb")]).withColumn("r", r6("r"))


@query(
    "quartile_summary",
    "A-17",
    oracle(
        "team_games",
        """, e AS (SELECT quantile_cont(pts, 0.25) AS a, quantile_cont(pts, 0.5) AS b, quantile_cont(pts, 0.75) AS c FROM team_games)
        SELECT CAST(1 + CAST(pts > a AS INT) + CAST(pts > b AS INT) + CAST(pts > c AS INT) AS INT) AS bucket, COUNT(*) AS rows, ROUND(AVG(opp_pts), 6) AS mean_opp_pts
        FROM team_games, e GROUP BY 1""",
    ),
)
def _quartiles(spark, sf_dir):
    return agg.quartile_summary(views.team_games(spark, sf_dir), "pts", "opp_pts").withColumn("mean_opp_pts", r6("mean_opp_pts"))


@query(
    "distribution",
    "A-18",
    oracle(
        "team_games",
        """SELECT COUNT(pts) AS n, ROUND(quantile_cont(pts, 0.01), 6) AS q01, ROUND(quantile_cont(pts, 0.5), 6) AS q50, ROUND(quantile_cont(pts, 0.99), 6) AS q99,
        ROUND(AVG(CAST(pts > 60 AS DOUBLE)), 6) AS above_60, ROUND(AVG(CAST(pts > 120 AS DOUBLE)), 6) AS above_120 FROM team_games""",
    ),
)
def _distribution(spark, sf_dir):
    out = agg.describe_distribution(views.team_games(spark, sf_dir), "pts", [0.01, 0.5, 0.99], [60, 120])
    return out.select("n", *[r6(c) for c in out.columns if c != "n"])


@query(
    "collapsed_lines",
    "A-19",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS lines, SUM(l_quantity) AS l_quantity, ROUND(SUM(l_extendedprice), 2) AS l_extendedprice,
    MAX_BY(l_partkey, {'v': CAST(l_linestatus = 'F' AS INT), 'm': l_quantity, 'p': l_partkey, 's': l_suppkey}) AS l_partkey,
    MAX_BY(l_suppkey, {'v': CAST(l_linestatus = 'F' AS INT), 'm': l_quantity, 'p': l_partkey, 's': l_suppkey}) AS l_suppkey
    FROM lineitem GROUP BY ALL""",
)
def _collapse(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").withColumn("minutes", F.col("l_quantity"))
    out = agg.collapse_partial_lines(
        li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"], "minutes", F.col("l_linestatus") == "F",
        ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"],
    )
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


SHAPE_SQL = """pt AS (SELECT league, season, team, COUNT(DISTINCT game_id) AS n FROM team_games GROUP BY ALL),
    gn AS (SELECT league, season, COUNT(DISTINCT game_id) AS games FROM team_games GROUP BY ALL),
    mo AS (SELECT league, season, n AS modal FROM (SELECT league, season, n, COUNT(*) AS c FROM pt GROUP BY ALL)
           QUALIFY ROW_NUMBER() OVER (PARTITION BY league, season ORDER BY c DESC, n) = 1),
    st AS (SELECT league, season, modal, COUNT(*) AS teams, MIN(n) AS low, MAX(n) AS high, SUM(n) AS s, CAST(SUM(GREATEST(modal - n, 0)) AS BIGINT) AS shortfall
           FROM pt JOIN mo USING (league, season) GROUP BY ALL),
    vd AS (SELECT st.*, games, CASE WHEN low = high THEN 'uniform' WHEN high = modal THEN 'short-only' ELSE 'unbalanced' END AS verdict
           FROM st JOIN gn USING (league, season)),
    shape AS (SELECT league, season, teams, games, modal, low, high, shortfall, s = 2 * games AS identity_holds, verdict,
    CASE verdict WHEN 'uniform' THEN games = teams * modal / 2 WHEN 'short-only' THEN shortfall / 2 = teams * modal / 2 - games END AS reconciles FROM vd)"""


@query("schedule_shape", "A-20", oracle("team_games", f", {SHAPE_SQL} SELECT * FROM shape"))
def _shape(spark, sf_dir):
    return agg.schedule_shape(views.team_games(spark, sf_dir), ["league", "season"])


@query(
    "unknown_weights",
    "A-21",
    oracle(
        "players played",
        f""", {WEIGHTS_SQL}, a AS (SELECT * FROM weighted WHERE is_absent)
        SELECT 'w_minutes' AS variant, COUNT(*) AS absences, COUNT(*) FILTER (w_minutes IS NULL) AS unknown,
        ROUND(COUNT(*) FILTER (w_minutes IS NULL) / NULLIF(COUNT(*), 0), 6) AS unknown_share, COUNT(*) FILTER (w_minutes < 0) AS negative FROM a
        UNION ALL SELECT 'w_on_off', COUNT(*), COUNT(*) FILTER (w_on_off IS NULL), ROUND(COUNT(*) FILTER (w_on_off IS NULL) / NULLIF(COUNT(*), 0), 6),
        COUNT(*) FILTER (w_on_off < 0) FROM a""",
    ),
)
def _unknown(spark, sf_dir):
    return agg.zero_weight_report(weighted_players(spark, sf_dir), ["w_minutes", "w_on_off"]).withColumn("unknown_share", r6("unknown_share"))


@query(
    "clean_games",
    "A-27",
    oracle(
        "players played",
        f", {WEIGHTS_SQL} SELECT game_id FROM weighted GROUP BY game_id HAVING BOOL_AND(NOT is_absent OR (w_minutes IS NOT NULL AND w_rate IS NOT NULL))",
    ),
)
def _clean(spark, sf_dir):
    return agg.clean_games(weighted_players(spark, sf_dir), ["w_minutes", "w_rate"])


@query(
    "coincidence_share",
    "A-28",
    oracle(
        "players",
        """, n AS (SELECT game_id, team, COUNT(*) FILTER (is_absent) AS n FROM players GROUP BY ALL)
        SELECT COUNT(*) AS team_games, COUNT(*) FILTER (n <= 1) AS coincide, ROUND(AVG(CAST(n <= 1 AS DOUBLE)), 6) AS share FROM n""",
    ),
)
def _coincide(spark, sf_dir):
    return agg.coincidence_share(views.players(spark, sf_dir)).withColumn("share", r6("share"))


@query(
    "residual_moments",
    "A-23",
    oracle(
        "played",
        """, r AS (SELECT CASE WHEN season IN (1999, 2000) THEN 'test' WHEN season = 1998 THEN 'validation' WHEN season > 2000 THEN 'served' ELSE 'train' END AS role,
        home_pts - away_pts - 8 AS resid FROM played),
        m AS (SELECT role, COUNT(*) AS n, AVG(resid) AS mean, STDDEV_SAMP(resid) AS sd, VAR_POP(resid) AS v,
        AVG(POW(resid, 3)) - 3 * AVG(resid) * AVG(POW(resid, 2)) + 2 * POW(AVG(resid), 3) AS m3,
        AVG(POW(resid, 4)) - 4 * AVG(resid) * AVG(POW(resid, 3)) + 6 * POW(AVG(resid), 2) * AVG(POW(resid, 2)) - 3 * POW(AVG(resid), 4) AS m4 FROM r GROUP BY role)
        SELECT role, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, ROUND(m3 / NULLIF(POW(v, 1.5), 0), 6) AS skew,
        ROUND(m4 / NULLIF(v * v, 0) - 3, 6) AS excess_kurtosis, ROUND(sd / (SELECT sd FROM m WHERE role = 'train'), 6) AS sd_ratio FROM m WHERE n > 3""",
    ),
)
def _moments(spark, sf_dir):
    gm = projections.with_split_role(views.played(spark, sf_dir), [1998], [1999, 2000])
    gm = gm.withColumn("resid", F.col("home_pts") - F.col("away_pts") - 8)
    out = agg.residual_moments(gm, "resid", "role").filter("n > 3")
    return out.select("role", "n", *[r6(c) for c in ("mean", "sd", "skew", "excess_kurtosis", "sd_ratio")])


@query(
    "league_cutoffs",
    "A-24",
    oracle(
        "games played",
        """SELECT 'schedule' AS "table", league, MAX(game_date) AS data_as_of, COUNT(*) AS rows, MAX(season) AS newest_season FROM games GROUP BY league
        UNION ALL SELECT 'played', league, MAX(game_date), COUNT(*), MAX(season) FROM played GROUP BY league""",
    ),
)
def _cutoffs(spark, sf_dir):
    return agg.cutoffs({"schedule": views.schedule(spark, sf_dir), "played": views.played(spark, sf_dir)})


@query(
    "early_completeness",
    "A-25",
    oracle(
        "team_games",
        f""", r AS (SELECT {WEEK_SQL} AS week, {_mean_sql('pts', 5, SEASON_W, 'm')} FROM team_games)
        SELECT COUNT(*) AS rows, ROUND(AVG(CAST(m IS NOT NULL AS DOUBLE)), 6) AS complete, COUNT(*) FILTER (week <= 4) AS early_rows,
        ROUND(AVG(CAST(m IS NOT NULL AS DOUBLE)) FILTER (week <= 4), 6) AS early_complete FROM r""",
    ),
)
def _early(spark, sf_dir):
    tg = rolling.trailing_mean(views.team_games(spark, sf_dir), TEAM_SEASON, "pts", 5, "m")
    out = agg.completeness_by_week(with_week(tg), ["m"])
    return out.select("rows", r6("complete"), "early_rows", r6("early_complete"))


@query(
    "break_clusters",
    "A-26",
    oracle(
        "team_games",
        f""", g AS (SELECT league, season, team, game_date AS e, LAG(game_date) OVER ({SEASON_W}) AS s FROM team_games),
        l AS (SELECT * FROM g WHERE e - s > 10),
        f AS (SELECT *, CASE WHEN s > MAX(e) OVER (PARTITION BY league, season ORDER BY s, e, team ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM l),
        c AS (SELECT *, SUM(nw) OVER (PARTITION BY league, season ORDER BY s, e, team ROWS UNBOUNDED PRECEDING) AS k FROM f),
        t AS (SELECT league, season, COUNT(DISTINCT team) AS league_teams FROM team_games GROUP BY ALL)
        SELECT league, season, MIN(s) AS idle_from, MAX(e) AS idle_to, COUNT(DISTINCT team) AS teams, league_teams,
        CASE WHEN COUNT(DISTINCT team) >= league_teams - 1 THEN 'league-wide break' WHEN COUNT(DISTINCT team) <= 2 THEN 'excluded game or cancellation'
        ELSE 'partial break' END AS cause FROM c JOIN t USING (league, season) GROUP BY league, season, k, league_teams""",
    ),
)
def _breaks(spark, sf_dir):
    rested = rest_travel.season_rest(views.team_games(spark, sf_dir), TEAM_SEASON)
    return agg.break_clusters(rested, ["league", "season"], 10).drop("cluster")


@query(
    "tied_periods",
    "A-29",
    oracle(
        "quarter_scores",
        " UNION ALL ".join(
            f"SELECT 'q{q}' AS period, COUNT(*) AS games, COUNT(*) FILTER (home_q{q} = away_q{q}) AS ties, ROUND(COUNT(*) FILTER (home_q{q} = away_q{q}) / COUNT(*), 6) AS share FROM quarter_scores"
            for q in (1, 2)
        ),
    ),
)
def _ties(spark, sf_dir):
    return agg.tie_share(views.quarter_scores(spark, sf_dir), ["q1", "q2"]).withColumn("share", r6("share"))
