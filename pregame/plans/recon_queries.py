"""Pairing of copies, standings reconciliation and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import aggregates as agg
from pregame.operators import recon
from pregame.plans.aggregate_queries import (
    ENDED_SIDES_SQL,
    STATED_SQL,
    computed_standings,
    stated_standings,
)
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.scalar_queries import PAGE_TRIPLES_SQL, page_triples
from pregame.sources import views

SEASON = ["league", "season"]


def pairing_sql(scope: str) -> str:
    """The pairing as a recursion over the days of each pair of teams."""
    keys = f"{scope}, pair"
    on = " AND ".join(f"d.{c} = f.{c}" for c in [x.strip() for x in keys.split(",")])
    dk = ", ".join(f"d.{c.strip()}" for c in keys.split(","))
    return f"""c AS (SELECT *, LEAST(home_team, away_team) || '|' || GREATEST(home_team, away_team) AS pair, CAST(copy_date - DATE '1970-01-01' AS INT) AS d FROM copies),
    d AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER w AS n, d - LAG(d) OVER w AS gap, CASE WHEN LEAD(d) OVER w = d + 1 THEN LEAD(a) OVER w ELSE 0 END AS na,
        CASE WHEN LEAD(d) OVER w = d + 1 THEN LEAD(b) OVER w ELSE 0 END AS nb
        FROM (SELECT {keys}, d, COUNT(*) FILTER (copy = 'A') AS a, COUNT(*) FILTER (copy = 'B') AS b FROM c GROUP BY {keys}, d) WINDOW w AS (PARTITION BY {keys} ORDER BY d)),
    f AS (SELECT {keys}, d, n, a, b, na, nb, 0::BIGINT AS carry, a - b AS lft FROM d WHERE n = 1
        UNION ALL SELECT {dk}, d.d, d.n, d.a, d.b, d.na, d.nb, CASE WHEN gap = 1 THEN lft ELSE 0 END,
        d.a - LEAST(GREATEST(-CASE WHEN gap = 1 THEN lft ELSE 0 END, 0), d.a) - (d.b - LEAST(GREATEST(CASE WHEN gap = 1 THEN lft ELSE 0 END, 0), d.b))
        FROM d JOIN f ON {on} AND d.n = f.n + 1),
    k AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY {', '.join('c.' + x.strip() for x in keys.split(','))}, c.d, copy ORDER BY game_id) AS r,
        CASE copy WHEN 'A' THEN a ELSE b END AS own, CASE copy WHEN 'A' THEN b ELSE a END AS oth, CASE copy WHEN 'A' THEN nb ELSE na END AS nxt,
        CASE copy WHEN 'A' THEN -carry ELSE carry END AS cr FROM c JOIN f USING ({keys}, d)),
    s AS (SELECT *, LEAST(GREATEST(cr, 0), own) AS uo, oth - LEAST(GREATEST(-cr, 0), oth) AS ol FROM k),
    paired AS (SELECT *, CASE WHEN r <= uo THEN (d - 1) || ':next:' || r WHEN r - uo <= LEAST(own - uo, ol) THEN d || ':same:' || (r - uo)
        WHEN r - uo - LEAST(own - uo, ol) <= nxt THEN d || ':next:' || (r - uo - LEAST(own - uo, ol)) END AS slot FROM s)"""


@query(
    "copy_pairing",
    "J-14 F-25",
    oracle("copies", f", {pairing_sql('league')} SELECT league, pair, game_id, copy, copy_date, slot FROM paired", recursive=True),
)
def _pairing(spark, sf_dir):
    out = recon.pair_copies(views.copies(spark, sf_dir), ["league"])
    return out.select("league", "pair", "game_id", "copy", "copy_date", "slot")


@query(
    "copy_quarantine",
    "Q-38 J-14",
    oracle(
        "copies",
        f""", {pairing_sql('league, season')}, g AS (SELECT league, season, pair, COALESCE(slot, 'single:' || copy || ':' || game_id) AS slot, COUNT(*) AS copies,
        MAX(copy_away) FILTER (copy = 'A') AS a_copy_away, MAX(copy_date) FILTER (copy = 'A') AS a_copy_date, MAX(copy_away) FILTER (copy = 'B') AS b_copy_away,
        MAX(copy_date) FILTER (copy = 'B') AS b_copy_date FROM paired GROUP BY ALL)
        SELECT *, CASE WHEN copies < 2 THEN 'single' WHEN a_copy_away = b_copy_away THEN 'agreed' WHEN season >= 2000 THEN 'quarantined' ELSE 'fatal' END AS verdict FROM g""",
        recursive=True,
    ),
)
def _quarantine(spark, sf_dir):
    pairs = recon.paired_games(recon.pair_copies(views.copies(spark, sf_dir), SEASON), SEASON, ["copy_away", "copy_date"])
    return recon.copy_agreement(pairs, ["copy_away"], F.col("season") >= 2000)


@query(
    "exact_copy_quarantine",
    "Q-38 J-15 Q-22",
    oracle(
        "copies",
        """, p AS (SELECT league, season, game_id, COUNT(*) AS copies, MAX(copy_away) FILTER (copy = 'A') AS a, MAX(copy_away) FILTER (copy = 'B') AS b FROM copies GROUP BY ALL)
        SELECT league, season, game_id, CASE WHEN copies < 2 THEN 'single' WHEN a = b THEN 'agreed' WHEN season >= 2000 THEN 'quarantined' ELSE 'fatal' END AS verdict FROM p""",
    ),
)
def _exact(spark, sf_dir):
    c = views.copies(spark, sf_dir)
    p = c.groupBy(*SEASON, "game_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(F.when(F.col("copy") == "A", F.col("copy_away"))).alias("a_copy_away"),
        F.max(F.when(F.col("copy") == "B", F.col("copy_away"))).alias("b_copy_away"),
    )
    return recon.copy_agreement(p, ["copy_away"], F.col("season") >= 2000).select(*SEASON, "game_id", "verdict")


@query(
    "left_quarantine",
    "Q-38 J-18",
    oracle(
        "played",
        "SELECT game_id FROM played WHERE game_id % 97 = 0 AND game_id % 89 <> 0 AND season >= 1999 AND season < 2000",
    ),
)
def _left(spark, sf_dir):
    gm = views.played(spark, sf_dir).filter("game_id % 97 = 0 AND game_id % 89 <> 0")
    return recon.left_quarantine(gm.filter("season >= 1999"), gm.filter("season >= 2000"), ["game_id"]).select("game_id")


@query(
    "settled_ends",
    "Q-39",
    oracle(
        "ended_games",
        """SELECT game_id, game_end, game_end IN ('OT', 'SO') AND game_id % 2 = 0 AS end_disputed FROM ended_games""",
    ),
)
def _ends(spark, sf_dir):
    other = F.when(F.col("game_end") == "OT", "SO").otherwise("OT")
    late = F.col("game_end").isin("OT", "SO") & (F.col("game_id") % 2 == 0)
    pairs = views.ended_games(spark, sf_dir).select(
        "game_id", F.col("game_end").alias("a_game_end"), F.when(late, other).otherwise(F.col("game_end")).alias("b_game_end")
    )
    return recon.settle_end(pairs).select("game_id", "game_end", "end_disputed")


# ---- standings ----------------------------------------------------------------------------------

DIFF_SQL = f"""{ENDED_SIDES_SQL}, {STATED_SQL}, dl AS (SELECT league, season, team, c.win - s.win AS d_win, c.loss - s.loss AS d_loss, c.otl - s.otl AS d_otl,
    c.gf - s.gf AS d_gf, c.ga - s.ga AS d_ga FROM computed c JOIN stated s USING (league, season, team)
    WHERE c.win <> s.win OR c.loss <> s.loss OR c.otl <> s.otl OR c.gf <> s.gf OR c.ga <> s.ga),
    sh AS (SELECT *, CASE WHEN d_win = 0 AND d_loss = 0 AND d_otl = 0 THEN 'score_only' WHEN d_gf = 0 AND d_ga = 0 AND d_win + d_loss + d_otl = 0 THEN 'result_label'
    WHEN GREATEST(d_win, d_loss, d_otl, d_gf, d_ga) <= 0 THEN 'games_missing' ELSE 'mixed' END AS shape FROM dl)"""


def _shapes(spark, sf_dir):
    c = computed_standings(spark, sf_dir)
    return recon.delta_shape(agg.standings_diff(c, stated_standings(c), [*SEASON, "team"]))


@query("standings_shapes", "Q-34", oracle("ended_games", f", {DIFF_SQL} SELECT league, season, team, shape FROM sh"))
def _shape(spark, sf_dir):
    return _shapes(spark, sf_dir).select(*SEASON, "team", "shape")


@query(
    "season_classes",
    "Q-35",
    oracle(
        "ended_games",
        f""", {DIFF_SQL}, se AS (SELECT DISTINCT league, season FROM computed), n AS (SELECT league, season, COUNT(*) AS teams, COUNT(*) FILTER (shape <> 'games_missing') AS suspect FROM sh GROUP BY ALL)
        SELECT league, season, CASE WHEN season = 1999 AND league = 'BUILDING' THEN 'self_inconsistent' WHEN suspect > 0 OR teams = 1 THEN 'probable_error'
        WHEN season = 2000 THEN 'incomplete' WHEN teams > 1 THEN 'lag' ELSE 'reconciled' END AS season_class, COALESCE(teams, 0) AS flagged_teams FROM se LEFT JOIN n USING (league, season)""",
    ),
)
def _classes(spark, sf_dir):
    seasons = computed_standings(spark, sf_dir).select(*SEASON).distinct()
    conflicts = seasons.filter("season = 1999 AND league = 'BUILDING'")
    incomplete = seasons.filter("season = 2000")
    return recon.season_class(_shapes(spark, sf_dir), seasons, conflicts, incomplete, SEASON)


@query(
    "standings_coverage",
    "Q-33",
    oracle(
        "ended_games",
        f""", {ENDED_SIDES_SQL} SELECT league, season, team, CASE WHEN team = 6 THEN 'missing' ELSE 'no goals' END AS problem FROM computed WHERE team IN (6, 12)
        UNION ALL SELECT league, season, 99, 'extra' FROM computed WHERE team = 7""",
    ),
)
def _coverage(spark, sf_dir):
    c = computed_standings(spark, sf_dir)
    page = c.filter("team <> 6").withColumn("gf", F.when(F.col("team") != 12, F.col("gf")))
    page = page.unionByName(c.filter("team = 7").withColumn("team", F.lit(99)))
    return recon.standings_coverage(page, c, [*SEASON, "team"])


@query(
    "page_field_conflicts",
    "Q-36",
    oracle(
        "ended_games",
        f""", {ENDED_SIDES_SQL}, {PAGE_TRIPLES_SQL} SELECT league, season, field, team, list(DISTINCT value ORDER BY value) AS "values",
        CASE WHEN COUNT(DISTINCT template) = 1 THEN 'within' ELSE 'between' END AS conflict FROM tri GROUP BY ALL HAVING COUNT(DISTINCT value) > 1""",
    ).replace("GROUP BY ALL HAVING COUNT(DISTINCT value)", "GROUP BY league, season, field, team HAVING COUNT(DISTINCT value)"),
)
def _conflicts(spark, sf_dir):
    return recon.field_conflicts(page_triples(spark, sf_dir), SEASON)


@query(
    "settled_page_fields",
    "Q-36",
    oracle(
        "ended_games",
        f""", {ENDED_SIDES_SQL}, {PAGE_TRIPLES_SQL} SELECT league, season, field, team, CASE WHEN MIN(value) = MAX(value) THEN MIN(value) END AS value FROM tri GROUP BY league, season, field, team""",
    ),
)
def _settled(spark, sf_dir):
    return recon.settled_fields(page_triples(spark, sf_dir), SEASON)


@query(
    "localised_labels",
    "Q-37",
    oracle(
        "ended_games",
        f""", {DIFF_SQL}, g AS (SELECT league, season, game_id, CASE WHEN home_pts > away_pts THEN away_team ELSE home_team END AS loser, home_team AS team FROM ended_games WHERE game_end <> 'REG'
        UNION ALL SELECT league, season, game_id, CASE WHEN home_pts > away_pts THEN away_team ELSE home_team END, away_team FROM ended_games WHERE game_end <> 'REG')
        SELECT s.league, s.season, s.team, COUNT(game_id) AS candidates, CASE WHEN COUNT(game_id) = 1 THEN MIN(game_id) END AS localised_game
        FROM sh s LEFT JOIN g ON g.league = s.league AND g.season = s.season AND g.team = s.team AND (s.d_otl = 0 OR g.loser = s.team)
        WHERE shape = 'result_label' GROUP BY ALL""",
    ),
)
def _localise(spark, sf_dir):
    return recon.localise_label(_shapes(spark, sf_dir), views.ended_games(spark, sf_dir), SEASON)


# ---- repair -------------------------------------------------------------------------------------


def repair_inputs(spark, sf_dir, games: int = 1000):
    """Suspects, settled totals and stated standings per competition of ``games`` consecutive games.

    Copy A is true, so every component has a solution, unless the stated goals were raised (every fifth
    competition, team 10).
    """
    ended = views.ended_games(spark, sf_dir).withColumn("round", F.floor(F.col("game_id") / games))
    scope = ["league", "round"]
    k = F.col("game_id")
    pair, single = (k % 97 == 0), (k % 89 == 0)
    suspects = ended.filter(pair | single).select(
        *scope, "game_id", "home_team", "away_team", F.when(single, "single").otherwise("pair").alias("kind"),
        F.col("home_pts").alias("a_home"), F.col("away_pts").alias("a_away"), F.col("game_end").alias("a_end"),
        F.col("home_pts").alias("b_home"), (F.col("away_pts") + 1).alias("b_away"), F.col("game_end").alias("b_end"),
    )
    keep = [*scope, "game_id", "game_end"]

    def totals(df):
        from pregame.functions.scalar import result_with_end

        s = views.sides(df, keep).withColumn("result", result_with_end(F.col("pts"), F.col("opp_pts"), F.col("game_end")))
        return agg.standings_totals(s, [*scope, "team"])

    base = totals(ended.filter(~(pair | single)))
    stated = totals(ended)
    raised = (F.col("round") % 5 == 4) & (F.col("team") == 10)
    stated = stated.withColumn("gf", F.col("gf") + F.when(raised, 1).otherwise(0))
    return suspects, base, stated, scope


def repair_sql(games: int) -> str:
    """Every reading of every component, suspect by suspect. Goals only ever add up, so a state that needs less than none is left."""
    vec = lambda own, other: f"[({own} > {other})::INT, ({own} < {other} AND game_end = 'REG')::INT, ({own} < {other} AND game_end <> 'REG')::INT, {own}::INT, {other}::INT]"
    return f""", e AS (SELECT *, CAST(game_id // {games} AS BIGINT) AS round, game_id % 97 = 0 OR game_id % 89 = 0 AS suspect FROM ended_games),
    sd AS (SELECT league, round, suspect, home_team AS team, {vec('home_pts', 'away_pts')} AS v FROM e UNION ALL SELECT league, round, suspect, away_team, {vec('away_pts', 'home_pts')} FROM e),
    f AS (SELECT *, UNNEST(range(1, 6)) AS k FROM sd),
    need AS (SELECT league, round, team, k, SUM(v[k]) - COALESCE(SUM(v[k]) FILTER (NOT suspect), 0) + CASE WHEN k = 4 AND round % 5 = 4 AND team = 10 THEN 1 ELSE 0 END AS n FROM f GROUP BY league, round, team, k),
    sus AS (SELECT league, round, game_id, home_team, away_team, UNNEST(['A', 'B']) AS pick, game_id % 89 = 0 AS single, home_pts, away_pts + (pick = 'B')::INT AS ap, game_end FROM e WHERE suspect),
    o AS (SELECT league, round, game_id, home_team, away_team, pick, CASE WHEN single AND pick = 'B' THEN [0, 0, 0, 0, 0] ELSE {vec('home_pts', 'ap')} END AS eh,
        CASE WHEN single AND pick = 'B' THEN [0, 0, 0, 0, 0] ELSE {vec('ap', 'home_pts')} END AS ea FROM sus),
    ed AS (SELECT DISTINCT league, round, home_team AS u, away_team AS v FROM o UNION SELECT DISTINCT league, round, away_team, home_team FROM o),
    reach AS (SELECT league, round, u, v FROM ed UNION SELECT r.league, r.round, r.u, ed.v FROM reach r JOIN ed ON ed.league = r.league AND ed.round = r.round AND ed.u = r.v),
    lab AS (SELECT league, round, u AS team, LEAST(u, MIN(v)) AS label FROM reach GROUP BY league, round, u),
    tm AS (SELECT league, round, label, list(team ORDER BY team) AS teams FROM lab GROUP BY ALL),
    num AS (SELECT o.*, label, DENSE_RANK() OVER (PARTITION BY o.league, o.round, label ORDER BY game_id) AS i FROM o JOIN lab ON lab.league = o.league AND lab.round = o.round AND lab.team = home_team),
    st AS (SELECT league, round, label, list(n ORDER BY team, k) AS need FROM need JOIN lab USING (league, round, team) GROUP BY ALL),
    walk AS (SELECT league, round, label, 0::BIGINT AS i, need::BIGINT[] AS need, '' AS picks FROM st
      UNION ALL SELECT w.league, w.round, w.label, n.i, w.need2, w.picks || n.pick FROM
        (SELECT w.*, n.i AS ni, n.pick AS np, list_transform(w.need, lambda x, j: x - CASE teams[(j + 4) // 5] WHEN n.home_team THEN n.eh[(j + 4) % 5 + 1] WHEN n.away_team THEN n.ea[(j + 4) % 5 + 1] ELSE 0 END) AS need2
         FROM walk w JOIN num n ON n.league = w.league AND n.round = w.round AND n.label = w.label AND n.i = w.i + 1 JOIN tm ON tm.league = w.league AND tm.round = w.round AND tm.label = w.label) w,
        LATERAL (SELECT w.ni AS i, w.np AS pick) n WHERE list_min(need2) >= 0),
    size AS (SELECT league, round, label, MAX(i) AS k FROM num GROUP BY ALL),
    sol AS (SELECT w.league, w.round, w.label, COUNT(*) AS solutions, MIN(picks) AS picks FROM walk w JOIN size z ON z.league = w.league AND z.round = w.round AND z.label = w.label AND z.k = w.i
      WHERE list_max(need) = 0 GROUP BY ALL)
    SELECT n.league, n.round, n.label, n.game_id, CASE WHEN solutions = 1 THEN 'repaired' WHEN solutions > 1 THEN 'ambiguous' ELSE 'indeterminate' END AS outcome,
    COALESCE(solutions, 0) AS solutions, CASE WHEN solutions = 1 THEN picks[n.i] END AS pick
    FROM (SELECT DISTINCT league, round, label, game_id, i FROM num) n LEFT JOIN sol ON sol.league = n.league AND sol.round = n.round AND sol.label = n.label"""


@query("standings_repair", "Q-40 Q-35 V-01", oracle("ended_games", repair_sql(1000), recursive=True))
def _repair(spark, sf_dir):
    return recon.repair(*repair_inputs(spark, sf_dir))


@query("standings_repair_large", "Q-40 Q-35", oracle("ended_games", repair_sql(5000), recursive=True))
def _repair_large(spark, sf_dir):
    """Longer competitions, so components of many suspects."""
    return recon.repair(*repair_inputs(spark, sf_dir, 5000))


@query(
    "neutral_sites",
    "Q-41 A-11",
    oracle(
        "played",
        """, v AS (SELECT season, home_team AS team, game_id, CASE WHEN game_id % 37 = 0 THEN 'London Field' WHEN game_id % 31 = 0 THEN 'Arena ' || ((home_team + 1) % 25)
        WHEN game_id % 29 = 0 THEN 'Renamed ' || home_team ELSE 'Arena ' || home_team END AS venue, game_id % 41 = 0 AS marker_neutral, game_id % 58 = 0 AS has_note FROM played),
        c AS (SELECT season, team, venue, COUNT(*) AS n FROM v GROUP BY ALL),
        u AS (SELECT season, team, venue AS usual FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY season, team ORDER BY n DESC, venue) = 1),
        o AS (SELECT season, usual AS venue, MIN(team) AS owner FROM u GROUP BY ALL),
        j AS (SELECT v.*, usual, owner, venue <> usual AS differs, venue <> usual AND COALESCE(owner <> v.team, FALSE) AS borrowed
              FROM v JOIN u USING (season, team) LEFT JOIN o USING (season, venue)),
        s AS (SELECT game_id, concat_ws(',', CASE WHEN marker_neutral THEN 'marker' END, CASE WHEN contains(venue, 'London') THEN 'international-city' END, CASE WHEN borrowed THEN 'borrowed-stadium' END,
        CASE WHEN differs AND NOT borrowed AND has_note THEN 'relocated-with-note' END, CASE WHEN differs AND NOT borrowed AND NOT has_note THEN 'differs-without-note' END) AS signals FROM j)
        SELECT game_id, signals, signals <> '' AND signals <> 'differs-without-note' AS is_neutral FROM s""",
    ),
)
def _neutral(spark, sf_dir):
    k = F.col("game_id")
    own = F.concat(F.lit("Arena "), F.col("home_team").cast("string"))
    venue = (
        F.when(k % 37 == 0, "London Field")
        .when(k % 31 == 0, F.concat(F.lit("Arena "), ((F.col("home_team") + 1) % 25).cast("string")))
        .when(k % 29 == 0, F.concat(F.lit("Renamed "), F.col("home_team").cast("string")))
        .otherwise(own)
    )
    rows = views.played(spark, sf_dir).select(
        "season", F.col("home_team").alias("team"), "game_id", venue.alias("venue"), (k % 41 == 0).alias("marker_neutral"), (k % 58 == 0).alias("has_note")
    )
    out = recon.neutral_signals(rows, ["London", "Munich"])
    return out.select("game_id", F.array_join("signals", ",").alias("signals"), "is_neutral")
