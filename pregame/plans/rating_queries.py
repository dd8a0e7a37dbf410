"""Elo replays, the as-of read, parameter search and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.operators import ratings as R
from pregame.operators import rolling
from pregame.operators.aggregates import newcomers
from pregame.plans.feature_queries import LABEL_SQL, labelled
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import TEAM, r6
from pregame.sources import views

KEYS = ["league"]
NEUTRAL_EVERY = 13


def elo_ctes(p: R.EloParams, source: str, keys: str = "league", neutral: bool = False, new_from: str | None = None, name: str = "r") -> str:
    """Recursive CTEs that replay ``source`` per ``keys``; result rows are those of ``name`` with n > 0.

    ``source`` may carry k_, keep_, home_ columns (a grid); otherwise the parameters are literals.
    ``new_from`` names a CTE of newcomers (league, team).
    """
    grid = "cell" in keys
    k = "k_" if grid else f"{p.k!r}::DOUBLE"
    keep = "keep_" if grid else f"{p.keep!r}::DOUBLE"
    home = "home_" if grid else f"{p.home!r}::DOUBLE"
    extra = "k_, keep_, home_," if grid else ""
    gextra = "g.k_, g.keep_, g.home_," if grid else ""
    center = "list_avg(st)" if p.boundary == "league_mean" else "1500.0::DOUBLE"
    turn = (
        "st"
        if p.boundary == "team"
        else f"CASE WHEN cs <> season THEN list_transform(st, lambda x: {center} + {keep} * (x - {center})) ELSE st END"
    )
    enter = (
        "CASE WHEN ls[{t}] <> season THEN 1500 + {keep} * (s1[{t}] - 1500) ELSE s1[{t}] END" if p.boundary == "team" else "s1[{t}]"
    )
    start = f"1500.0::DOUBLE + CASE WHEN {{side}}_new THEN {p.newcomer_offset!r} ELSE 0 END" if new_from else "1500.0::DOUBLE"
    edge = f"hr + CASE WHEN neutral THEN 0 ELSE {home} END - ar"
    mov = "1.0" if not p.mov else "CASE WHEN m = 0 THEN 0.0 ELSE LN(ABS(m) + 1) * 2.2 / (0.001 * (CASE WHEN m > 0 THEN edge ELSE -edge END) + 2.2) END"
    neutral_sql = f"game_id % {NEUTRAL_EVERY} = 0" if neutral else "FALSE"
    is_new = (
        f"(league, home_team) IN (SELECT (league, team) FROM {new_from}) AS h_new, (league, away_team) IN (SELECT (league, team) FROM {new_from}) AS a_new"
        if new_from
        else "FALSE AS h_new, FALSE AS a_new"
    )
    key_list = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"g.{c} = {name}.{c}" for c in key_list)
    gkeys = ", ".join(f"g.{c}" for c in key_list)
    return f"""{name}g AS MATERIALIZED (SELECT {keys}, {extra} ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY game_date, game_id) AS n, game_id, season,
        home_team + 1 AS h, away_team + 1 AS a, home_pts - away_pts AS m, {neutral_sql} AS neutral, {is_new} FROM {source}),
    {name} AS (SELECT {keys}, 0::BIGINT AS n, list_transform(range(25), lambda x: NULL::DOUBLE) AS st, list_transform(range(25), lambda x: NULL::INT) AS ls,
        NULL::INT AS cs, NULL::BIGINT AS game_id, NULL::DOUBLE AS hr, NULL::DOUBLE AS ar, NULL::DOUBLE AS e, NULL::DOUBLE AS hp, NULL::DOUBLE AS ap FROM {name}g GROUP BY {keys}
    UNION ALL
    SELECT {keys}, n, list_transform(s1, lambda x, i: CASE WHEN i = h THEN hr + ch WHEN i = a THEN ar - ch ELSE x END),
        list_transform(ls, lambda x, i: CASE WHEN i = h OR i = a THEN season ELSE x END), season, game_id, hr, ar, e, hr + ch, ar - ch
    FROM (SELECT *, {k} * ((CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 ELSE 0.5 END)::DOUBLE - e) * ({mov})::DOUBLE AS ch
     FROM (SELECT *, 1.0 / (1.0 + POW(10.0::DOUBLE, -edge / 400.0)) AS e
      FROM (SELECT *, {edge} AS edge
       FROM (SELECT *, COALESCE({enter.format(t='h', keep=keep)}, {start.format(side='h')}) AS hr, COALESCE({enter.format(t='a', keep=keep)}, {start.format(side='a')}) AS ar
        FROM (SELECT *, {turn} AS s1
         FROM (SELECT {gkeys}, {gextra} g.n, g.game_id, g.season, g.h, g.a, g.m, g.neutral, g.h_new, g.a_new, st, ls, cs
          FROM {name} JOIN {name}g g ON {on} AND g.n = {name}.n + 1)))))))"""


ELO_OUT = "ROUND(hr, 6) AS home_elo, ROUND(ar, 6) AS away_elo, ROUND(e, 6) AS home_expected, ROUND(hp, 6) AS home_post, ROUND(ap, 6) AS away_post"
ELO_COLS = ["home_elo", "away_elo", "home_expected", "home_post", "away_post"]


def _replay_query(variant: str, source: str, neutral: bool):
    p = R.VARIANTS[variant]
    sql = oracle(source, f", {elo_ctes(p, source, neutral=neutral)} SELECT league, game_id, {ELO_OUT} FROM r WHERE n > 0", recursive=True)

    @query(f"elo_{variant}", "R-01 V-01", sql)
    def run(spark, sf_dir):
        gm = getattr(views, source)(spark, sf_dir)
        if neutral:
            gm = gm.withColumn("neutral", F.col("game_id") % NEUTRAL_EVERY == 0)
        return R.elo_replay(gm, p, KEYS).select("league", "game_id", *[r6(c) for c in ELO_COLS])


_replay_query("nba", "decided", False)
_replay_query("wnba", "decided", False)
_replay_query("nfl", "played", True)
_replay_query("nhl", "decided", False)

LATE_SQL = "late AS (SELECT * FROM decided WHERE NOT (home_team < 6 AND season < 1994 + home_team) AND NOT (away_team < 6 AND season < 1994 + away_team))"
NEW_SQL = """lt AS (SELECT league, season, home_team AS team FROM late UNION ALL SELECT league, season, away_team FROM late),
    fs AS (SELECT league, team, MIN(season) AS first_season FROM lt GROUP BY ALL),
    fresh AS (SELECT * FROM fs WHERE first_season > (SELECT MIN(first_season) FROM fs x WHERE x.league = fs.league))"""


def late_games(spark, sf_dir):
    """Decided games of a league into which teams 1 to 5 enter one season after the other."""
    gm = views.decided(spark, sf_dir)
    early = lambda c: (F.col(c) < 6) & (F.col("season") < 1994 + F.col(c))
    return gm.filter(~early("home_team") & ~early("away_team"))


def late_newcomers(gm):
    sides = gm.select("league", "season", F.explode(F.array("home_team", "away_team")).alias("team"))
    return newcomers(sides, TEAM, KEYS)


@query(
    "elo_gleague",
    "R-01 V-01",
    oracle(
        "decided",
        f", {LATE_SQL}, {NEW_SQL}, {elo_ctes(R.VARIANTS['gleague'], 'late', new_from='fresh')} SELECT league, game_id, {ELO_OUT} FROM r WHERE n > 0",
        recursive=True,
    ),
)
def _gleague(spark, sf_dir):
    gm = late_games(spark, sf_dir)
    out = R.elo_replay(gm, R.VARIANTS["gleague"], KEYS, late_newcomers(gm))
    return out.select("league", "game_id", *[r6(c) for c in ELO_COLS])


STATES_SQL = """states AS (SELECT d.league, d.home_team AS team, d.game_date, d.game_id, d.season, hp AS rating, hr AS pre FROM r JOIN {s} d USING (game_id) WHERE n > 0
    UNION ALL SELECT d.league, d.away_team, d.game_date, d.game_id, d.season, ap, ar FROM r JOIN {s} d USING (game_id) WHERE n > 0)"""


def _as_of_query(variant: str, pull: str):
    p = R.VARIANTS[variant]
    sql = oracle(
        "decided fixture_sides",
        f""", {elo_ctes(p, 'decided')}, {STATES_SQL.format(s='decided')},
        ends AS (SELECT league, team, season AS ss, MAX_BY(rating, (game_date, game_id)) AS last FROM states GROUP BY ALL),
        mean AS (SELECT league, season, AVG(last) AS mu FROM (SELECT f.league, f.season, e.team, MAX_BY(e.last, e.ss) AS last
        FROM (SELECT DISTINCT league, season FROM fixture_sides) f JOIN ends e ON e.league = f.league AND e.ss < f.season GROUP BY ALL) GROUP BY ALL),
        hit AS (SELECT f.league, f.game_id, f.team, f.season, s.rating, s.season AS ss FROM fixture_sides f LEFT JOIN states s
        ON s.league = f.league AND s.team = f.team AND s.game_date < f.game_date
        QUALIFY ROW_NUMBER() OVER (PARTITION BY f.league, f.game_id, f.team ORDER BY s.game_date DESC, s.game_id DESC) = 1)
        SELECT league, game_id, team, ROUND(CASE WHEN rating IS NULL THEN {1500 + p.newcomer_offset} WHEN ss <> season THEN {pull} ELSE rating END, 6) AS elo_entering
        FROM hit LEFT JOIN mean USING (league, season)""",
        recursive=True,
    )

    @query(f"elo_as_of_{variant}", "R-02 J-11", sql)
    def run(spark, sf_dir):
        gm = views.decided(spark, sf_dir)
        states = R.rating_states(gm, R.elo_replay(gm, p, KEYS), KEYS)
        out = R.elo_as_of(views.fixture_sides(spark, sf_dir), states, p, KEYS)
        return out.select("league", "game_id", "team", r6("elo_entering"))


_as_of_query("nba", f"1500 + {R.VARIANTS['nba'].keep!r}::DOUBLE * (rating - 1500)")
_as_of_query("nhl", f"1500 + POW({R.VARIANTS['nhl'].keep!r}::DOUBLE, season - ss) * (rating - 1500)")
_as_of_query("gleague", f"mu + {R.VARIANTS['gleague'].keep!r}::DOUBLE * (rating - mu)")

CELLS = R.grid_cells(R.EloParams(), [10.0, 20.0, 40.0], [0.5, 0.75], [0.0, 50.0])
_CELL_ROWS = ", ".join(f"({i}, {c.k!r}::DOUBLE, {c.keep!r}::DOUBLE, {c.home!r}::DOUBLE)" for i, c in enumerate(CELLS))
GRID_SQL = f"""cells(cell, k_, keep_, home_) AS (VALUES {_CELL_ROWS}), gg AS (SELECT d.*, cells.* FROM decided d, cells),
    {elo_ctes(R.EloParams(), 'gg', keys='league, cell')},
    loss AS (SELECT r.league, cell, season, -LN(GREATEST(1e-15, LEAST(1 - 1e-15, CASE WHEN home_pts > away_pts THEN e ELSE 1 - e END))) AS l
    FROM r JOIN decided USING (game_id) WHERE n > 0)"""
TRAIN = [1995, 1996, 1997]


@query(
    "elo_parameter_search",
    "R-03 J-23",
    oracle(
        "decided",
        f""", {GRID_SQL}, m AS (SELECT league, cell, AVG(l) AS log_loss FROM loss WHERE season IN (1995, 1996, 1997) GROUP BY ALL)
        SELECT league, cell, ROUND(log_loss, 6) AS log_loss, k_ AS k, keep_ AS keep, home_ AS home FROM m JOIN cells USING (cell)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY league ORDER BY log_loss, cell) = 1""",
        recursive=True,
    ),
)
def _search(spark, sf_dir):
    out = R.elo_grid(views.decided(spark, sf_dir), CELLS, TRAIN, KEYS)
    return out.select("league", "cell", r6("log_loss"), "k", "keep", "home")


@query(
    "fold_ratings",
    "R-07",
    oracle(
        "decided",
        f""", {GRID_SQL}, m AS (SELECT league, fold, cell, AVG(l) AS log_loss FROM loss, (VALUES (1998), (1999)) f(fold) WHERE season < fold GROUP BY ALL),
        best AS (SELECT league, fold, cell FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY league, fold ORDER BY log_loss, cell) = 1)
        SELECT r.league, CAST(fold AS INT) AS fold, CAST(cell AS INT) AS cell, game_id, ROUND(hr, 6) AS home_elo, ROUND(ar, 6) AS away_elo
        FROM r JOIN best USING (league, cell) JOIN decided d USING (game_id) WHERE n > 0 AND d.season <= fold""",
        recursive=True,
    ),
)
def _folds(spark, sf_dir):
    out = R.fold_elo(views.decided(spark, sf_dir), CELLS, [1998, 1999], KEYS)
    return out.select("league", "fold", "cell", "game_id", r6("home_elo"), r6("away_elo"))


POISSON_SQL = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INT)" for c in __import__("pregame.operators.stats", fromlist=["x"]).POISSON_CDF)


def uniform_sql(row: str, draw: str, seed: int) -> str:
    """The hashed uniform number of ``stats.with_uniform`` (three integer steps)."""
    p = 2147483647
    rw = f"(({row}) % {p})"
    a = f"(({rw} * 48271 + {draw}::BIGINT * 40692 + {seed * 69621}) % {p})"
    b = f"(({a} * {a} + {draw}::BIGINT) % {p})"
    return f"((({b} * {b} + {rw}) % {p}) / {float(p)!r}::DOUBLE)"


def draws_sql(source: str, draws: int, seed: int, cols: str) -> str:
    """CTE body: rows of ``source`` (with row_id) times draws, weight w > 0."""
    return f"""SELECT * FROM (SELECT *, {POISSON_SQL} AS w FROM (SELECT {cols}, draw, {uniform_sql('row_id', 'draw', seed)} AS u
        FROM {source}, range({draws}) t(draw))) WHERE w > 0"""


@query(
    "expansion_offset",
    "R-04 ST-08",
    oracle(
        "decided",
        f""", {LATE_SQL}, {NEW_SQL}, {elo_ctes(R.EloParams(), 'late')}, {STATES_SQL.format(s='late')},
        ends AS (SELECT s.league, s.team, MAX_BY(rating, (game_date, game_id)) - 1500 AS x FROM states s JOIN fresh f ON f.league = s.league AND f.team = s.team AND f.first_season = s.season GROUP BY ALL),
        shown AS (SELECT x, CAST('0x' || md5(league || '|' || team)[1:8] AS BIGINT) AS row_id FROM ends),
        dr AS ({draws_sql('shown', 200, 7, 'x, row_id')}), m AS (SELECT draw, SUM(w * x) / SUM(w) AS m FROM dr GROUP BY draw),
        q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, STDDEV_SAMP(m) AS sd, COUNT(*) AS draws FROM m),
        n AS (SELECT COUNT(*) AS n, AVG(x) AS mean FROM shown)
        SELECT n, ROUND(mean, 6) AS mean, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, ROUND(sd, 6) AS sd, draws, lo <= 0 AND hi >= 0 AS spans_zero,
        ROUND(CASE WHEN lo <= 0 AND hi >= 0 THEN 0.0 ELSE mean END, 6) AS "offset" FROM n, q""",
        recursive=True,
    ),
)
def _offset(spark, sf_dir):
    gm = late_games(spark, sf_dir)
    states = R.rating_states(gm, R.elo_replay(gm, R.EloParams(), KEYS), KEYS)
    out = R.expansion_offset(states, late_newcomers(gm), KEYS, 200)
    return out.select("n", r6("mean"), r6("lo"), r6("hi"), r6("sd"), "draws", "spans_zero", r6("offset"))


@query(
    "rating_continuity",
    "R-05",
    oracle(
        "decided team_games",
        f""", {elo_ctes(R.EloParams(), 'decided')}, {STATES_SQL.format(s='decided')},
        per AS (SELECT league, team, season, MIN_BY(pre, (game_date, game_id)) AS first_rating, MAX_BY(rating, (game_date, game_id)) AS end_rating FROM states GROUP BY ALL),
        pv AS (SELECT *, LAG(end_rating) OVER (PARTITION BY league, team ORDER BY season) AS pr FROM per),
        lb AS (SELECT DISTINCT league, team, season, {LABEL_SQL} AS label FROM team_games),
        lc AS (SELECT *, COALESCE(LAG(label) OVER (PARTITION BY league, team ORDER BY season) <> label, FALSE) AS changed FROM lb)
        SELECT league, team, season, label, changed, ROUND(first_rating, 6) AS first_rating, ROUND(1500 + {2 / 3!r}::DOUBLE * (pr - 1500), 6) AS carried_rating,
        ROUND(first_rating - (1500 + {2 / 3!r}::DOUBLE * (pr - 1500)), 6) + 0.0 AS gap FROM pv JOIN lc USING (league, team, season) WHERE pr IS NOT NULL""",
        recursive=True,
    ),
)
def _continuity(spark, sf_dir):
    gm = views.decided(spark, sf_dir)
    states = R.rating_states(gm, R.elo_replay(gm, R.EloParams(), KEYS), KEYS)
    ident = rolling.identity_changes(labelled(views.team_games(spark, sf_dir)), TEAM, "season", "label")
    out = R.elo_continuity(states, ident, R.EloParams(), KEYS)
    return out.select("league", "team", "season", "label", "changed", r6("first_rating"), r6("carried_rating"), r6("gap"))


@query(
    "expansion_drift",
    "R-06",
    oracle(
        "decided",
        f""", {LATE_SQL}, {NEW_SQL}, {elo_ctes(R.EloParams(), 'late')}, {STATES_SQL.format(s='late')}
        SELECT s.league, s.team, s.season, COUNT(*) AS games, ROUND(MIN_BY(pre, (game_date, game_id)), 6) AS start_rating, ROUND(MAX_BY(rating, (game_date, game_id)), 6) AS end_rating,
        ROUND(MIN(rating), 6) AS min_rating, ROUND(MAX(rating), 6) AS max_rating,
        CASE WHEN MAX_BY(rating, (game_date, game_id)) - MIN_BY(pre, (game_date, game_id)) > 30 THEN 'starts too low'
             WHEN MAX_BY(rating, (game_date, game_id)) - MIN_BY(pre, (game_date, game_id)) < -30 THEN 'starts too high' ELSE 'settled' END AS verdict
        FROM states s JOIN fresh f ON f.league = s.league AND f.team = s.team AND f.first_season = s.season GROUP BY ALL""",
        recursive=True,
    ),
)
def _drift(spark, sf_dir):
    gm = late_games(spark, sf_dir)
    states = R.rating_states(gm, R.elo_replay(gm, R.EloParams(), KEYS), KEYS)
    out = R.expansion_drift(states, late_newcomers(gm), KEYS)
    return out.select("league", "team", "season", "games", *[r6(f"{x}_rating") for x in ("start", "end", "min", "max")], "verdict")


@query(
    "elo_alone",
    "R-08",
    oracle(
        "decided",
        f""", {elo_ctes(R.EloParams(), 'decided')}, j AS (SELECT r.game_id, hr, ar, season, home_pts - away_pts AS m FROM r JOIN decided USING (game_id) WHERE n > 0),
        fit AS (SELECT regr_slope(m, hr - ar) AS b, regr_intercept(m, hr - ar) AS a FROM j WHERE season < 1998)
        SELECT game_id, ROUND(1 / (1 + POW(10.0::DOUBLE, (ar - hr) / 400)), 6) AS elo_prob, ROUND(a + b * (hr - ar), 5) AS elo_margin FROM j, fit""",
        recursive=True,
    ),
)
def _alone(spark, sf_dir):
    gm = R.with_elo(views.decided(spark, sf_dir), R.EloParams(), KEYS)
    out = R.elo_alone(gm, F.col("season") < 1998)
    return out.select("game_id", r6("elo_prob"), F.round("elo_margin", 5).alias("elo_margin"))
