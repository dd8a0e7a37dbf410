"""Trailing windows, rest, travel and the flagship feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.operators import joins, projections, rest_travel, rolling
from pregame.operators.skew import has_hot_group, inherit
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import TEAM, TEAM_SEASON, WEEK_SQL, r6, with_week
from pregame.sources import views

ORDER = "ORDER BY game_date, game_id"
SEASON_W = f"PARTITION BY league, team, season {ORDER}"
TEAM_W = f"PARTITION BY league, team {ORDER}"


def _mean_sql(col: str, w: int, part: str, name: str) -> str:
    frame = f"({part} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"ROUND(CASE WHEN COUNT({col}) OVER {frame} = {w} THEN AVG({col}) OVER {frame} END, 6) AS {name}"


# ---- flagship -----------------------------------------------------------------------------------

FORM = ["roll5_pts", "roll5_opp_pts", "roll10_pts", "roll10_opp_pts"]


def side_features(tg: DataFrame) -> DataFrame:
    """Rolling form and rest per team-game; both windows share one shuffle per key set."""
    has_hot_group(tg, TEAM)  # one check serves both windows
    rolled = rolling.add_rolling(tg, TEAM_SEASON, ["pts", "opp_pts"], [5, 10])
    return rest_travel.rest_days(rolled, TEAM)


def game_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = side_features(views.team_games(spark, sf_dir))
    wide = joins.to_game_rows(
        feats, ["league", "season", "game_id", "game_date"], ["team", "pts", *FORM, "rest_days", "is_back_to_back"]
    )
    return projections.with_game_labels(wide)


_WIDE = ", ".join(
    f"MAX(CASE WHEN {'' if s == 'home' else 'NOT '}is_home THEN {c} END) AS {s}_{c}"
    for s in ("home", "away")
    for c in ["team", "pts", *FORM, "rest_days", "is_back_to_back"]
)


@query(
    "game_features",
    "W-02 W-07 J-06 P-06",
    oracle(
        "team_games",
        f""", feats AS (SELECT *, {_mean_sql('pts', 5, SEASON_W, 'roll5_pts')}, {_mean_sql('opp_pts', 5, SEASON_W, 'roll5_opp_pts')},
        {_mean_sql('pts', 10, SEASON_W, 'roll10_pts')}, {_mean_sql('opp_pts', 10, SEASON_W, 'roll10_opp_pts')},
        CAST(LEAST(game_date - LAG(game_date) OVER ({TEAM_W}), CASE WHEN LAG(game_date) OVER ({TEAM_W}) IS NOT NULL THEN 7 END) AS INT) AS rest_days,
        COALESCE(game_date - LAG(game_date) OVER ({TEAM_W}) = 1, FALSE) AS is_back_to_back FROM team_games),
        wide AS (SELECT league, season, game_id, game_date, {_WIDE} FROM feats GROUP BY ALL)
        SELECT *, home_pts - away_pts AS margin, home_pts + away_pts AS total,
        CASE WHEN home_pts <> away_pts THEN CAST(home_pts > away_pts AS INT) END AS home_win FROM wide""",
    ),
)
def _game_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = game_features(spark, sf_dir)
    return df.select(*[r6(c) if "roll" in c else F.col(c) for c in df.columns])


# ---- trailing windows ---------------------------------------------------------------------------


@query(
    "trailing_mean",
    "W-01",
    oracle("team_games", f"SELECT league, game_id, team, {_mean_sql('pts', 5, SEASON_W, 'roll5_pts')} FROM team_games"),
)
def _trailing_mean(spark, sf_dir):
    out = rolling.trailing_mean(views.team_games(spark, sf_dir), TEAM_SEASON, "pts", 5, "roll5_pts")
    return out.select("league", "game_id", "team", r6("roll5_pts"))


@query(
    "rolling_season",
    "W-02",
    oracle(
        "team_games",
        f"""SELECT league, game_id, team, {', '.join(_mean_sql(m, w, SEASON_W, f'roll{w}_{m}') for w in (5, 10) for m in ('pts', 'opp_pts'))}
        FROM team_games""",
    ),
)
def _rolling_season(spark, sf_dir):
    out = rolling.add_rolling(views.team_games(spark, sf_dir), TEAM_SEASON, ["pts", "opp_pts"], [5, 10])
    return out.select("league", "game_id", "team", *[r6(f"roll{w}_{m}") for w in (5, 10) for m in ("pts", "opp_pts")])


@query(
    "rolling_career",
    "W-03",
    oracle(
        "team_games",
        f"SELECT league, game_id, team, {', '.join(_mean_sql('pts', w, TEAM_W, f'carry{w}_pts') for w in (3, 5, 8, 10))} FROM team_games",
    ),
)
def _rolling_career(spark, sf_dir):
    out = rolling.add_rolling(views.team_games(spark, sf_dir), TEAM, ["pts"], [3, 5, 8, 10], "carry")
    return out.select("league", "game_id", "team", *[r6(f"carry{w}_pts") for w in (3, 5, 8, 10)])


@query(
    "rolling_all_competitions",
    "W-04 S-05 U-01",
    oracle(
        "team_games",
        f"""SELECT * FROM (SELECT league, game_id, team, CASE WHEN game_id % 5 = 0 THEN 'cup' ELSE 'regular' END AS competition,
        {_mean_sql('pts', 5, TEAM_W, 'all5_pts')} FROM team_games) WHERE competition = 'regular'""",
    ),
)
def _rolling_all(spark, sf_dir):
    from pregame.operators.sets import union_competitions

    tg = views.team_games(spark, sf_dir)
    cup = F.col("game_id") % 5 == 0
    both = union_competitions({"regular": tg.filter(~cup), "cup": tg.filter(cup)})
    out = rolling.add_rolling_all_competitions(both, TEAM, ["pts"], [5], "competition", "regular")
    return out.select("league", "game_id", "team", "competition", r6("all5_pts"))


PLAYER_SEASON = ["player_id", "season"]
_PW = f"PARTITION BY player_id, season {ORDER}"


@query(
    "player_trailing_minutes",
    "W-05",
    oracle(
        "players",
        f""", app AS (SELECT player_id, season, game_id, game_date, {_mean_sql('mins', 5, _PW, 'roll5_mins')},
        {_mean_sql('pts', 5, _PW, 'roll5_pts')} FROM players WHERE NOT is_absent)
        SELECT p.player_id, p.game_id, p.is_absent,
        LAST_VALUE(a.roll5_mins IGNORE NULLS) OVER w AS roll5_mins, LAST_VALUE(a.roll5_pts IGNORE NULLS) OVER w AS roll5_pts
        FROM players p LEFT JOIN app a USING (player_id, season, game_id)
        WINDOW w AS (PARTITION BY p.player_id, p.season ORDER BY p.game_date, p.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
)
def _player_trailing(spark, sf_dir):
    p = views.players(spark, sf_dir).withColumn("played", ~F.col("is_absent"))
    out = rolling.trailing_appearance_mean(p, PLAYER_SEASON, "played", ["mins", "pts"], 5)
    return out.select("player_id", "game_id", "is_absent", r6("roll5_mins"), r6("roll5_pts"))


@query(
    "warmup_accounting",
    "W-06 Q-30",
    oracle(
        "team_games",
        f""", r AS (SELECT league, team, season, {_mean_sql('pts', 5, SEASON_W, 'm')} FROM team_games)
        SELECT league, team, season, COUNT(*) AS games, COUNT(*) FILTER (m IS NULL) AS nulls, LEAST(COUNT(*), 5) AS expected
        FROM r GROUP BY ALL""",
    ),
)
def _warmup(spark, sf_dir):
    out = rolling.trailing_mean(views.team_games(spark, sf_dir), TEAM_SEASON, "pts", 5, "m")
    return rolling.expected_warmup(out, TEAM_SEASON, "m", 5)


@query(
    "gap_reach",
    "W-26 J-07",
    oracle(
        "team_games",
        f""", u AS (SELECT *, CASE WHEN game_id % 29 <> 0 THEN pts END AS fact FROM team_games),
        r AS (SELECT league, team, season, {_mean_sql('fact', 5, SEASON_W, 'm')} FROM u),
        s AS (SELECT league, team, season, COUNT(*) FILTER (m IS NULL) AS nulls, LEAST(COUNT(*), 5) AS expected FROM r GROUP BY ALL)
        SELECT season, CAST(SUM(nulls) AS BIGINT) AS nulls, CAST(SUM(expected) AS BIGINT) AS expected,
        CAST(SUM(nulls) - SUM(expected) AS BIGINT) AS beyond_warmup FROM s GROUP BY season""",
    ),
)
def _gap_reach(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    facts = tg.filter(F.col("game_id") % 29 != 0).select("league", "game_id", "team", F.col("pts").alias("fact"))
    full = joins.reindex_to_universe(tg, facts, ["league", "game_id", "team"])
    out = rolling.trailing_mean(full, TEAM_SEASON, "fact", 5, "m")
    return rolling.gap_reach(out, TEAM, "season", "m", 5)


@query(
    "team_window",
    "W-21",
    oracle(
        "team_games",
        f""", v AS (SELECT *, pts - opp_pts AS margin, CASE wl WHEN 'W' THEN 1.0 WHEN 'L' THEN 0.0 ELSE 0.5 END AS wr FROM team_games)
        SELECT league, game_id, team, {_mean_sql('pts', 5, SEASON_W, 's5_pf')}, {_mean_sql('opp_pts', 5, SEASON_W, 's5_pa')},
        {_mean_sql('margin', 5, SEASON_W, 's5_margin')}, {_mean_sql('wr', 5, SEASON_W, 's5_win_rate')} FROM v""",
    ).replace("1.0", "1.0::DOUBLE"),
)
def _team_window(spark, sf_dir):
    out = rolling.team_window(views.team_games(spark, sf_dir), TEAM_SEASON, [5], "s")
    return out.select("league", "game_id", "team", *[r6(f"s5_{m}") for m in ("pf", "pa", "margin", "win_rate")])


@query(
    "prior_counts",
    "W-22",
    oracle(
        "team_games",
        f"""SELECT league, game_id, team, ROW_NUMBER() OVER ({TEAM_W}) - 1 AS prior_career,
        ROW_NUMBER() OVER ({SEASON_W}) - 1 AS prior_season FROM team_games""",
    ),
)
def _prior_counts(spark, sf_dir):
    out = rolling.prior_counts(views.team_games(spark, sf_dir), TEAM)
    return out.select("league", "game_id", "team", "prior_career", "prior_season")


# ---- rest and travel ----------------------------------------------------------------------------


@query(
    "rest_days",
    "W-07",
    oracle(
        "team_games",
        f""", g AS (SELECT *, CAST(game_date - LAG(game_date) OVER ({TEAM_W}) AS INT) AS raw FROM team_games)
        SELECT league, game_id, team, CASE WHEN raw IS NOT NULL THEN LEAST(raw, 7) END AS rest_days,
        COALESCE(raw = 1, FALSE) AS is_back_to_back FROM g""",
    ),
)
def _rest_days(spark, sf_dir):
    out = rest_travel.rest_days(views.team_games(spark, sf_dir), TEAM)
    return out.select("league", "game_id", "team", "rest_days", "is_back_to_back")


@query(
    "season_rest",
    "W-08",
    oracle(
        "team_games",
        f""", g AS (SELECT *, CAST(game_date - LAG(game_date) OVER ({SEASON_W}) AS INT) AS raw FROM team_games)
        SELECT league, game_id, team, raw AS rest_raw, CASE WHEN raw IS NOT NULL THEN LEAST(raw, 7) END AS rest_days,
        COALESCE(raw > 10, FALSE) AS is_long_break, COALESCE(raw = 1, FALSE) AS is_back_to_back, raw > 7 AS long_or_null FROM g""",
    ),
)
def _season_rest(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    a = rest_travel.season_rest(tg, TEAM_SEASON).withColumn("long_or_null", F.col("rest_raw") > 7)
    return a.select("league", "game_id", "team", "rest_raw", "rest_days", "is_long_break", "is_back_to_back", "long_or_null")


@query(
    "season_rest_null_opener",
    "W-08",
    oracle(
        "team_games",
        f""", g AS (SELECT *, CAST(game_date - LAG(game_date) OVER ({SEASON_W}) AS INT) AS raw FROM team_games)
        SELECT league, game_id, team, raw > 7 AS is_long_break FROM g""",
    ),
)
def _season_rest_null(spark, sf_dir):
    out = rest_travel.season_rest(views.team_games(spark, sf_dir), TEAM_SEASON, long_break=7, null_opener=True)
    return out.select("league", "game_id", "team", "is_long_break")


@query(
    "weekly_rest",
    "W-09",
    oracle(
        "team_games",
        f""", w AS (SELECT *, {WEEK_SQL} AS week FROM team_games),
        g AS (SELECT *, CAST(game_date - LAG(game_date) OVER ({SEASON_W}) AS INT) AS raw, week - LAG(week) OVER ({SEASON_W}) AS gap FROM w)
        SELECT league, game_id, team, raw AS rest_days, COALESCE(CAST(raw <= 5 AS INT), 0) AS short_week,
        COALESCE(CAST(gap >= 2 AS INT), 0) AS off_bye, CAST(raw IS NULL AS INT) AS season_opener FROM g""",
    ),
)
def _weekly_rest(spark, sf_dir):
    out = rest_travel.weekly_rest(with_week(views.team_games(spark, sf_dir)), TEAM_SEASON)
    return out.select("league", "game_id", "team", "rest_days", "short_week", "off_bye", "season_opener")


@query(
    "dense_rest",
    "W-10",
    oracle(
        "team_games",
        f""", g AS (SELECT *, CAST(game_date - LAG(game_date) OVER ({TEAM_W}) AS INT) AS raw,
        COUNT(*) OVER (PARTITION BY league, team ORDER BY game_date - DATE '1970-01-01' RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n3
        FROM team_games)
        SELECT league, game_id, team, CASE WHEN raw IS NOT NULL THEN LEAST(raw, 7) END AS rest_days, raw <= 1 AS is_back_to_back,
        CASE WHEN raw IS NOT NULL THEN n3 >= 2 END AS is_third_in_four FROM g""",
    ),
)
def _dense_rest(spark, sf_dir):
    out = rest_travel.dense_rest(views.team_games(spark, sf_dir), TEAM)
    return out.select("league", "game_id", "team", "rest_days", "is_back_to_back", "is_third_in_four")


@query(
    "games_last_7",
    "W-14",
    oracle(
        "team_games",
        """SELECT league, game_id, team, COUNT(*) OVER (PARTITION BY league, team ORDER BY game_date - DATE '1970-01-01'
        RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS games_last_7 FROM team_games""",
    ),
)
def _games_last_7(spark, sf_dir):
    out = rest_travel.games_in_window(views.team_games(spark, sf_dir), TEAM, 7)
    return out.select("league", "game_id", "team", "games_last_7")


_OFF = "(EPOCH(game_date::TIMESTAMP + INTERVAL 19 HOUR) - EPOCH(timezone({z}, game_date::TIMESTAMP + INTERVAL 19 HOUR))) / 3600.0"


@query(
    "travel",
    "W-11 W-12 J-09 J-10 F-17 F-18",
    oracle(
        "team_games arenas",
        f""", v AS (SELECT t.*, CASE WHEN is_home THEN t.team ELSE opp END AS venue FROM team_games t),
        p AS (SELECT v.*, lat, lon, zone FROM v JOIN arenas a ON a.team = v.venue),
        q AS (SELECT *, LAG(venue) OVER w AS prev_venue, LAG(lat) OVER w AS plat, LAG(lon) OVER w AS plon, LAG(zone) OVER w AS pzone
              FROM p WINDOW w AS ({SEASON_W})),
        h AS (SELECT *, POW(SIN((RADIANS(lat) - RADIANS(plat)) / 2), 2)
              + COS(RADIANS(plat)) * COS(RADIANS(lat)) * POW(SIN((RADIANS(lon) - RADIANS(plon)) / 2), 2) AS a FROM q)
        SELECT league, game_id, team, venue, prev_venue,
        ROUND(CASE WHEN prev_venue = venue THEN 0.0 WHEN prev_venue IS NOT NULL THEN 2 * 6371.0088 * ASIN(SQRT(LEAST(a, 1.0))) END, 6) AS travel_km,
        {_OFF.format(z='zone')} - {_OFF.format(z='pzone')} AS tz_shift FROM h""",
    ),
)
def _travel(spark, sf_dir):
    out = rest_travel.travel(views.team_games(spark, sf_dir), TEAM_SEASON, views.arenas(spark, sf_dir))
    return out.select("league", "game_id", "team", "venue", "prev_venue", r6("travel_km"), "tz_shift")


@query(
    "road_trip",
    "W-13",
    oracle(
        "team_games",
        f""", i AS (SELECT *, SUM(CAST(is_home AS INT)) OVER ({SEASON_W}) AS island FROM team_games)
        SELECT league, game_id, team, CAST(CASE WHEN is_home THEN 0 ELSE
        SUM(CAST(NOT is_home AS INT)) OVER (PARTITION BY league, team, season, island {ORDER}) END AS INT) AS road_trip FROM i""",
    ),
)
def _road_trip(spark, sf_dir):
    out = rest_travel.road_trip(views.team_games(spark, sf_dir), TEAM_SEASON)
    return out.select("league", "game_id", "team", "road_trip")


# ---- players ------------------------------------------------------------------------------------

PLAYER_TEAM = ["player_id", "team"]
_MARGIN_SQL = "CASE WHEN p.game_id % 2 = 0 THEN g.home_pts - g.away_pts ELSE g.away_pts - g.home_pts END"


def players_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows with a team margin: the player's side is home for even games."""
    gm = views.played(spark, sf_dir).select("game_id", (F.col("home_pts") - F.col("away_pts")).alias("_m"))
    side = F.when(F.col("game_id") % 2 == 0, F.col("_m")).otherwise(-F.col("_m"))
    return views.players(spark, sf_dir).join(gm, "game_id").withColumn("team_margin", side).drop("_m")


_ON_OFF_SQL = f"""m AS (SELECT p.*, {_MARGIN_SQL} AS team_margin FROM players p JOIN played g USING (game_id)),
    c AS (SELECT *, COALESCE(SUM(CASE WHEN NOT is_absent THEN team_margin ELSE 0 END) OVER w, 0) AS s_on,
    COUNT(*) FILTER (NOT is_absent) OVER w AS n_on, COALESCE(SUM(CASE WHEN is_absent THEN team_margin ELSE 0 END) OVER w, 0) AS s_off,
    COUNT(*) FILTER (is_absent) OVER w AS n_off FROM m
    WINDOW w AS (PARTITION BY player_id, team {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    oo AS (SELECT *, CASE WHEN n_on >= 10 AND n_off >= 5 THEN s_on / n_on - s_off / n_off END AS on_off FROM c)"""


@query("on_off", "W-15", oracle("players played", f", {_ON_OFF_SQL} SELECT player_id, game_id, ROUND(on_off, 6) AS on_off FROM oo"))
def _on_off(spark, sf_dir):
    out = rolling.on_off(players_with_margin(spark, sf_dir), PLAYER_TEAM, "team_margin", "is_absent")
    return out.select("player_id", "game_id", r6("on_off"))


def weighted_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows with trailing minutes, PRA, on/off and the weight variants."""
    p = players_with_margin(spark, sf_dir).withColumns(
        {"pra": F.col("pts") + F.col("reb") + F.col("ast"), "played": ~F.col("is_absent")}
    )
    # one count and one shuffle by player serve all three windows; a hot player keeps the shuffles of the finer keys
    if not has_hot_group(p, ["player_id"]):
        p = inherit(p.repartition("player_id"), p)
    rolled = rolling.trailing_appearance_mean(p, PLAYER_SEASON, "played", ["mins", "pra"], 5)
    rolled = inherit(rolled.withColumnsRenamed({"roll5_mins": "roll_mins", "roll5_pra": "roll_pra"}), rolled)
    return rolling.absence_weights(rolling.on_off(rolled, PLAYER_TEAM, "team_margin", "is_absent"))


WEIGHTS_SQL = f"""{_ON_OFF_SQL},
    app AS (SELECT player_id, season, game_id, {_mean_sql('mins', 5, _PW, 'a_mins').replace('ROUND(', '(').replace(', 6)', ')')},
    {_mean_sql('(pts + reb + ast)', 5, _PW, 'a_pra').replace('ROUND(', '(').replace(', 6)', ')')} FROM m WHERE NOT is_absent),
    ff AS (SELECT oo.*, LAST_VALUE(a_mins IGNORE NULLS) OVER w AS roll_mins, LAST_VALUE(a_pra IGNORE NULLS) OVER w AS roll_pra
    FROM oo LEFT JOIN app USING (player_id, season, game_id)
    WINDOW w AS (PARTITION BY oo.player_id, oo.season ORDER BY oo.game_date, oo.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    weighted AS (SELECT *, roll_mins AS w_minutes, roll_pra AS w_pra, CASE WHEN roll_mins >= 1 THEN roll_pra / roll_mins END AS w_rate,
    COALESCE(on_off, CASE WHEN roll_mins >= 1 THEN roll_pra / roll_mins END) AS w_on_off FROM ff)"""


@query(
    "absence_weights",
    "W-16",
    oracle(
        "players played",
        f""", {WEIGHTS_SQL} SELECT player_id, game_id, ROUND(w_minutes, 6) AS w_minutes, ROUND(w_pra, 6) AS w_pra,
        ROUND(w_rate, 6) AS w_rate, ROUND(w_on_off, 6) AS w_on_off FROM weighted""",
    ),
)
def _absence_weights(spark, sf_dir):
    out = weighted_players(spark, sf_dir)
    return out.select("player_id", "game_id", *[r6(c) for c in ("w_minutes", "w_pra", "w_rate", "w_on_off")])


# ---- ranks, openers, records --------------------------------------------------------------------


@query(
    "rank_in_game",
    "W-17",
    oracle(
        "players",
        """SELECT game_id, team, player_id, ROW_NUMBER() OVER (PARTITION BY game_id, team ORDER BY mins DESC NULLS LAST, player_id) AS rank
        FROM players""",
    ),
)
def _rank(spark, sf_dir):
    out = rolling.rank_in_group(
        views.players(spark, sf_dir), ["game_id", "team"], [F.col("mins").desc_nulls_last(), F.col("player_id")]
    )
    return out.select("game_id", "team", "player_id", "rank")


@query(
    "season_openers",
    "W-18",
    oracle(
        "team_games",
        f"""SELECT league, team, season, game_id, game_date, pts FROM team_games
        QUALIFY ROW_NUMBER() OVER ({SEASON_W}) = 1""",
    ),
)
def _openers(spark, sf_dir):
    tg = views.team_games(spark, sf_dir).select("league", "team", "season", "game_id", "game_date", "pts")
    return rolling.openers(tg, TEAM_SEASON)


LABEL_SQL = "'T' || team || CASE WHEN team % 2 = 0 AND season >= 1998 THEN 'B' ELSE 'A' END"


def labelled(tg: DataFrame) -> DataFrame:
    """Team-games with a label that changes in 1998 for even teams."""
    late = (F.col("team") % 2 == 0) & (F.col("season") >= 1998)
    return tg.withColumn("label", F.concat(F.lit("T"), F.col("team").cast("string"), F.when(late, "B").otherwise("A")))


@query(
    "identity_changes",
    "W-19",
    oracle(
        "team_games",
        f""", s AS (SELECT DISTINCT league, team, season, {LABEL_SQL} AS label FROM team_games)
        SELECT *, LAG(label) OVER w AS previous, LAG(season) OVER w IS NULL AS first_season,
        COALESCE(LAG(label) OVER w <> label, FALSE) AS changed FROM s WINDOW w AS (PARTITION BY league, team ORDER BY season)""",
    ),
)
def _identity_changes(spark, sf_dir):
    return rolling.identity_changes(labelled(views.team_games(spark, sf_dir)), TEAM, "season", "label")


_CUM = f"""c AS (SELECT *, CAST(SUM(CAST(wl = 'W' AS INT)) OVER w AS BIGINT) AS cum_w, CAST(SUM(CAST(wl = 'L' AS INT)) OVER w AS BIGINT) AS cum_l,
    CAST(SUM(CAST(wl = 'T' AS INT)) OVER w AS BIGINT) AS cum_t, ROW_NUMBER() OVER w AS rn FROM team_games
    WINDOW w AS (PARTITION BY league, team, season {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, CASE WHEN rn % 3 = 0 THEN cum_w + CASE WHEN rn >= 12 THEN 1 ELSE 0 END END AS st_w,
    CASE WHEN rn % 3 = 0 THEN cum_l END AS st_l, CASE WHEN rn % 3 = 0 THEN cum_t END AS st_t FROM c)"""


def stated_records(tg: DataFrame) -> DataFrame:
    """Records stated on every third game, one win too many from the twelfth on."""
    from pregame.operators.skew import running_sums

    c = running_sums(
        tg, TEAM_SEASON, "game_date", ["game_id"],
        {
            "rn": F.lit(1),
            "_w": F.when(F.col("wl") == "W", 1).otherwise(0),
            "_l": F.when(F.col("wl") == "L", 1).otherwise(0),
            "_t": F.when(F.col("wl") == "T", 1).otherwise(0),
        },
        inclusive=True,
    )
    third = F.col("rn") % 3 == 0
    return c.select(
        *tg.columns,
        F.when(third, F.col("_w") + F.when(F.col("rn") >= 12, 1).otherwise(0)).alias("st_w"),
        F.when(third, F.col("_l")).alias("st_l"),
        F.when(third, F.col("_t")).alias("st_t"),
    )


_STATED = {"W": "st_w", "L": "st_l", "T": "st_t"}


@query(
    "running_record",
    "W-20 Q-27",
    oracle(
        "team_games",
        f""", {_CUM} SELECT league, team, game_id, cum_w, cum_l, cum_t,
        COALESCE(st_w <> cum_w OR st_l <> cum_l OR st_t <> cum_t, FALSE) AS diverges FROM s""",
    ),
)
def _running_record(spark, sf_dir):
    out = rolling.running_record(stated_records(views.team_games(spark, sf_dir)), TEAM_SEASON, _STATED, reanchor=False)
    return out.select("league", "team", "game_id", "cum_w", "cum_l", "cum_t", "diverges")


@query(
    "running_record_reanchored",
    "W-20 Q-27",
    oracle(
        "team_games",
        f""", {_CUM}, g AS (SELECT *, st_w - cum_w AS gw, LAG(st_w - cum_w IGNORE NULLS) OVER ({SEASON_W}) AS pw FROM s)
        SELECT league, team, game_id, COALESCE(gw <> COALESCE(pw, 0), FALSE) AS diverges FROM g""",
    ),
)
def _running_record_re(spark, sf_dir):
    out = rolling.running_record(stated_records(views.team_games(spark, sf_dir)), TEAM_SEASON, _STATED, reanchor=True)
    return out.select("league", "team", "game_id", "diverges")


@query(
    "time_tail_split",
    "W-24",
    oracle(
        "played",
        """SELECT league, game_id, ROW_NUMBER() OVER (PARTITION BY league ORDER BY game_date DESC, game_id DESC) <= 200 AS is_tail,
        ROW_NUMBER() OVER (PARTITION BY league ORDER BY game_date DESC, game_id DESC)
        <= FLOOR(COUNT(*) OVER (PARTITION BY league) * 0.15::DOUBLE) AS is_tail_share FROM played""",
    ),
)
def _time_tail(spark, sf_dir):
    gm = views.played(spark, sf_dir).select("league", "game_id", "game_date")
    a = rolling.time_tail_split(gm, n=200, by=["league"])
    b = rolling.time_tail_split(a.withColumnRenamed("is_tail", "_t"), fraction=0.15, by=["league"])
    return b.select("league", "game_id", F.col("_t").alias("is_tail"), F.col("is_tail").alias("is_tail_share"))


@query(
    "sample_dates",
    "W-25",
    oracle(
        "played",
        """, d AS (SELECT DISTINCT season, game_date FROM played),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date) - 1 AS i, COUNT(*) OVER (PARTITION BY season) AS n FROM d)
        SELECT season, game_date FROM r WHERE i IN (FLOOR((n - 1) * 0.1::DOUBLE), FLOOR((n - 1) * 0.5::DOUBLE), FLOOR((n - 1) * 0.9::DOUBLE))""",
    ),
)
def _sample_dates(spark, sf_dir):
    return rolling.sample_dates(views.played(spark, sf_dir))
