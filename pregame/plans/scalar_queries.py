"""Scalar functions, each applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.functions import scalar as S
from pregame.plans.oracle import oracle
from pregame.plans.registry import query
from pregame.plans.util import r6
from pregame.sources import views


@query(
    "season_rules",
    "F-01 F-02 F-03 V-04",
    oracle(
        "games",
        """, i AS (SELECT *, LPAD(CAST(20000000 + (season % 100) * 100000 + CASE WHEN game_id % 41 = 0 THEN 100000 ELSE 0 END + game_id % 100000 AS VARCHAR), 10, '0') AS raw_id,
        CAST(YEAR(game_date) - CASE WHEN MONTH(game_date) < 8 THEN 1 ELSE 0 END AS INT) AS by_date FROM games),
        k AS (SELECT *, (YEAR(game_date) // 100) * 100 + CAST(SUBSTR(raw_id, 4, 2) AS INT) AS guess FROM i),
        s AS (SELECT *, CAST(CASE WHEN YEAR(game_date) - guess BETWEEN 0 AND 1 THEN guess ELSE guess - 100 END AS INT) AS by_id FROM k)
        SELECT game_id, by_id, by_date, by_id - by_date AS gap FROM s WHERE by_id <> by_date""",
    ),
)
def _season_rules(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    bump = F.when(F.col("game_id") % 41 == 0, 100000).otherwise(0)
    number = F.lit(20000000) + (F.col("season") % 100) * 100000 + bump + F.col("game_id") % 100000
    raw = gm.withColumn("raw_id", S.canon_id(number))
    out = raw.select(
        "game_id",
        S.season_of_game(F.col("raw_id"), F.col("game_date"), 8).alias("by_id"),
        S.season_from_date(F.col("game_date"), 8).alias("by_date"),
    )
    return out.filter("by_id <> by_date").withColumn("gap", F.col("by_id") - F.col("by_date"))


@query(
    "season_labels",
    "F-04 F-05",
    oracle(
        "games",
        """SELECT season, season || '-' || LPAD(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label, season || '–' || LPAD(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS dashed,
        season AS start_year, make_date(season, 9, 1) AS first_day, make_date(season + 1, 8, 31) AS last_day, COUNT(*) AS games FROM games GROUP BY season""",
    ),
)
def _season_labels(spark, sf_dir):
    per = views.schedule(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("games"))
    label = S.season_label(F.col("season"))
    return per.select(
        "season", label.alias("label"), S.season_label(F.col("season"), "–").alias("dashed"),
        S.season_start_of_label(label).alias("start_year"), S.season_first_day(F.col("season")).alias("first_day"),
        S.season_last_day(F.col("season")).alias("last_day"), "games",
    )


@query(
    "clock_minutes",
    "F-06",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE ROUND(l_quantity + (l_partkey % 60) / 60.0, 6) END AS minutes
    FROM lineitem""".replace("60.0", "60.0::DOUBLE"),
)
def _clock(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))
    clock = F.when(F.col("l_returnflag") == "R", "  ").otherwise(text)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(S.minutes_from_clock(clock), "minutes"))


@query(
    "person_names",
    "F-08 F-09 V-02",
    """SELECT c_custkey, 'jose ' || replace(lower(c_name), '#', ' ') || ' saric' AS folded, 'Nikola Jokić ' || c_custkey AS forename_first FROM customer""",
)
def _names(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    spelt = F.concat(F.lit("José   "), F.regexp_replace("c_name", "#", "  "), F.lit(" ŠARIĆ "))
    turned = F.concat(F.lit("Jokić "), F.col("c_custkey").cast("string"), F.lit(", Nikola"))
    return c.select(
        "c_custkey", S.fold_name(spelt).alias("folded"), S.forename_first(turned).alias("forename_first")
    )


@query(
    "result_text",
    "F-10 F-11",
    oracle(
        "team_games",
        """SELECT game_id, team, wl AS outcome, CAST(pts AS INT) AS points_for, CAST(opp_pts AS INT) AS points_against,
        CAST(pts AS INT) AS first, CAST(opp_pts AS INT) AS second, CASE WHEN game_id % 11 = 0 THEN 'OT' ELSE 'REG' END AS game_end FROM team_games""",
    ),
)
def _results(spark, sf_dir):
    tg = views.team_games(spark, sf_dir)
    score = F.concat(F.col("pts").cast("int").cast("string"), F.lit("–"), F.col("opp_pts").cast("int").cast("string"))
    text = F.concat(F.col("wl"), F.lit(" "), score)
    with_end = F.concat(score, F.when(F.col("game_id") % 11 == 0, " (OT)").otherwise(""))
    return tg.select("game_id", "team", S.result_fields(text).alias("r"), S.score_fields(with_end).alias("s")).select(
        "game_id", "team", "r.*", "s.*"
    )


PAGE_TRIPLES_SQL = """tri AS (SELECT league, season, team, 'win' AS field, win AS value, 1 AS template FROM computed UNION ALL
    SELECT league, season, team, 'gf', gf, 1 FROM computed UNION ALL
    SELECT league, season, team, 'win', win + CASE WHEN team = 4 THEN 1 ELSE 0 END, 2 FROM computed)"""


def standing_pages(spark, sf_dir):
    """Template text per league and season: two templates, the second repeating wins (one team's differs).

    The text of a page is one line per team, so a page is as long as a league has teams.
    """
    from pregame.plans.aggregate_queries import computed_standings

    c = computed_standings(spark, sf_dir)
    code = F.concat(F.lit("T"), F.translate(F.lpad(F.col("team").cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ"))
    line1 = F.concat(
        F.lit("| win_"), code, F.lit(" = "), F.col("win").cast("string"), F.lit(" | gf_"), code, F.lit("="), F.col("gf").cast("string")
    )
    line2 = F.concat(F.lit("| win_"), code, F.lit(" = "), (F.col("win") + F.when(F.col("team") == 4, 1).otherwise(0)).cast("string"))
    lines = c.select(
        "league", "season",
        F.explode(F.array(F.struct(F.lit(1).alias("template"), line1.alias("t")), F.struct(F.lit(2).alias("template"), line2.alias("t")))).alias("x"),
    ).select("league", "season", "x.*")
    stamp = F.when(F.col("season") < 1999, "update = complete\n").otherwise("update = 2001-06-30\n")
    pages = lines.groupBy("league", "season", "template").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("body"))
    return pages.withColumn("text", F.concat(stamp, F.col("body"))).drop("body")


def page_triples(spark, sf_dir):
    pages = standing_pages(spark, sf_dir)
    t = pages.select("league", "season", "template", F.explode(S.standing_triples(F.col("text"))).alias("x"))
    back = F.translate(F.substring("x.team", 2, 2), "ABCDEFGHIJ", "0123456789").cast("int")
    return t.select("league", "season", "template", "x.field", back.alias("team"), F.col("x.value").cast("bigint").alias("value"))


def _standings_sql() -> str:
    from pregame.plans.aggregate_queries import ENDED_SIDES_SQL

    return ENDED_SIDES_SQL


@query("standings_pages", "F-12", oracle("ended_games", f", {_standings_sql()}, {PAGE_TRIPLES_SQL} SELECT * FROM tri"))
def _pages(spark, sf_dir):
    return page_triples(spark, sf_dir)


@query(
    "page_stamps",
    "F-13",
    oracle(
        "decided",
        """SELECT league, season, MIN(CASE WHEN season < 1999 THEN 'complete' ELSE '2001-06-30' END) AS stamp, BOOL_AND(season < 1999) AS complete FROM decided GROUP BY ALL""",
    ),
)
def _stamps(spark, sf_dir):
    p = standing_pages(spark, sf_dir).withColumn("stamp", S.page_stamp(F.col("text")))
    return p.groupBy("league", "season").agg(F.min("stamp").alias("stamp"), F.bool_and(F.col("stamp") == "complete").alias("complete"))


@query(
    "recap_slugs",
    "F-14",
    oracle(
        "games",
        """SELECT game_id, 't' || away_team AS away, 't' || home_team AS home, CASE WHEN game_id % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM games""",
    ),
)
def _slugs(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    slug = F.concat(
        F.lit("t"), F.col("away_team").cast("string"), F.lit("-at-t"), F.col("home_team").cast("string"), F.lit("-"), F.col("game_date").cast("string")
    )
    club = F.concat(F.lit("t"), F.when(F.col("game_id") % 2 == 0, F.col("home_team")).otherwise(F.col("away_team")).cast("string"))
    out = gm.select("game_id", S.recap_sides(slug).alias("r"), club.alias("club"))
    return out.select("game_id", "r.away", "r.home", S.side_of(F.col("club"), F.col("r.away"), F.col("r.home")).alias("side"))


@query(
    "kickoff_instants",
    "F-15 F-16 F-18",
    oracle(
        "games",
        """, z AS (SELECT *, CASE home_team % 2 WHEN 0 THEN 'America/New_York' ELSE 'America/Phoenix' END AS zone FROM games)
        SELECT game_id, CASE WHEN game_id % 5 <> 0 THEN CAST(EPOCH(timezone(zone, game_date::TIMESTAMP + INTERVAL 20 HOUR + INTERVAL 20 MINUTE)) AS BIGINT) END AS kickoff,
        CAST(EPOCH(timezone('America/Los_Angeles', game_date::TIMESTAMP + INTERVAL 1 DAY)) AS BIGINT) AS day_end,
        (EPOCH(game_date::TIMESTAMP + INTERVAL 19 HOUR) - EPOCH(timezone(zone, game_date::TIMESTAMP + INTERVAL 19 HOUR))) / 3600.0::DOUBLE AS offset_h FROM z""",
    ),
)
def _kickoffs(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    zone = F.when(F.col("home_team") % 2 == 0, "America/New_York").otherwise("America/Phoenix")
    text = F.when(F.col("game_id") % 5 == 0, "TBD").otherwise("8:20 p.m.")
    day = F.col("game_date")
    return gm.select(
        "game_id",
        F.unix_seconds(S.kickoff_utc(day, text, zone)).alias("kickoff"),
        F.unix_seconds(S.day_end_utc(day)).alias("day_end"),
        S.utc_offset_hours(day, zone).alias("offset_h"),
    )


@query(
    "team_distances",
    "F-17",
    oracle(
        "games arenas",
        """, p AS (SELECT game_id, h.lat AS la, h.lon AS lo, a.lat AS lb, a.lon AS lp FROM games JOIN arenas h ON h.team = home_team JOIN arenas a ON a.team = away_team)
        SELECT game_id, ROUND(2 * 6371.0088 * ASIN(SQRT(LEAST(1.0, POW(SIN((RADIANS(lb) - RADIANS(la)) / 2), 2)
        + COS(RADIANS(la)) * COS(RADIANS(lb)) * POW(SIN((RADIANS(lp) - RADIANS(lo)) / 2), 2)))), 6) AS km FROM p""",
    ),
)
def _distances(spark, sf_dir):
    gm = views.schedule(spark, sf_dir).select("game_id", "home_team", "away_team")
    a = views.arenas(spark, sf_dir).select("team", "lat", "lon")
    h = a.select(F.col("team").alias("home_team"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = a.select(F.col("team").alias("away_team"), F.col("lat").alias("lb"), F.col("lon").alias("lp"))
    km = S.haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return gm.join(h, "home_team").join(b, "away_team").select("game_id", r6(km, "km"))


@query(
    "elo_arithmetic",
    "F-19 F-20 F-22 F-26",
    oracle(
        "played",
        """, e AS (SELECT *, 1 / (1 + POW(10.0::DOUBLE, ((1500 + away_team * 4) - (1500 + home_team * 4) - 48.0) / 400)) AS p FROM played)
        SELECT game_id, ROUND(p, 6) AS p, ROUND(LN(ABS(home_pts - away_pts) + 1) * 2.2 / (0.001 * ((home_team - away_team) * 4.0) + 2.2), 6) AS mov,
        ROUND(LN(p / (1 - p)), 6) + 0.0 AS logit, ROUND(110.5 * home_pts / 100.0, 6) AS implied FROM e""",
    ),
)
def _elo_math(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    h, a = 1500.0 + F.col("home_team") * 4, 1500.0 + F.col("away_team") * 4
    p = S.elo_expectation(h, a, 48.0)
    return gm.select(
        "game_id",
        r6(p, "p"),
        r6(S.mov_multiplier(F.col("home_pts") - F.col("away_pts"), h - a), "mov"),
        r6(S.log_odds(p), "logit"),
        r6(S.implied_points(F.lit(110.5), F.col("home_pts")), "implied"),
    )


@query(
    "composite_ids",
    "F-24",
    oracle(
        "games",
        "SELECT game_id, season || '_' || 'Week' || (game_id % 18) || '_' || away_team || '_' || home_team AS composite FROM games",
    ),
)
def _composite(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    week = F.concat(F.lit("Week: "), (F.col("game_id") % 18).cast("string"), F.lit("."))
    return gm.select("game_id", S.composite_id(F.col("season"), week, F.col("away_team"), F.col("home_team")).alias("composite"))


@query(
    "blocked_json",
    "F-27",
    oracle(
        "fixtures",
        "SELECT game_id, CAST(CASE WHEN game_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS sides, CASE WHEN game_id % 3 <> 0 THEN 'pending' END AS code FROM fixtures",
    ),
)
def _blocked(spark, sf_dir):
    fx = views.fixtures(spark, sf_dir)
    one = F.array(
        F.struct(
            F.lit("home").alias("side"), F.col("home_team").cast("bigint").alias("franchise_id"), F.lit("pending").alias("code"),
            F.array(F.col("game_date").cast("string")).alias("pending"),
        )
    )
    text = F.when(F.col("game_id") % 3 == 0, F.lit("{not json")).otherwise(S.blocked_to_json(one))
    back = S.blocked_from_json(text)
    return fx.select("game_id", F.size(back).alias("sides"), F.get(back, F.lit(0))["code"].alias("code"))


@query(
    "canonical_cells",
    "F-28",
    oracle("games", "SELECT game_id, TRUE AS same_number, FALSE AS same_text, TRUE AS blank_is_null FROM games"),
)
def _cells(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    text = F.col("game_id").cast("string")
    spelt = F.concat(F.lit(" "), text, F.lit(".0"))
    return gm.select(
        "game_id",
        S.same_text_number(text).eqNullSafe(S.same_text_number(spelt)).alias("same_number"),
        S.same_text_number(text).eqNullSafe(S.same_text_number(F.concat(F.lit("x"), text))).alias("same_text"),
        S.same_text_number(F.lit("  ")).isNull().alias("blank_is_null"),
    )


@query("dates_without_year", "F-30", oracle("games", "SELECT game_id, game_date AS rebuilt FROM games"))
def _dates(spark, sf_dir):
    gm = views.schedule(spark, sf_dir)
    d = F.col("game_date")
    return gm.select("game_id", S.date_in_season(F.col("season"), F.month(d), F.dayofmonth(d), 8).alias("rebuilt"))


@query(
    "normal_probabilities",
    "F-23",
    None,
)
def _cdf(spark, sf_dir):
    gm = views.played(spark, sf_dir)
    z = (F.col("home_pts") - F.col("away_pts")) / 40.0
    return gm.select("game_id", S.normal_cdf(z).alias("p"))
