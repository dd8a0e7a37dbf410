"""Scalar column functions: seasons, ids, text fields, clock times, distances and probabilities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- seasons ------------------------------------------------------------------------------------


def season_from_date(day: Column, first_month: int) -> Column:
    """Season start year: months before ``first_month`` belong to the previous year's season."""
    return (F.year(day) - (F.month(day) < first_month).cast("int")).cast("int")


def season_from_id(game_id: Column, day: Column) -> Column:
    """Season from the two-digit year in characters 4-5 of a padded id.

    The century is the date's; a year that is not the date's own or the one before belongs to the
    previous century. NULL when the id has no two digits there.
    """
    two = F.substring(canon_id(game_id), 4, 2).try_cast("int")
    guess = F.floor(F.year(day) / 100).cast("int") * 100 + two
    return F.when((F.year(day) - guess).between(0, 1), guess).when(two.isNotNull(), guess - 100).cast("int")


def season_of_game(game_id: Column, day: Column, first_month: int) -> Column:
    """The id decides; the date rule is the fallback."""
    return F.coalesce(season_from_id(game_id, day), season_from_date(day, first_month))


def season_label(season: Column, dash: str = "-") -> Column:
    """``2025-26``; pass an en dash for the other spelling."""
    tail = F.lpad(F.pmod(season + 1, F.lit(100)).cast("string"), 2, "0")
    return F.concat(season.cast("string"), F.lit(dash), tail)


def season_start_of_label(label: Column) -> Column:
    return F.regexp_extract(label, r"^(\d{4})", 1).try_cast("int")


def season_first_day(season: Column) -> Column:
    return F.make_date(season, F.lit(9), F.lit(1))


def season_last_day(season: Column) -> Column:
    return F.make_date(season + 1, F.lit(8), F.lit(31))


def date_in_season(season: Column, month: Column, day: Column, first_month: int) -> Column:
    """Month and day without a year: months before ``first_month`` fall in the next year."""
    return F.make_date(season + (month < first_month).cast("int"), month, day)


# ---- ids and keys -------------------------------------------------------------------------------


def canon_id(col: Column) -> Column:
    """The ten-character spelling of a game id (longer ids are kept whole)."""
    text = F.trim(col.cast("string"))
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def id_number(col: Column) -> Column:
    return col.try_cast("bigint")


def type_digit(col: Column) -> Column:
    """Competition type: third character of the ten-character id."""
    return F.substring(canon_id(col), 3, 1)


def composite_id(season: Column, week: Column, away: Column, home: Column) -> Column:
    clean = F.regexp_replace(week.cast("string"), r"\W+", "")
    return F.concat_ws("_", season.cast("string"), clean, away.cast("string"), home.cast("string"))


def pair_key(a: Column, b: Column) -> Column:
    """The same text for both orders of a pair of teams."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


# ---- text fields --------------------------------------------------------------------------------


def is_home_matchup(matchup: Column) -> Column:
    return matchup.contains("vs.")


def minutes_from_clock(text: Column) -> Column:
    """``MM:SS`` to minutes; bare minutes pass through; blank is NULL."""
    parts = F.split(F.trim(text), ":")
    seconds = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double") / 60).otherwise(0.0)
    return F.get(parts, F.lit(0)).try_cast("double") + seconds


def has_value(text: Column) -> Column:
    """Participation: the field is neither NULL nor blank."""
    return F.trim(F.coalesce(text.cast("string"), F.lit(""))) != ""


@F.pandas_udf(T.StringType())
def _strip_accents(names: pd.Series) -> pd.Series:
    def fold(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    return names.map(fold)


def fold_name(name: Column) -> Column:
    """Accents stripped, case folded, white space collapsed. The only text step Spark has no built-in for."""
    return F.trim(F.regexp_replace(_strip_accents(name), r"\s+", " "))


def forename_first(name: Column) -> Column:
    """``Surname, Forename`` to ``Forename Surname``; other spellings unchanged."""
    return F.trim(F.regexp_replace(name, r"^\s*([^,]*?)\s*,\s*(.*)$", "$2 $1"))


# Fixed pattern: result letter, score for, any dash, score against.
RESULT_PATTERN = r"^([WLT])\s*(\d+)[–−-](\d+)"
# Fixed pattern: two scores with any dash and an optional end marker.
SCORE_PATTERN = r"(\d+)\s*[–−-]\s*(\d+)(?:\s*\(?(OT|SO)\)?)?"


def result_fields(text: Column) -> Column:
    """struct(outcome, points_for, points_against); NULL members when the text does not match."""
    return F.struct(
        F.nullif(F.regexp_extract(text, RESULT_PATTERN, 1), F.lit("")).alias("outcome"),
        F.regexp_extract(text, RESULT_PATTERN, 2).try_cast("int").alias("points_for"),
        F.regexp_extract(text, RESULT_PATTERN, 3).try_cast("int").alias("points_against"),
    )


def score_fields(text: Column) -> Column:
    """struct(first, second, game_end); the end is REG without a marker."""
    end = F.regexp_extract(text, SCORE_PATTERN, 3)
    return F.struct(
        F.regexp_extract(text, SCORE_PATTERN, 1).try_cast("int").alias("first"),
        F.regexp_extract(text, SCORE_PATTERN, 2).try_cast("int").alias("second"),
        F.when(end == "", "REG").otherwise(end).alias("game_end"),
    )


# Fixed pattern: field, team and value of one standings template entry.
STANDING_PATTERN = r"(win|loss|OTloss|gf|ga)_([A-Z]{2,4})\s*=\s*(\d+)"


def standing_triples(text: Column) -> Column:
    """array<struct<field, team, value>> of every entry in a page's text."""
    field = F.regexp_extract_all(text, F.lit(STANDING_PATTERN), F.lit(1))
    team = F.regexp_extract_all(text, F.lit(STANDING_PATTERN), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(STANDING_PATTERN), F.lit(3))
    zipped = F.arrays_zip(field.alias("field"), team.alias("team"), value.alias("value"))
    return F.transform(
        zipped,
        lambda x: F.struct(
            x["field"].alias("field"), x["team"].alias("team"), x["value"].cast("int").alias("value")
        ),
    )


def page_stamp(text: Column) -> Column:
    """The ``update = ...`` value of a page, NULL when absent."""
    return F.nullif(F.trim(F.regexp_extract(text, r"update\s*=\s*([^|\n}]*)", 1)), F.lit(""))


def recap_sides(slug: Column) -> Column:
    """``away-at-home-yyyy...`` slug to struct(away, home)."""
    pattern = r"^([a-z0-9]+)-(?:at|vs)-([a-z0-9]+)"
    return F.struct(
        F.nullif(F.regexp_extract(slug, pattern, 1), F.lit("")).alias("away"),
        F.nullif(F.regexp_extract(slug, pattern, 2), F.lit("")).alias("home"),
    )


def side_of(team: Column, away: Column, home: Column) -> Column:
    return F.when(team == home, "home").when(team == away, "away")


# ---- clock times --------------------------------------------------------------------------------


def kickoff_utc(day: Column, local: Column, zone: Column) -> Column:
    """Local kick-off text (``8:20 p.m.``) and zone to a UTC timestamp; TBD or unreadable is NULL."""
    pattern = r"^\s*(\d{1,2}):(\d{2})\s*([ap])\.?m"
    low = F.lower(local)
    hour = F.regexp_extract(low, pattern, 1).try_cast("int") % 12
    hour = hour + F.when(F.regexp_extract(low, pattern, 3) == "p", 12).otherwise(0)
    minute = F.regexp_extract(low, pattern, 2).try_cast("int")
    wall = F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0))
    return F.when(hour.isNotNull() & minute.isNotNull(), F.to_utc_timestamp(wall, zone))


def day_end_utc(day: Column, zone: str = "America/Los_Angeles") -> Column:
    """Midnight after ``day`` in ``zone``, as UTC."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def utc_offset_hours(day: Column, zone: Column, hour: int = 19) -> Column:
    """UTC offset of a zone on a date, taken at ``hour`` local time."""
    wall = F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(0), F.lit(0))
    return (F.unix_seconds(wall) - F.unix_seconds(F.to_utc_timestamp(wall, zone))) / 3600.0


# ---- arithmetic ---------------------------------------------------------------------------------

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (
        F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def elo_expectation(own: Column, other: Column, home_edge: float | Column = 0.0) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own - home_edge) / 400.0))


def mov_multiplier(margin: Column, winner_edge: Column) -> Column:
    """Margin-of-victory factor; 0 for a tie, because ln(1) = 0."""
    return F.log(F.abs(margin) + 1) * 2.2 / (0.001 * winner_edge + 2.2)


def result_with_end(goals_for: Column, goals_against: Column, end: Column) -> Column:
    """W, L or OTL."""
    return F.when(goals_for > goals_against, "W").when(end == "REG", "L").otherwise("OTL")


def clip_probability(p: Column, eps: float = 1e-15) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    q = clip_probability(p, eps)
    return F.log(q / (1 - q))


# Coefficients of Hart's rational approximation, numerator and denominator.
_HART_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a column expression (absolute error below 1e-14)."""

    def poly(coefs: list[float], x: Column) -> Column:
        out: Column = F.lit(coefs[0])
        for c in coefs[1:]:
            out = out * x + F.lit(c)
        return out

    x = F.abs(z)
    tail = F.exp(-x * x / 2)
    near = tail * poly(_HART_NUM, x) / poly(_HART_DEN, x)
    far = tail / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    lower = F.when(x > 37, 0.0).when(x < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - lower).otherwise(lower)


def implied_points(rating: Column, possessions: Column) -> Column:
    return rating * possessions / 100.0


def same_text_number(cell: Column) -> Column:
    """One spelling per value: numbers by value (``1`` = ``1.0``), other text trimmed, blank as NULL."""
    text = F.trim(cell.cast("string"))
    return F.coalesce(text.try_cast("double").cast("string"), F.nullif(text, F.lit("")))


# ---- blocked-by JSON ----------------------------------------------------------------------------

BLOCKED_SCHEMA = "array<struct<side:string,franchise_id:bigint,code:string,pending:array<string>>>"


def blocked_to_json(col: Column) -> Column:
    return F.to_json(col)


def blocked_from_json(text: Column) -> Column:
    """Unreadable or missing JSON is an empty array, never a failure."""
    empty = F.array().cast(BLOCKED_SCHEMA)
    return F.coalesce(F.from_json(text, BLOCKED_SCHEMA, {"mode": "PERMISSIVE"}), empty)
