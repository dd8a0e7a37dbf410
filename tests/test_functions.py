from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pregame.functions import scalar as S


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_seasons(spark):
    day = F.col("d").cast("date")
    assert one(spark, S.season_from_date(day, 8), d="2020-07-31") == 2019
    assert one(spark, S.season_from_date(day, 8), d="2020-08-01") == 2020
    assert one(spark, S.season_from_id(F.col("i"), day), i="21900001", d="2020-08-10") == 2019
    assert one(spark, S.season_from_id(F.col("i"), day), i="0029900001", d="2000-01-10") == 1999
    assert one(spark, S.season_from_id(F.col("i"), day), i="002zz00001", d="2000-01-10") is None
    assert one(spark, S.season_label(F.col("s")), s=1999) == "1999-00"
    assert one(spark, S.season_start_of_label(F.col("t")), t="2024–25") == 2024


def test_text_fields(spark):
    r = one(spark, S.result_fields(F.col("t")), t="W 31–35")
    assert (r["outcome"], r["points_for"], r["points_against"]) == ("W", 31, 35)
    assert one(spark, S.result_fields(F.col("t")), t="L 10-14")["points_against"] == 14
    s = one(spark, S.score_fields(F.col("t")), t="4–3 OT")
    assert (s["first"], s["second"], s["game_end"]) == (4, 3, "OT")
    assert one(spark, S.score_fields(F.col("t")), t="4–3")["game_end"] == "REG"
    t = one(spark, S.standing_triples(F.col("t")), t="| win_BOS = 41 | OTloss_NYR=7")
    assert [(x["field"], x["team"], x["value"]) for x in t] == [("win", "BOS", 41), ("OTloss", "NYR", 7)]
    assert one(spark, S.page_stamp(F.col("t")), t="{{x|update = complete\n}}") == "complete"
    assert one(spark, S.minutes_from_clock(F.col("t")), t="12:30") == 12.5
    assert one(spark, S.minutes_from_clock(F.col("t")), t=" ") is None
    assert one(spark, S.composite_id(F.lit(2024), F.col("w"), F.lit("A"), F.lit("B")), w="Week 3.") == "2024_Week3_A_B"


def test_names(spark):
    assert one(spark, S.fold_name(F.col("n")), n="  Nikola   JOKIĆ ") == "nikola jokic"
    assert one(spark, S.forename_first(F.col("n")), n="Porter Jr., Michael") == "Michael Porter Jr."
    assert one(spark, S.forename_first(F.col("n")), n="Nene") == "Nene"


def test_clock_times(spark):
    day = F.col("d").cast("date")
    at = one(spark, S.kickoff_utc(day, F.col("t"), F.col("z")), d="2024-07-04", t="8:20 p.m.", z="America/New_York")
    assert at == dt.datetime(2024, 7, 5, 0, 20)
    assert one(spark, S.kickoff_utc(day, F.col("t"), F.col("z")), d="2024-07-04", t="12:05 a.m.", z="UTC") == dt.datetime(2024, 7, 4, 0, 5)
    assert one(spark, S.kickoff_utc(day, F.col("t"), F.col("z")), d="2024-07-04", t="TBD", z="UTC") is None
    off = lambda d, z: one(spark, S.utc_offset_hours(day, F.col("z")), d=d, z=z)
    assert off("2024-07-04", "America/Phoenix") == off("2024-01-04", "America/Phoenix") == -7
    assert (off("2024-07-04", "America/New_York"), off("2024-01-04", "America/New_York")) == (-4, -5)


def test_normal_cdf_is_exact(spark):
    df = spark.range(-400, 401).select((F.col("id") / 50.0).alias("z"))
    for r in df.select("z", S.normal_cdf(F.col("z")).alias("p")).collect():
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-14


def test_haversine(spark):
    km = one(spark, S.haversine_km(F.lit(40.7505), F.lit(-73.9934), F.lit(34.043), F.lit(-118.2673)))
    assert 3930 < km < 3950


def test_mov_and_elo(spark):
    assert one(spark, S.mov_multiplier(F.lit(0), F.lit(0.0))) == 0
    assert abs(one(spark, S.elo_expectation(F.lit(1600.0), F.lit(1500.0))) - 1 / (1 + 10 ** -0.25)) < 1e-15


def test_blocked_json_is_tolerant(spark):
    assert one(spark, S.blocked_from_json(F.col("t")), t="{broken") == []
    assert one(spark, S.blocked_from_json(F.lit(None).cast("string"))) == []


def test_strict_mapping_raises(spark):
    from pregame.operators.projections import map_strict

    assert one(spark, map_strict(F.col("c"), {"a": 1.0}), c="a") == 1.0
    with pytest.raises(PySparkException, match="unknown category b"):
        one(spark, map_strict(F.col("c"), {"a": 1.0}), c="b")
