"""The block-wise path for hot keys gives what the plain window gives, and nothing is dropped."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pregame.operators import skew
from pregame.plans.catalog import load

WINDOWED = [
    "trailing_mean", "rolling_career", "rolling_all_competitions", "player_trailing_minutes", "gap_reach", "team_window", "prior_counts",
    "rest_days", "season_rest", "weekly_rest", "dense_rest", "games_last_7", "travel", "road_trip", "on_off", "absence_weights",
    "running_record", "running_record_reanchored", "full_window_dates", "fixture_form", "trailing_minutes_as_of", "truncation_test",
]


@pytest.mark.parametrize("name", WINDOWED)
def test_blocks_equal_plain(spark, name):
    build = load()[name].build
    plain = sorted(map(repr, build(spark, SMALL).collect()))
    spark.conf.set("pregame.maxGroupRows", "7")
    try:
        split = build(spark, SMALL)
        got = sorted(map(repr, split.collect()))
    finally:
        spark.conf.unset("pregame.maxGroupRows")
    assert got == plain


def test_hot_key_is_really_cut(spark, tiny_blocks):
    df = spark.range(100).select(F.lit(1).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("game_date"), F.col("id").alias("game_id"))
    scope = skew.row_scope(df, ["k"], "game_date", ["game_id"], 3)
    assert scope.halo
    sizes = [r["n"] for r in scope.df.groupBy(*scope.keys).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 7 + 3
    assert scope.finish(scope.df).count() == 100


def test_positions_are_consecutive(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("d"), F.col("id").alias("i"))
    got = skew.number_rows(df, ["k"], "d", ["i"])
    for k in (0, 1):
        part = [r for r in got.filter(F.col("k") == k).orderBy("d", "i").collect()]
        assert [r["_pos"] for r in part] == list(range(25))


def test_null_keys_survive_the_block_path(spark, tiny_blocks):
    df = spark.sql("SELECT CAST(NULL AS INT) AS k, DATE '2020-01-01' AS game_date, id AS game_id FROM range(20)")
    out = skew.running_sums(df, ["k"], "game_date", ["game_id"], {"n": F.lit(1)}, inclusive=True)
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 21))


def test_shuffles_start_from_partitions_by_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    """A task's rows do not grow with the input while the session's own number of partitions stays."""
    from pregame import session

    monkeypatch.setattr(session, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(session, "_table_bytes", {})
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(50_000).select(F.rand(1).alias("x")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(50_000).select(F.rand(2).alias("x")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    session.spread(spark, str(tmp_path))
    begun = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    assert 400_000 / 20_000 <= begun < 600_000 / 20_000
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
    load()["key_coverage"].build(spark, SMALL)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) < begun
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(session.ADVISORY_BYTES)


def test_windows_of_a_player_share_one_count_and_one_shuffle(spark):
    from pregame.plans.feature_queries import weighted_players

    known = len(skew._seen)
    plan = weighted_players(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_player = {line.strip(" :+-*") for line in plan.splitlines() if "Exchange hashpartitioning(player_id" in line}
    assert len(by_player) == 1
    assert len(skew._seen) <= known + 1
