"""Streams that come to their end, in event order, with late rows kept apart."""

from __future__ import annotations

import datetime as dt
import random
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.operators import ratings, recon
from pregame.operators.ratings import EloParams
from pregame.streaming import pipelines as P
from tests.conftest import SMALL, rows

DAY = dt.date(2020, 1, 1)


def test_last_window_comes_out_and_the_closing_row_does_not(spark, tmp_path):
    data = [(dt.datetime(2020, 1, 1, h), "a" if h % 2 else None) for h in range(20)]
    df = spark.createDataFrame(data, "ts timestamp, kind string").withColumn("violates", F.lit(True))
    df.write.parquet(str(tmp_path / "in"))
    source = P.Source(spark, str(tmp_path / "in"), df.schema, "ts")
    out = P.run_to_end([source], lambda s: P.windowed_counts(s, "ts", ["kind"], "1 day", "1 day", "1 hour"))
    assert rows(out, "kind", "rows") == [("a", 10), (None, 10)]


def test_state_provider_is_put_back(spark):
    spark.conf.set(P.PROVIDER, P.ROCKSDB.replace("RocksDB", "HDFSBacked"))
    df = spark.createDataFrame([("x", dt.date(2020, 1, 1), 1, 1, 2, 2020, 3.0, 1.0)], "league string, game_date date, game_id long, home_team int, away_team int, season int, home_pts double, away_pts double")
    P.run_in_slices([df.withColumn("ts", F.col("game_date").cast("timestamp"))], lambda s: P.live_elo(s, EloParams()), stateful=True, ts="ts").count()
    assert "HDFSBacked" in spark.conf.get(P.PROVIDER)
    spark.conf.unset(P.PROVIDER)


def games(spark, n, seed):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        home, away = rng.sample(range(6), 2)
        day = DAY + dt.timedelta(days=rng.randrange(60))
        data.append(("x" if i % 3 else "y", day, i, home, away, 2019 + day.month % 2, float(rng.randrange(5)), float(rng.randrange(5))))
    return spark.createDataFrame(data, "league string, game_date date, game_id long, home_team int, away_team int, season int, home_pts double, away_pts double").withColumn(
        "ts", F.col("game_date").cast("timestamp")
    )


def test_shuffled_arrival_gives_the_batch_ratings(spark):
    gm = games(spark, 240, 1)
    arrival = F.datediff("game_date", F.lit(DAY)) + F.pmod(F.col("game_id") * 7, F.lit(20))
    slices = [gm.filter(F.floor(arrival / 27) == k) for k in range(3)]
    live = P.run_in_slices(slices, lambda s: P.live_elo(s, EloParams(), "20 days"), stateful=True, ts="ts")
    batch = ratings.elo_replay(gm, EloParams())
    want = {r.game_id: (r.home_elo, r.away_elo) for r in batch.collect()}
    got = {r.game_id: (r.home_elo, r.away_elo) for r in live.collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_live_elo_keeps_a_chunk_of_a_day_without_reading_the_day(monkeypatch):
    """Rows of a day that come in many Arrow batches are neither read back nor written again before the day is played."""
    calls: list[tuple] = []

    class Map(dict):
        def updateValue(self, k, v):
            calls.append(("write", len(v[0]) if isinstance(v[0], list) else 0))
            self[k] = v

        def getValue(self, k):
            calls.append(("read", k))
            return self[k]

        def containsKey(self, k):
            return k in self

        def removeKey(self, k):
            del self[k]

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    handle = SimpleNamespace(getMapState=lambda *_: Map(), getValueState=lambda *_: Value(), registerTimer=lambda at: None)
    live = P.EloProcessor(EloParams())
    live.init(handle)
    days = [18262 + d for d in range(20)]
    batch = lambda b: pd.DataFrame([(DAY + dt.timedelta(days=d - days[0]), d, 100 * b + d, 2020, 1, 2, 1, 3.0, 1.0) for d in days], columns=["game_date", "day", "game_id", "season", "home_team", "away_team", "won", "home_pts", "away_pts"])
    assert not list(live.handleInputRows(("x",), (batch(b) for b in range(50)), None))
    assert sum(n for kind, n in calls if kind == "write") == 50 * 20 * 5 and len(calls) == 20
    calls.clear()
    monkeypatch.setattr(P, "ELO_BUFFER", 100)
    assert not list(live.handleInputRows(("x",), (batch(b) for b in range(50, 60)), None))
    assert len(calls) == 40 and all(kind == "write" for kind, _ in calls)
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: (days[-1] + 1) * P.DAY_MS)
    played = pd.concat(list(live.handleExpiredTimer(("x",), late, None)))
    assert len(played) == 60 * 20 and not live.open
    assert pd.concat(list(live.handleInputRows(("x",), iter([batch(70)]), None)))["late"].all()


def test_rows_behind_the_watermark_change_no_rating(spark):
    gm = games(spark, 60, 2)
    late = gm.filter("game_id % 10 = 0 AND game_date < '2020-01-20'")
    rest = gm.join(late.select("game_id"), "game_id", "left_anti").select(*gm.columns)
    live = P.run_in_slices([rest, late], lambda s: P.live_elo(s, EloParams(), "1 day"), stateful=True, ts="ts").filter("NOT late")
    want = {r.game_id: round(r.home_elo, 9) for r in ratings.elo_replay(rest, EloParams()).collect()}
    assert {r.game_id: round(r.home_elo, 9) for r in live.collect()} == want


def test_live_pairing_equals_the_batch_operator(spark):
    """Chains of leftovers, several copies a day, gaps and singles of both sides, in shuffled slices."""
    rng = random.Random(3)
    data = []
    for i in range(400):
        day = DAY + dt.timedelta(days=rng.randrange(45))
        home, away = rng.sample(range(4), 2)
        data.append(("x", home, away, i, rng.choice("AAB"), day))
    c = spark.createDataFrame(data, "league string, home_team int, away_team int, game_id long, copy string, copy_date date")
    stamped = c.withColumn("ts", F.col("copy_date").cast("timestamp"))
    arrival = F.datediff("copy_date", F.lit(DAY)) + F.pmod(F.col("game_id") * 11, F.lit(9))
    slices = [stamped.filter(F.floor(arrival / 18) == k) for k in range(3)]
    live = P.run_in_slices(slices, lambda s: P.live_pairing(s, "9 days"), stateful=True, ts="ts")
    cols = ["league", "pair", "game_id", "copy", "copy_date", "slot"]
    want = recon.pair_copies(c, ["league"])
    assert rows(live, *cols) == rows(want, *cols)
    assert want.filter("slot IS NULL").count() > 20 and want.filter("slot LIKE '%next%'").count() > 20


def test_pairing_timer_that_settles_nothing(spark):
    """The watermark is past the day of a single row, but not past the next day, on which its twin may still come."""
    data = [("x", 1, 2, 1, "A", DAY + dt.timedelta(days=10), dt.datetime(2020, 1, 11)), ("x", 3, 4, 2, "A", DAY + dt.timedelta(days=12), dt.datetime(2020, 1, 13, 12))]
    c = spark.createDataFrame(data, "league string, home_team int, away_team int, game_id long, copy string, copy_date date, ts timestamp")
    twin = spark.createDataFrame([("x", 1, 2, 3, "B", DAY + dt.timedelta(days=11), dt.datetime(2020, 1, 12, 18))], c.schema)
    live = P.run_in_slices([c, twin], lambda s: P.live_pairing(s, "1 day"), stateful=True, ts="ts")
    assert rows(live, "game_id", "slot") == [(1, "18272:next:1"), (2, None), (3, "18272:next:1")]


def test_alarms_of_a_bucket_come_at_their_time(spark):
    """Buckets hold several games: results before, after and without their fixture, repeated fixtures, a result after the alarm."""
    at = lambda d, h=0: dt.datetime(2020, 1, d, h)
    first = [(1, at(1), "fixture"), (1, at(1), "fixture"), (2, at(1), "fixture"), (2, at(1, 2), "result"), (3, at(2), "result"), (4, at(5), "fixture"), (4, at(6), "fixture"), (5, at(4), "fixture"), (9, at(4), "result")]
    second = [(3, at(9), "fixture"), (5, at(9), "result"), (6, at(9), "fixture"), (7, at(9), "fixture"), (1, at(9), "result"), (7, at(9, 1), "result")]
    slices = [spark.createDataFrame(x, "game_id long, ts timestamp, kind string") for x in (first, second)]
    out = P.run_in_slices(slices, lambda s: P.missing_result_alarm(s, 5, "1 day", buckets=2), stateful=True, ts="ts")
    ms = lambda d: ((DAY - P.EPOCH_DAY).days + d - 1) * P.DAY_MS
    assert rows(out, "game_id", "kickoff_ms") == [(1, ms(1)), (4, ms(5)), (4, ms(6)), (5, ms(4)), (6, ms(9))]


def test_alarms_call_for_state_by_the_bucket(spark):
    """More games than anybody calls for one at a time in a test."""
    day = F.timestamp_seconds(F.lit(1577836800) + F.col("id") % 40 * 86400)
    data = spark.range(60_000).select(F.col("id").alias("game_id"), day.alias("ts"), F.lit("fixture").alias("kind"))
    data = data.unionByName(data.filter("game_id % 100 <> 0").withColumn("kind", F.lit("result")))
    begun = time.monotonic()
    out = P.run_in_slices([data], lambda s: P.missing_result_alarm(s, 5, "1 hour", buckets=64), stateful=True, ts="ts")
    assert out.count() == 600 and out.filter("game_id % 100 = 0").distinct().count() == 600
    assert time.monotonic() - begun < 60


def test_late_rows_are_kept_apart_batch_by_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    for seasons in ([2001], [2004, None], [2002, 2003, 2004], [2002, 2005], [2003]):
        spark.createDataFrame([(s, i) for i, s in enumerate(seasons)], "season int, id long").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    applied, late = P.split_late(P.file_stream(spark, path, schema, files_per_batch=1))
    assert rows(late, "season", "batch") == [(2002, 2), (2002, 3), (2003, 4)]
    assert rows(applied, "batch") == [(0,), (1,), (1,), (2,), (2,), (3,)]


def test_late_split_continues_and_takes_a_batch_of_several_files(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "split")
    for seasons in ([2001], [2004, 2003, 2004], [2002, 2003, 2004, None]):
        spark.createDataFrame([(s, i) for i, s in enumerate(seasons)], "season int, id long").repartition(3).write.mode("append").parquet(path)
        applied, late = P.split_late(P.file_stream(spark, path, spark.read.parquet(path).schema), base=base)
    assert rows(late, "season", "batch") == [(2002, 2)]
    assert rows(applied, "batch") == [(0,), (1,), (1,), (1,), (2,), (2,), (2,)]


def test_corrections_are_joined_in_no_single_task(spark):
    """The corrections of an arrival are written by as many tasks as hold them."""
    from pregame.plans.stream_queries import _late_corrections

    split = []
    write = DataFrame.coalesce
    DataFrame.coalesce = lambda df, n: split.append(n) or write(df, n)
    try:
        _late_corrections(spark, SMALL)
    finally:
        DataFrame.coalesce = write
    assert not split


def test_late_drift_compares_named_keys_only(spark):
    late = spark.createDataFrame([(1, 2000, 5.0, 3), (1, 2000, 6.0, 4), (2, 2000, 9.0, 3), (7, 1999, 1.0, 3)], "id long, season int, pts double, batch long")
    served = spark.createDataFrame([(1, 2000, 5.0), (2, 2000, 9.0), (3, 2000, 4.0)], "id long, season int, pts double")
    got = P.late_drift(late, served, ["id"])
    assert rows(got, "season", "change") == [(1999, "added"), (2000, "changed")]


def test_upsert_rewrites_touched_buckets_only_and_continues(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(i, "a", 1, float(i)) for i in range(400)], "k int, s string, at int, v double").write.parquet(path)
    schema = spark.read.parquet(path).schema
    run = lambda: P.upsert_batches(P.file_stream(spark, path, schema), ["k", "s"], ["at", "v"], "at", buckets=16, base=base)
    assert run().count() == 400
    spark.createDataFrame([(7, "a", 2, -1.0), (8, "a", 0, -1.0), (None, None, 5, 9.0)], "k int, s string, at int, v double").write.mode("append").parquet(path)
    out = run()
    assert rows(out.filter("k IN (7, 8) OR k IS NULL")) == [(7, "a", 2, -1.0), (8, "a", 1, 8.0), (None, None, 5, 9.0)]
    assert out.count() == 401
    held = P._manifest(spark, base, None)
    touched = [b for b, v in held.items() if v > 0]
    assert len(held) == 16 and 1 <= len(touched) <= 3
    written = spark.read.parquet(f"{base}/v{max(held.values())}").count()
    assert written < 401 / 16 * 6
    assert run().count() == 401
