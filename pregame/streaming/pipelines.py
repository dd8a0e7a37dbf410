"""Structured Streaming forms: deduplication, live ratings and form, alarms, pairing, windows, late rows, upserts.

Sources are file streams; every query writes to a table folder with a checkpoint in the shared folder,
so a lost executor or a restart continues from the last committed batch.

A ``Source`` can be closed: a last row at ``END`` of time drives watermark and timers past every real row, so
windows, sessions and waiting rows of the last days come out too. ``with_end`` lets that row move the watermark and
keeps it from the operator. A closed source takes no more rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pregame.functions.scalar import pair_key
from pregame.operators.drift import table_diff
from pregame.operators.ratings import BASE, EloParams
from pregame.session import shared_dir

WHOLE_SLICE = 1_000_000  # files: a slice is read in one micro-batch
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name)
        .parquet(folder)
    )


#: Time of the row that closes a source.
END = dt.datetime(9000, 1, 1)


class Source:
    """A folder read as a stream, and a gate folder that gets one row at ``END`` when no more rows will come."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, ts: str, name: str = "*.parquet", files_per_batch: int = WHOLE_SLICE):
        self.spark, self.folder, self.schema, self.ts, self.name, self.files = spark, folder, schema, ts, name, files_per_batch
        self.gate = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
        spark.createDataFrame([], self._open_schema()).write.parquet(self.gate)

    def _open_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields])

    def stream(self) -> DataFrame:
        rows = file_stream(self.spark, self.folder, self.schema, self.name, self.files)
        return rows.unionByName(file_stream(self.spark, self.gate, self._open_schema(), files_per_batch=self.files))

    def close(self) -> None:
        """Only after all rows were processed: in one batch with them it would make later batches late."""
        row = [F.lit(END if f.name == self.ts else None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.gate)


def with_end(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``; the closing row moves it and goes no further. (A filter on the event time stays above the watermark.)"""
    return stream.withWatermark(ts, delay).filter(F.col(ts) < F.lit(END))


def run_to_table(stream: DataFrame, mode: str = "append", stateful: bool = False, base: str | None = None) -> DataFrame:
    """Process everything available, commit it to a table folder and read that table back.

    With the ``base`` of an earlier run the query continues from its checkpoint.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    if stateful:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").outputMode(mode).start(f"{base}/table").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema.fields])
    return spark.read.schema(schema).parquet(f"{base}/table")


def run_to_end(sources: list[Source], build: Callable[..., DataFrame], stateful: bool = False) -> DataFrame:
    """Process everything available, close the sources and let the query come to its end."""
    base = f"{shared_dir(sources[0].spark)}/stream-{uuid.uuid4().hex}"
    run_to_table(build(*[s.stream() for s in sources]), stateful=stateful, base=base)
    for s in sources:
        s.close()
    return run_to_table(build(*[s.stream() for s in sources]), stateful=stateful, base=base)


def run_in_slices(
    slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], stateful: bool = False, ts: str | None = None
) -> DataFrame:
    """Append each slice to a source folder and run the query on what is new, as a scheduled job would.

    One slice is one micro-batch; state and progress live in the checkpoint between the runs. With ``ts``
    the source is closed after the last slice.
    """
    spark = slices[0].sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = Source(spark, f"{base}/source", slices[0].schema, ts) if ts else None
    stream = source.stream if source else lambda: file_stream(spark, f"{base}/source", slices[0].schema, files_per_batch=WHOLE_SLICE)
    out = None
    for part in slices:
        part.write.mode("append").parquet(f"{base}/source")
        out = run_to_table(build(stream()), stateful=stateful, base=base)
    if source:
        source.close()
        out = run_to_table(build(stream()), stateful=stateful, base=base)
    return out


def dedupe_results(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], length: str, slide: str, delay: str) -> DataFrame:
    """Rows and violations per sliding window."""
    return (
        with_end(stream, ts, delay)
        .groupBy(F.window(ts, length, slide).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("violates").alias("violations"))
        .select(F.col("w.start").alias("window_start"), *by, "rows", "violations")
    )


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of rows at most ``gap`` apart."""
    return (
        with_end(stream, ts, delay)
        .groupBy(F.session_window(ts, gap).alias("s"), *by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "rows")
    )


def upsert_batches(stream: DataFrame, keys: list[str], fields: list[str], newest: str, buckets: int = 64, base: str | None = None) -> DataFrame:
    """Idempotent upsert: each batch rewrites the buckets that its keys fall into, and a manifest of which version each bucket has.

    The row with the greatest ``newest`` (one of ``fields``) wins, in whichever order rows arrive. Buckets and
    manifest of a version are written whole before the next reads them, and a repeated batch rewrites its own version.
    What a batch writes follows the batch, not the store. With the ``base`` of an earlier run the store is continued.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    spark.createDataFrame([], "bucket int, version long").write.mode("ignore").parquet(f"{base}/manifest/epoch=-1")
    schema = T.StructType([stream.schema[c] for c in (*keys, *fields)])
    order = [newest, *[f for f in fields if f != newest]]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        rows = batch.select(*keys, *fields)
        touched = [r.b for r in rows.select(bucket.alias("b")).distinct().collect()]  # one per bucket at most
        held = _manifest(s, base, epoch - 1)
        old = [f"{base}/v{held[b]}/b={b}" for b in touched if b in held]
        if old:
            rows = rows.unionByName(s.read.schema(schema).parquet(*old))
        best = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("r")).select(*keys, "r.*").select(*keys, *fields, bucket.alias("b"))
        best.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{base}/v{epoch}")
        state = sorted((held | dict.fromkeys(touched, epoch)).items())
        s.createDataFrame(state, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    held = _manifest(spark, base, None)
    paths = [f"{base}/v{v}/b={b}" for b, v in held.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, base: str, until: int | None) -> dict[int, int]:
    """Version of each bucket in the newest manifest, up to the epoch ``until``."""
    epochs = spark.read.schema("bucket int, version long, epoch long").parquet(f"{base}/manifest")
    epochs = epochs if until is None else epochs.filter(F.col("epoch") <= until)
    last = epochs.agg(F.max("epoch")).first()[0]
    return {r.bucket: r.version for r in epochs.filter(F.col("epoch") == last).collect()} if last is not None else {}


# ---- stateful processors ------------------------------------------------------------------------


DAY_MS = 86_400_000
EPOCH_DAY = dt.date(1970, 1, 1)


ELO_BUFFER = 500_000  # rows of six numbers


class EloProcessor(StatefulProcessor):
    """Live Elo per league in event order, whatever the order of arrival within the watermark.

    A day's games wait in state until the watermark has passed the day; an event-time timer then applies all such days in
    order. Up to ``ELO_BUFFER`` rows are gathered and written as one chunk per day, beside the chunks the day has, so a row is
    written once and read once. Memory holds that buffer, one rating per team and the games of one day. A game of a day that
    was applied already is emitted with ``late`` set; its league is recomputed in batch.
    """

    def __init__(self, params: EloParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "team int", "rating double, season int")
        self.open = handle.getMapState("open", "day int, chunk bigint", "games array<bigint>")  # id, season, home, away, sign of the margin, ...
        self.chunks = handle.getValueState("chunks", "n bigint")
        self.newest = handle.getValueState("newest", "day int")
        self.due = handle.getValueState("due", "at bigint")

    def _wait(self, day: int) -> None:
        """A timer at the end of ``day``, unless an earlier one is set."""
        at = (day + 1) * DAY_MS
        if not self.due.exists() or at < self.due.get()[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        held: list[np.ndarray] = []
        for pdf in rows:
            games = pdf[["day", "game_id", "season", "home_team", "away_team", "won"]].astype("int64").to_numpy()
            late = games[:, 0] <= newest if newest is not None else np.zeros(len(games), dtype=bool)
            if late.any():
                n = int(late.sum())
                yield pd.DataFrame({"league": [key[0]] * n, "game_id": games[late, 1], "home_elo": [None] * n, "away_elo": [None] * n, "late": [True] * n}).astype(
                    {"home_elo": "float64", "away_elo": "float64"}
                )
            held.append(games[~late])
            if sum(map(len, held)) >= ELO_BUFFER:
                self._keep(np.concatenate(held))
                held = []
        if held:
            self._keep(np.concatenate(held))

    def _keep(self, games: np.ndarray) -> None:
        """One new chunk for each day of the games."""
        if not len(games):
            return
        games = games[np.argsort(games[:, 0], kind="stable")]
        days, starts = np.unique(games[:, 0], return_index=True)
        chunk = self.chunks.get()[0] if self.chunks.exists() else 0
        for day, mine in zip(days.tolist(), np.split(games[:, 1:], starts[1:]), strict=True):
            self.open.updateValue((day, chunk), (mine.ravel().tolist(),))
        self.chunks.update((chunk + 1,))
        self._wait(int(days[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        chunks: dict[int, list[int]] = {}
        for day, chunk in sorted(tuple(k) for k in self.open.keys()):
            chunks.setdefault(day, []).append(chunk)
        self.due.clear()
        local: dict[int, tuple[float, int]] = {}
        out: list[tuple] = []
        for day in [d for d in chunks if d < passed]:
            self._play(key[0], [x for c in chunks[day] for x in self.open.getValue((day, c))[0]], local, out)
            for c in chunks[day]:
                self.open.removeKey((day, c))
            self.newest.update((day,))
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        for team, rating in local.items():
            self.ratings.updateValue((team,), rating)
        if later := [d for d in chunks if d >= passed]:
            self._wait(later[0])
        if out:
            yield self._frame(out)

    def _enter(self, team: int, season: int, local: dict) -> float:
        """Rating a team takes into a game; stored state is read once per team and flush."""
        if team not in local:
            local[team] = self.ratings.getValue((team,)) if self.ratings.containsKey((team,)) else (BASE, season)
        rating, last = local[team]
        return rating if last == season else BASE + self.params.keep * (rating - BASE)

    def _play(self, league: str, flat: list[int], local: dict, out: list[tuple]) -> None:
        for game, season, home, away, won in sorted(zip(*[iter(flat)] * 5, strict=True)):
            h, a = self._enter(home, season, local), self._enter(away, season, local)
            out.append((league, game, h, a, False))
            expected = 1.0 / (1.0 + 10.0 ** (-(h + self.params.home - a) / 400.0))
            change = self.params.k * ((won + 1) / 2 - expected)
            local[home], local[away] = (h + change, season), (a - change, season)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["league", "game_id", "home_elo", "away_elo", "late"])

    def close(self) -> None:
        pass


def live_elo(stream: DataFrame, params: EloParams, delay: str = "1 day") -> DataFrame:
    """Live ratings; ``ts`` is the day of the game as a time stamp. Parameters that need more than the two teams' own state are refused."""
    if params.mov or params.newcomer_offset or params.boundary != "team":
        raise ValueError("the live rating knows K, home edge and the teams' own carry-over only; replay such a league in batch")
    won = F.when(F.col("home_pts") > F.col("away_pts"), 1).when(F.col("home_pts") < F.col("away_pts"), -1).otherwise(0).alias("won")
    games = with_end(stream, "ts", delay).select("ts", "league", F.unix_date("game_date").alias("day"), "game_id", "season", "home_team", "away_team", won)
    return games.groupBy("league").transformWithStateInPandas(
        statefulProcessor=EloProcessor(params),
        outputStructType="league string, game_id bigint, home_elo double, away_elo double, late boolean",
        outputMode="append",
        timeMode="EventTime",
    )


class PairingProcessor(StatefulProcessor):
    """Copies A and B of a pair of teams, each row used once, at most a day apart; the rest single.

    Rows wait until the watermark has passed their day. Days are then settled in order: what the day before left over
    meets the first rows of the other copy, the rest of the day pairs among itself, and what remains waits one day.
    State holds the rows of open days only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "day int, copy string, game_id bigint")
        self.left = handle.getListState("left", "day int, copy string, game_id bigint")
        self.due = handle.getValueState("due", "at bigint")

    def _wait(self, day: int) -> None:
        at = (day + 1) * DAY_MS
        if not self.due.exists() or at < self.due.get()[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [((r.copy_date - EPOCH_DAY).days, r.copy, int(r.game_id)) for pdf in rows for r in pdf.itertuples(index=False)]
        if fresh:
            self.rows.appendList(fresh)
            self._wait(min(day for day, _, _ in fresh))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = sorted((d, c, g) for d, c, g in self.rows.get())
        left = [tuple(x) for x in self.left.get()]
        out: list[tuple] = []
        by_day: dict[int, dict[str, list[int]]] = {}
        for d, c, g in held:
            if d < passed:
                by_day.setdefault(d, {"A": [], "B": []})[c].append(g)
        for d, mine in by_day.items():
            if left and left[0][0] < d - 1:
                out += [(g, c, day, None) for day, c, g in left]
                left = []
            if left:
                other = mine["B" if left[0][1] == "A" else "A"]
                n = min(len(left), len(other))
                for k in range(n):
                    slot = f"{d - 1}:next:{k + 1}"
                    out += [(left[k][2], left[k][1], d - 1, slot), (other[k], "B" if left[k][1] == "A" else "A", d, slot)]
                out += [(g, c, day, None) for day, c, g in left[n:]]
                del other[:n]
            n = min(len(mine["A"]), len(mine["B"]))
            out += [(mine[c][k], c, d, f"{d}:same:{k + 1}") for k in range(n) for c in "AB"]
            left = [(d, c, g) for c in "AB" for g in mine[c][n:]]
        if left and left[0][0] + 1 < passed:
            out += [(g, c, day, None) for day, c, g in left]
            left = []
        waiting = [x for x in held if x[0] >= passed]
        self.rows.put(waiting) if waiting else self.rows.clear()
        self.left.put(left) if left else self.left.clear()
        self.due.clear()
        open_days = [d for d, _, _ in waiting[:1]] + [d + 1 for d, _, _ in left[:1]]
        if open_days:
            self._wait(min(open_days))
        if not out:  # a frame without rows has no dates to tell its types by
            return
        yield pd.DataFrame(
            {
                "league": [key[0]] * len(out), "pair": [key[1]] * len(out), "game_id": pd.Series([x[0] for x in out], dtype="int64"), "copy": [x[1] for x in out],
                "copy_date": [EPOCH_DAY + dt.timedelta(days=x[2]) for x in out], "slot": [x[3] for x in out],
            }
        )

    def close(self) -> None:
        pass


def live_pairing(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows with the slot they share with their twin, null for singles, as ``recon.pair_copies`` gives them; ``ts`` is the day as a time stamp."""
    return (
        with_end(stream, "ts", delay).withColumn("pair", pair_key(F.col("home_team"), F.col("away_team"))).groupBy("league", "pair")
        .transformWithStateInPandas(
            statefulProcessor=PairingProcessor(),
            outputStructType="league string, pair string, game_id bigint, copy string, copy_date date, slot string",
            outputMode="append",
            timeMode="EventTime",
        )
    )


class FormProcessor(StatefulProcessor):
    """Mean of the last ``w`` values per key, the current row excluded. State: at most ``w`` values and the newest row.

    A row dated before the newest applied one is emitted with ``late`` set and no form, and leaves the state alone; its
    key is recomputed in batch.
    """

    def __init__(self, w: int):
        self.w = w

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "pts double")
        self.newest = handle.getValueState("newest", "day date, game_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["game_date", "game_id"])
        recent = [v[0] for v in self.recent.get()] if self.recent.exists() else []
        newest = self.newest.get() if self.newest.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            at = (r.game_date, int(r.game_id))
            if newest is not None and at <= (newest[0], int(newest[1])):
                out.append((key[0], int(key[1]), int(r.game_id), None, True))
                continue
            newest = at
            form = sum(recent) / self.w if len(recent) == self.w else None
            out.append((key[0], int(key[1]), int(r.game_id), form, False))
            recent = [*recent, float(r.pts)][-self.w :]
        self.recent.put([(v,) for v in recent])
        if newest is not None:
            self.newest.update(newest)
        yield pd.DataFrame(out, columns=["league", "team", "game_id", "form", "late"])

    def close(self) -> None:
        pass


def live_form(stream: DataFrame, w: int) -> DataFrame:
    return stream.groupBy("league", "team").transformWithStateInPandas(
        statefulProcessor=FormProcessor(w),
        outputStructType="league string, team int, game_id bigint, form double, late boolean",
        outputMode="append",
        timeMode="None",
    )


class MissingResultProcessor(StatefulProcessor):
    """A fixture falls due some hours after its kick-off; a result of its game cancels it; what falls due is reported.

    A group is a bucket of games, so a batch calls for state once a bucket and not once a game. State of a bucket: games
    that have a result, and open fixtures with their time. One timer stands at the earliest of these.
    """

    def __init__(self, hours: int):
        self.wait_ms = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "games array<bigint>")
        self.open = handle.getValueState("open", "games array<bigint>, ends array<bigint>")
        self.due = handle.getValueState("due", "at bigint")

    def _open(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.open.get() if self.open.exists() else ([], [])
        return np.array(held[0], dtype="int64"), np.array(held[1], dtype="int64")

    def _keep(self, games: np.ndarray, ends: np.ndarray) -> None:
        """The open fixtures, one per game and time, and a timer at the earliest unless one stands before it."""
        if not len(games):
            self.open.clear()
            return
        once = np.unique(np.stack([ends, games], axis=1), axis=0)
        self.open.update((once[:, 1].tolist(), once[:, 0].tolist()))
        first = int(once[0, 0])
        if not self.due.exists() or first < self.due.get()[0]:
            self.handle.registerTimer(first)
            self.due.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = np.concatenate([pdf[["game_id", "ms", "is_result"]].to_numpy("int64") for pdf in rows])
        is_result = fresh[:, 2] == 1
        done = np.array(self.done.get()[0] if self.done.exists() else [], dtype="int64")
        if is_result.any():
            done = np.union1d(done, fresh[is_result, 0])
            self.done.update((done.tolist(),))
        games, ends = self._open()
        games, ends = np.concatenate([games, fresh[~is_result, 0]]), np.concatenate([ends, fresh[~is_result, 1] + self.wait_ms])
        waiting = ~np.isin(games, done)
        self._keep(games[waiting], ends[waiting])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        games, ends = self._open()
        due = (ends < timerValues.getCurrentWatermarkInMs()) | (ends <= expiredTimerInfo.getExpiryTimeInMs())
        self.due.clear()
        self._keep(games[~due], ends[~due])
        if not due.any():
            return iter([])
        found = pd.Series(games[due], dtype="Int64")
        return iter([pd.DataFrame({"game_id": found.mask(pd.Series([bool(key[1])] * len(found))), "kickoff_ms": ends[due] - self.wait_ms})])

    def close(self) -> None:
        pass


def missing_result_alarm(stream: DataFrame, hours: int, delay: str, buckets: int = 1024) -> DataFrame:
    """stream: game_id, ts (kick-off, or arrival of the result), kind fixture/result. A batch reads the buckets its games fall into."""
    game = F.col("game_id")
    return (
        with_end(stream, "ts", delay)
        .select(
            "ts",
            F.pmod(F.xxhash64(game), F.lit(buckets)).cast("int").alias("bucket"),
            game.isNull().alias("unnamed"),
            F.coalesce(game, F.lit(0)).cast("long").alias("game_id"),
            F.unix_millis("ts").alias("ms"),
            F.coalesce(F.col("kind") == "result", F.lit(False)).cast("int").alias("is_result"),
        )
        .groupBy("bucket", "unnamed")
        .transformWithStateInPandas(
            statefulProcessor=MissingResultProcessor(hours),
            outputStructType="game_id bigint, kickoff_ms bigint",
            outputMode="append",
            timeMode="EventTime",
        )
    )


# ---- late rows ----------------------------------------------------------------------------------


def split_late(stream: DataFrame, season: str = "season", open_seasons: int = 2, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Applied rows and late rows, each with the batch that brought it.

    The newest season of the batches before sets the bound: rows of the ``open_seasons`` newest seasons are applied, older
    ones are kept apart for the drift report and never applied. Each batch writes its own folder of both tables and of the
    bounds, and reads the bounds of earlier batches only, so a repeated batch writes the same again. With the ``base`` of an
    earlier run the tables are continued.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    fields = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in stream.schema.fields], T.StructField("batch", T.LongType(), True)])
    bounds = T.StructType([T.StructField("newest", T.IntegerType(), True), T.StructField("batch", T.LongType(), True)])

    def split(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        seen = s.read.schema(bounds).parquet(f"{base}/bounds").filter(F.col("batch") < epoch).agg(F.max("newest")).first()[0] if epoch else None
        late = F.lit(False) if seen is None else F.coalesce(F.col(season) <= F.lit(seen - open_seasons), F.lit(False))
        rows = batch.withColumn("is_late", late)
        rows.filter("NOT is_late").drop("is_late").write.mode("overwrite").parquet(f"{base}/applied/batch={epoch}")
        rows.filter("is_late").drop("is_late").write.mode("overwrite").parquet(f"{base}/late/batch={epoch}")
        newest = batch.agg(F.max(season).cast("int").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{base}/bounds/batch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(split).start().awaitTermination()
    return tuple(spark.read.schema(fields).parquet(f"{base}/{name}") for name in ("applied", "late"))


def late_drift(late: DataFrame, served: DataFrame, keys: list[str], order: str = "batch") -> DataFrame:
    """Differences between the newest late version of each key and the served table, as ``table_diff`` gives them.

    Only keys that late rows name are compared; nothing is applied.
    """
    fields = [c for c in served.columns if c not in keys]
    newest = late.groupBy(*keys).agg(F.max(F.struct(order, *fields)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in fields])
    return table_diff(newest, served.join(newest.select(*keys), keys, "left_semi"), keys, carry=["season"])
