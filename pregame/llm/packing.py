"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are numbered within their length (in salted
blocks, so that a common length is no single task). The sweeps run on classes: pieces of one length, and runs of
sequences with one gap. A class table has at most one row per possible length, whatever the number of documents, so
all rounds take one small task; the numbering before and the placing after are spread over the cluster.

A round takes one length, larger ones first:
1. its pieces go to their successor, the smallest gap that holds them; gaps are sorted, runs of equal gaps are one row;
2. where pieces meet at a run they are placed by rank, as many behind each other in a sequence as it still holds;
3. gaps shrink, runs split or join the run they continue, and what is left of the length goes to the next successor. When no
   gap is left, as many new sequences are opened as the rest of the length fills.
Every piece thus goes where best fit would put it one by one, in as many rounds as there are lengths.

A null or empty text is its end token alone. Rows with a repeated or null id are packed like any other row.
An empty table gives no rows. Every piece appears once; offsets in a sequence are gapless from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.llm import tokens as T
from pregame.llm.common import TEXT_ROWS, materialise, table

GROUP_CHARS = 2_000_000
BLOCK = 20_000


def _pieces(path: str, capacity: int, end_id: int, kept: int = T.KEPT, group: int = GROUP_CHARS):
    end = np.uint32(end_id).astype("<u4").tobytes()
    step = 4 * capacity

    def cut(ids: bytes):
        for k, at in enumerate(range(0, len(ids), step)):
            part = ids[at : at + step]
            yield k, at // 4, len(part) // 4, zlib.crc32(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = T.word_parts(path, kept)
        for batch in batches:
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            owner: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            held: list[tuple[int, list[str]]] = []
            chars = 0

            def close(i: int, ids: bytes) -> None:
                own = list(cut(ids + end))
                owner.extend([i] * len(own))  # noqa: B023
                rows.extend(own)  # noqa: B023

            def flush() -> None:
                known = parts.learn(set(chain.from_iterable(h for _, h in held)))  # noqa: B023
                for i, found in held:  # noqa: B023
                    close(i, b"".join(map(known.__getitem__, found)))

            for i in range(len(text)):
                t = text[i].as_py()
                if not T.plain(t):
                    close(i, np.array(parts.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
                    continue
                held.append((i, T.words(t)))
                chars += len(t)
                if chars > group:
                    flush()
                    held, chars = [], 0
            flush()
            if rows:
                piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _ranked(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``rank``, the number of a piece among those of its length, counted in blocks.

    ``lengths`` has at most one row per length up to the capacity, so it is broadcast.
    """
    blocks = F.greatest(F.lit(1), F.floor(F.col("n") / BLOCK))
    cut = pieces.join(F.broadcast(lengths.select(F.col("size").alias("length"), "n")), "length").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), blocks)
    ).drop("n")
    sizes = cut.groupBy("length", "block").count()
    before = sizes.select(
        "length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before")
    )
    number = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    return cut.withColumn("number", number).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("number") - 1).drop("block", "number", "before")


class Gaps:
    """Open sequences as runs of one gap each: consecutive numbers, smallest gap that holds a size found by the lowest set bit."""

    def __init__(self, capacity: int) -> None:
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def successor(self, size: int) -> int:
        """Smallest gap of at least ``size``, 0 if there is none."""
        above = self.open >> size
        return size + (above & -above).bit_length() - 1 if above else 0

    def take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            self.open &= ~(1 << gap)
        return run

    def put(self, gap: int, first: int, n: int) -> None:
        """A run that goes on where the last one of its gap ends joins it."""
        if not gap or not n:
            return
        held = self.runs[gap]
        if held and sum(held[-1]) == first:
            first, n = held[-1][0], held[-1][1] + n
            held.pop()
        held.append((first, n))
        self.open |= 1 << gap


def _sweep(gaps: Gaps, size: int, n: int, capacity: int, sequences: int) -> tuple[list[tuple[int, ...]], int]:
    """One round: the ``n`` pieces of one size go to successor after successor, as many to a sequence as it holds, by rank.

    Returns the placements (length, run, at, times, sequence, first) and the number of sequences.
    """
    put, at = [], 0
    while at < n:
        gap = gaps.successor(size)
        if gap:
            first, run = gaps.take(gap)
        else:
            gap, first, run = capacity, sequences, -(-(n - at) // (capacity // size))
            sequences += run
        times = min(gap // size, n - at)
        used = min(run, (n - at) // times)
        put.append((size, used, at, times, first, capacity - gap))
        at += used * times
        gaps.put(gap, first + used, run - used)
        gaps.put(gap - times * size, first, used)
    return put, sequences


def _fit(capacity: int):
    """Rounds over the class table, larger sizes first: at most ``capacity`` rows come in, however many pieces they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sorted(((size, n) for b in batches for size, n in zip(*(c.to_pylist() for c in b.columns), strict=True)), reverse=True)
        gaps, sequences = Gaps(capacity), 0
        for size, n in classes:
            put, sequences = _sweep(gaps, size, n, capacity, sequences)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*put, strict=True)], names=_LEDGER)

    return run


_LEDGER = ["length", "run", "at", "times", "sequence", "first"]


def _place(ledger: pa.Table):
    """Sequence and offset of each ranked piece, from the ledger row its length and rank fall into."""
    held = ledger.sort_by([("length", "ascending"), ("at", "ascending")])
    length, run_, at, times, sequence, first = (held.column(c).to_numpy() for c in _LEDGER)
    starts = np.searchsorted(length, length)
    ends = np.searchsorted(length, length, side="right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {int(length[a]): (int(a), int(b)) for a, b in zip(starts, ends, strict=True)}
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(size), dtype=np.int64)
            for x in np.unique(size):
                a, b = bounds[int(x)]
                mine = np.flatnonzero(size == x)
                row[mine] = a + np.searchsorted(at[a:b], rank[mine], side="right") - 1
            past = rank - at[row]
            out = [sequence[row] + past % run_[row], first[row] + past // run_[row] * size]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, out)], names=[*kept, "sequence_id", "offset"])

    return run


def best_fit(lengths: DataFrame, capacity: int) -> DataFrame:
    """Ledger of placements for ``lengths`` (size, n): pieces ``at .. at + run * times`` of a length go to
    ``sequence .. sequence + run``, ``times`` each, from offset ``first`` on."""
    return lengths.select("size", "n").coalesce(1).mapInArrow(
        _fit(capacity), "length long, run long, at long, times long, sequence long, first long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", kept: int = T.KEPT,
    group: int = GROUP_CHARS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece. ``kept``, ``group``: words a worker remembers and characters it takes at once,
    memory against time."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(
        rows.mapInArrow(_pieces(tokenizer, capacity, end_id, kept, group), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces", TEXT_ROWS
    )
    lengths = materialise(pieces.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("n")).coalesce(1), "lengths")
    ledger = materialise(best_fit(lengths, capacity), "ledger")
    # a row per length and run of sequences it meets: some ten thousand for any number of documents, capacity squared / 2 at worst
    return _ranked(pieces, lengths).mapInArrow(
        _place(ledger.toArrow()), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
