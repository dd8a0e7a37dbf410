"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: class k holds items of 2^(k-1)+1 .. 2^k shingles. For each class a document is seen as
windows of 2^(k+1) shingles that start every 2^k, so a passage of an item lies whole in one window and is a good part
of it: the similarity of item and window stays high however long the document is. Item and window have a one-permutation
MinHash of ``BINS`` bins each; one equal bin makes a candidate. An item with d shingles in a window has d chances.
Every candidate is verified in place: the share of the item's distinct shingles that the whole document holds.

The items are taken in blocks of bounded size, each block against all documents; texts are never shuffled.
A null, empty or wordless text or item matches nothing. An item under ``size`` words is one shingle and matches
documents of just that word sequence. Repeated rows repeat their matches; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import ROW_KEY, table, with_row_key, without_ids

BINS = 64
#: Shingles of items in one block: about 16 MB on the driver and in a task.
BLOCK_SHINGLES = 2_000_000
#: Text of one search step; it bounds a worker's arrays.
SEARCH_BYTES = 250_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _items(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(1)):
                value, doc = W.shingle_sets(s, size)
                cuts = np.searchsorted(doc, np.arange(s.n + 1))
                sets = [value[a:b].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "grams"])

    return run


def signature(value: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash: the least value of each bin (its upper bits) of each group, or ``EMPTY``."""
    out = np.full(groups * BINS, EMPTY, dtype=np.uint64)
    np.minimum.at(out, group * BINS + (value >> np.uint64(58)).astype(np.int64), value)
    return out.reshape(groups, BINS)


class Index:
    """Items of one block by size class: the values of their bins, and their whole sets."""

    def __init__(self, ids: list[int | None], grams: list[np.ndarray]) -> None:
        self.ids, self.grams = ids, [g.view(np.uint64) for g in grams]
        classes: dict[int, list[int]] = {}
        for i, g in enumerate(self.grams):
            if len(g):
                classes.setdefault(int(len(g) - 1).bit_length(), []).append(i)
        self.classes = {}
        for k, members in classes.items():
            flat = np.concatenate([self.grams[i] for i in members])
            sig = signature(flat, np.repeat(np.arange(len(members)), [len(self.grams[i]) for i in members]), len(members))
            row, _ = np.nonzero(sig != EMPTY)
            keys = sig[sig != EMPTY]
            order = np.argsort(keys, kind="stable")
            self.classes[k] = (keys[order], np.array(members)[row[order]])

    def candidates(self, value: np.ndarray, doc: np.ndarray, place: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) with an equal bin in some window; ``place`` is a shingle's place in its document."""
        found: set[tuple[int, int]] = set()
        for k, (keys, item) in self.classes.items():
            block = place >> k
            top = np.zeros(doc[-1] + 2, dtype=np.int64)
            np.maximum.at(top, doc + 1, block + 1)
            start = np.cumsum(top)
            at = start[doc] + block
            before = block > 0
            sig = signature(np.concatenate([value, value[before]]), np.concatenate([at, at[before] - 1]), int(start[-1]))
            owner = np.repeat(np.arange(len(top) - 1), top[1:])
            flat = sig.ravel()
            lo = np.searchsorted(keys, flat)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == flat)
            for h, a, b in zip((owner[hit // BINS]).tolist(), lo[hit].tolist(), np.searchsorted(keys, flat[hit], side="right").tolist(), strict=True):
                found.update((h, int(x)) for x in item[a:b])
        return found


def _search(shared, size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            ids = batch.column(0)
            for s in W.slices(batch.column(1), SEARCH_BYTES):
                value, doc = W.shingles(s, size)
                if not len(value):
                    continue
                cuts = np.searchsorted(doc, np.arange(s.n + 1))
                place = np.arange(len(value)) - cuts[doc]
                rows = []
                for d, i in sorted(index.candidates(value, doc, place)):
                    grams = index.grams[i]
                    share = float(np.isin(grams, value[cuts[d] : cuts[d + 1]]).sum()) / len(grams)
                    if share >= threshold:
                        rows.append((ids[s.first + d].as_py(), index.ids[i], len(grams), share))
                if rows:
                    a, b, c, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())],
                        names=["doc_id", "item_id", "n_shingles", "containment"],
                    )

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.75, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shingles, containment for each pair of a document and an item it contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    sets = wanted.mapInArrow(_items(size), "item_id long, grams array<long>").filter("size(grams) > 0")
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    blocks = int(-(-total // BLOCK_SHINGLES))
    schema = "doc_id long, item_id long, n_shingles long, containment double"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        mine = sets if blocks == 1 else sets.filter(F.pmod(F.xxhash64("grams"), F.lit(blocks)) == k)
        held = mine.toArrow()
        grams = [np.asarray(g.values.to_numpy(zero_copy_only=False)) for g in held.column("grams").combine_chunks()] if held.num_rows else []
        shared = spark.sparkContext.broadcast((held.column("item_id").to_pylist(), grams))
        out = out.unionByName(rows.mapInArrow(_search(shared, size, threshold), schema))
    return out


def without_leaks(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id has a hit; all columns stay."""
    return without_ids(docs, hits, id_col)


def without_leaking_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` less the rows that hold an item themselves, with null or repeated ids too."""
    keyed = with_row_key(docs)
    return without_leaks(keyed, contained_items(keyed, items, id_col=ROW_KEY), ROW_KEY).drop(ROW_KEY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
