"""Set-similarity join on word shingles by vertical partitioning.

1. Every text becomes its set of distinct five-word shingles. Copies (same word sequence) share one class.
2. The shingle space is cut into fragments. One shuffle brings each fragment's segments of all classes together;
   there a shingle's document frequency is counted and shingles of a single class are dropped: they overlap
   with nothing. What returns per class is its shared shingles with their frequencies.
3. Two sets link at ``intersection >= 3/7 * (size a + size b)`` (Jaccard 0.75), so a class with less than
   0.75 of its set shared links with nothing and leaves.
4. The global order is frequency, then value. Under it linked sets share a shingle of their prefixes. Each prefix
   shingle proposes the class with most of its set behind it as partner of the others: a star, not all pairs.
5. The order is cut into frequency octaves. A pair's partial overlaps are counted per octave and summed. Verified links give components.
6. Pairs of *different* components that still share a prefix shingle and pass the bound at it (what follows it on either
   side must be enough for a link) are counted the same way. Pairs inside a component are not needed: they change no component. So no link is lost, and
   groups of copies are never expanded into pairs.

Nulls, empty texts and texts without words have set size 0, link with nothing and are their own component.
A row with a null id keeps its set size and takes part; components are named by the smallest non-null id.
Rows repeating an id are rows of that id; rows of an id with different texts are not linked by the id.
Shingles and classes are identified by 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import ROW_KEY, components, materialise, partitions, spread_join, with_row_key, without_ids

FRAGMENT_BYTES = 16_000_000
#: Bytes of text whose segments are emitted together, and those whose shingles are worked out at once; shingles that are sorted or sent at once;
#: rows of a worker's batch. They bound a worker's memory, whatever the texts.
GROUP_BYTES, PART_BYTES, SORTED_VALUES, BATCH_ROWS = 1_000_000, 250_000, 250_000, 250
_EMIT = "frag int, doc_id long, n long, key long, keys binary, counts binary, values binary"
_SHARED = "doc_id long, n long, key long, shared long, values binary, freqs binary"


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Ids, keys, set sizes, shingles and their texts of some ``GROUP_BYTES`` of consecutive texts, worked out ``PART_BYTES`` at a time."""
    held: list[tuple] = []
    texts = taken = 0
    for batch in batches:
        for s in W.slices(batch.column(1), PART_BYTES):
            value, doc = W.shingle_sets(s, size)
            held.append((batch.column(0).slice(s.first, s.n), W.sequence_hash(s).view(np.int64), np.bincount(doc, minlength=s.n), value, doc + texts))
            texts, taken = texts + s.n, taken + len(s.data)
            if taken >= GROUP_BYTES:
                ids, *rest = zip(*held, strict=True)
                yield pa.concat_arrays(ids), *map(np.concatenate, rest)
                held, texts, taken = [], 0, 0
    if held:
        ids, *rest = zip(*held, strict=True)
        yield pa.concat_arrays(ids), *map(np.concatenate, rest)


def _emit(fragments: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("frag", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("keys", pa.binary()),
             ("counts", pa.binary()), ("values", pa.binary())]
        )
        for ids, keys, sizes, value, doc in _grouped(batches, size):
            none = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(keys)) % fragments, pa.int32()), ids, pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.int64(), mask=sizes == 0), none, none, none],
                schema=schema,
            )
            if not len(value):
                continue
            frag = ((value >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            value, frag, doc = value[order], frag[order], doc[order]
            edges = np.searchsorted(frag, np.arange(fragments + 1))
            full = np.flatnonzero(np.diff(edges))
            segs = []
            for f in full:
                own, count = np.unique(doc[edges[f] : edges[f + 1]], return_counts=True)
                segs.append((keys[own].tobytes(), count.astype(np.uint32).tobytes(), value[edges[f] : edges[f + 1]].tobytes()))
            nulls = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), nulls, nulls, nulls, *(pa.array(x, pa.binary()) for x in zip(*segs, strict=True))],
                schema=schema,
            )

    return run


def _packed(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(data)
    at = (edges * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One fragment after the other: drops what a single class holds, returns shared shingles per class."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("shared", pa.int64()), ("values", pa.binary()), ("freqs", pa.binary())]
    )
    held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        doc_rows = batch.filter(batch.column("keys").is_null())
        if doc_rows.num_rows:
            none = pa.nulls(doc_rows.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [doc_rows.column("doc_id"), doc_rows.column("n"), doc_rows.column("key"), pa.nulls(doc_rows.num_rows, pa.int64()), none, none], schema=schema
            )
        rows = batch.filter(batch.column("keys").is_valid())
        for frag, *seg in zip(*(rows.column(c).to_pylist() for c in ("frag", "keys", "counts", "values")), strict=True):
            held.setdefault(frag, []).append(tuple(seg))
        del batch, doc_rows, rows
    for frag in list(held):
        key, value, owner = _one_per_class(held.pop(frag))
        value, freq, owner = _shared(value, owner)
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        for i in range(0, len(edges), 20_000):
            j = min(i + 20_000, len(edges))
            lo, hi = edges[i], edges[j] if j < len(edges) else len(owner)
            at = np.append(edges[i:j], hi) - lo
            none = pa.nulls(j - i, pa.int64())
            mine = order[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array(key[owner[edges[i:j]]], pa.int64()), pa.array(np.diff(at), pa.int64()), _packed(value[mine], at), _packed(freq[mine], at)],
                schema=schema,
            )


def _one_per_class(segs: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, shingles and the place of their class among the keys, each class once. Empties ``segs``, so that nothing is held twice."""
    key = np.concatenate([np.frombuffer(s[0], np.int64) for s in segs])
    count = np.concatenate([np.frombuffer(s[1], np.uint32) for s in segs]).astype(np.int64)
    first = np.zeros(len(key), dtype=bool)
    first[np.unique(key, return_index=True)[1]] = True
    value = np.empty(count[first].sum(), np.uint64)
    filled, at = len(value), len(key)
    while segs:
        own, _, raw = segs.pop()
        at -= len(own) // 8
        here = slice(at, at + len(own) // 8)
        kept = np.frombuffer(raw, np.uint64)[np.repeat(first[here], count[here])]
        value[filled - len(kept) : filled] = kept
        filled -= len(kept)
    return key[first], value, np.repeat(np.arange(first.sum(), dtype=np.int32), count[first])


def _shared(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that more than one class holds, their frequencies and owners. Every shingle falls into one of several shares by its
    low bits; these are sorted one after the other, so that the arrays of a sort are small."""
    shares = 1 << max(0, (len(value) - 1) // SORTED_VALUES).bit_length()
    found = []
    for k in range(shares):
        own = np.flatnonzero((value & np.uint64(shares - 1)) == np.uint64(k))
        own = own[np.argsort(value[own], kind="stable")]
        sorted_ = value[own]
        new = np.ones(len(sorted_), dtype=bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        freq = np.diff(np.append(np.flatnonzero(new), len(sorted_)))
        freq = np.repeat(freq, freq)
        many = freq > 1
        found.append((sorted_[many], freq[many].astype(np.uint32), owner[own[many]]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class, its size first and then its segments: one row for each class that shares enough of its
    set to link, with its shared shingles in the global order, cut into pieces."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("pieces", pa.list_(pa.list_(pa.int64())))])

    def close(key: int, n: int, segs: list[tuple[bytes, bytes]]) -> tuple:
        value = np.concatenate([np.frombuffer(s[0], np.uint64) for s in segs])
        freq = np.concatenate([np.frombuffer(s[1], np.uint32) for s in segs])
        order = np.lexsort((value, freq))
        value, freq = value[order], freq[order]
        prefix = max(0, n - (3 * n + 3) // 4 + 1 - (n - len(value)))
        octave = np.frexp(freq.astype(np.float64))[1].astype(np.int64)
        edges = np.flatnonzero(np.append(True, octave[1:] != octave[:-1]))
        signed = value.view(np.int64)
        return key, n, len(value), signed[:prefix], octave[edges], np.split(signed, edges[1:])

    done: list[tuple] = []
    now, size, segs, waiting = None, 0, [], 0

    def end() -> int:
        if segs and 4 * sum(len(s[0]) for s in segs) >= 3 * 8 * size:
            done.append(close(now, size, segs))
            return done[-1][2]
        return 0

    def closed() -> pa.RecordBatch:
        key, n, shared, prefix, parts, pieces = zip(*done, strict=True)
        ends = np.cumsum([0, *map(len, pieces)])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists([x for p in pieces for x in p]))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, n, shared)), _lists(prefix), _lists(parts), listed], schema=schema)

    for batch in batches:
        for key, n, value, freq in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "values", "freqs")), strict=True):
            if n is not None:
                waiting += end()
                now, size, segs = key, n, []
            else:
                segs.append((value, freq))
            if len(done) >= 500 or waiting >= SORTED_VALUES:
                yield closed()
                done, waiting = [], 0
    end()
    if done:
        yield closed()


def _possible(n_a, rest_a, n_b, rest_b):
    """Whether two classes that meet at a shingle can link: the overlap is at most what follows it on either side.

    Holds at the first shingle two linked classes share in the global order, so no link is lost by asking it everywhere.
    """
    return F.least(rest_a, rest_b) * 7 >= (n_a + n_b) * 3


def _verified(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Links among ``pairs`` (a, b, n_a, n_b): partial overlaps per fragment, summed per pair."""
    a = pieces.select(F.col("key").alias("a"), "part", F.col("grams").alias("grams_a"))
    b = pieces.select(F.col("key").alias("b"), "part", F.col("grams").alias("grams_b"))
    partial = pairs.join(a, "a").join(b, ["b", "part"])
    return (
        partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum("common").alias("common"))
        .filter("100 * common >= 75 * (n_a + n_b - common)")
        .select("a", "b", "common")
    )


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (rows, links, classes).

    ``rows``: doc_id, n_shingles, component_id per input row. ``links``: the counted links between classes
    (a, b, common). ``classes``: doc_id, class per row with words. See the module's text for odd rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = int(max(partitions(spark), -(-total // FRAGMENT_BYTES)))
    found = materialise(
        base.mapInArrow(_emit(fragments, size), _EMIT).repartition(fragments, "frag").mapInArrow(_count, _SHARED), "shingles", BATCH_ROWS
    )
    rows = found.filter("shared IS NULL").select("doc_id", "n", "key")
    segments = found.filter("shared IS NOT NULL").select("key", "values", "freqs")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"))
    joined = classes.select("key", "n", F.lit(None).cast("binary").alias("values"), F.lit(None).cast("binary").alias("freqs")).unionByName(
        segments.select("key", F.lit(None).cast("long").alias("n"), "values", "freqs")
    )
    sets = materialise(
        joined.repartition("key").sortWithinPartitions("key", F.col("n").desc_nulls_last())
        .mapInArrow(_ordered, "key long, n long, shared long, prefix array<long>, parts array<long>, pieces array<array<long>>"),
        "sets",
    )
    pieces = sets.select("key", F.explode(F.arrays_zip("parts", "pieces")).alias("x")).select("key", F.col("x.parts").alias("part"), F.col("x.pieces").alias("grams"))
    prefix = sets.select("key", "n", "shared", F.posexplode("prefix").alias("place", "gram")).select(
        "key", "n", "gram", (F.col("shared") - F.col("place")).alias("rest")
    )

    purest = F.max(F.struct((F.col("rest") / F.col("n")).alias("share"), F.col("n").alias("size"), "key", "n", "rest")).alias("c")
    star = (
        prefix.join(prefix.groupBy("gram").agg(purest), "gram")
        .filter(F.col("key") != F.col("c.key"))
        .filter(_possible(F.col("n"), F.col("rest"), F.col("c.n"), F.col("c.rest")))
        .select(
            F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b"),
            F.when(F.col("key") < F.col("c.key"), F.col("n")).otherwise(F.col("c.n")).alias("n_a"),
            F.when(F.col("key") < F.col("c.key"), F.col("c.n")).otherwise(F.col("n")).alias("n_b"),
        )
        .distinct()
    )
    tested = materialise(star, "star")
    first = materialise(_verified(tested, pieces), "links")
    labels = components(first)

    placed = (
        prefix.join(labels.withColumnRenamed("id", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).filter("lo <> hi")
    open_ = placed.join(mixed.select("gram", "least"), "gram").filter(F.col("rest") * 7 >= (F.col("n") + F.col("least")) * 3)
    left = open_.select("gram", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("component").alias("c_a"))
    right = open_.select("gram", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("component").alias("c_b"))
    across = (
        left.join(right, (left.gram == right.gram) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
                  & _possible(F.col("n_a"), F.col("rest_a"), F.col("n_b"), F.col("rest_b")))
        .select("a", "b", "n_a", "n_b").distinct()
    )
    across = materialise(across, "across").join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = first.unionByName(materialise(_verified(across, pieces), "links"))
    labels = components(links)

    held = rows.filter("key IS NOT NULL")
    home = spread_join(held, labels.withColumnRenamed("id", "key"), ["key"], held.groupBy("key").agg(F.count("*").alias("rows_of_key")), "left")
    home = home.withColumn("component", F.coalesce("component", "key"))
    names = home.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows_of_key"))
    out = spread_join(home, names.drop("rows_of_key"), ["component"], names.drop("component_id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone), links, rows.filter("key IS NOT NULL").select("doc_id", F.col("key").alias("class"))


def one_per_component(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is not the one its component is named by; a row without an id stays."""
    other = joined.groupBy("doc_id").agg(F.min(F.col("component_id") != F.col("doc_id")).alias("other")).filter("other")
    return without_ids(docs, other)


def one_row_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: one with the smallest id, a null id last. Null and repeated ids are
    rows like others; rows without shingles are in no group and all stay."""
    keyed = with_row_key(docs)
    joined = ngram_jaccard_join(keyed, id_col=ROW_KEY)[0].filter("n_shingles > 0").select(F.col("doc_id").alias(ROW_KEY), "component_id")
    counted = materialise(joined.groupBy(ROW_KEY, "component_id").agg(F.count("*").alias("copies")), "rows")
    named = materialise(counted.join(keyed.select(ROW_KEY, F.col(id_col).alias("id")).distinct(), ROW_KEY), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW_KEY)).alias("first")
    firsts = named.groupBy("component_id").agg(first, F.count("*").alias("n")).filter("n > 1").select("component_id", F.col(f"first.{ROW_KEY}").alias("stays"))
    sizes = named.groupBy("component_id").agg(F.count("*").alias("rows_of_key"))
    other = spread_join(named, firsts, ["component_id"], sizes).filter(F.col(ROW_KEY) != F.col("stays")).select(F.col(ROW_KEY).alias("doc_id"))
    left = without_ids(keyed, other, ROW_KEY)
    # rows equal in all columns share their key: only those go through a shuffle
    repeated = materialise(named.filter("copies > 1").select(F.col(ROW_KEY).alias("doc_id")), "repeated")
    if not repeated.limit(1).count():
        return left.drop(ROW_KEY)
    twice = left.join(repeated.withColumnRenamed("doc_id", "key_again"), F.col(ROW_KEY) == F.col("key_again"), "left_semi")
    return without_ids(left, repeated, ROW_KEY).unionByName(twice.dropDuplicates([ROW_KEY, text_col])).drop(ROW_KEY)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from pregame.llm.common import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))[0]
