"""Similarity join, decontamination, neighbours and packing against brute force."""

from __future__ import annotations

import bisect
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pregame.llm import decontaminate, jaccard_join, neighbours, packing
from tests.llm.conftest import frame

WORD = public_tokenizers.path("word_bpe_49k.json")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets)), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [f"e{rng.randrange(40)}"], [out[k], "und"]])
    return out or ["x"]


def family_texts(seed):
    """Near copies at every distance, chains of edits, and a passage that most texts share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(180):
        if i % 3 == 0 or not rows:
            base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
            words = base + passage if rng.random() < 0.5 else base
        else:
            words = edited(rng, rng.choice(rows[-12:])[1].split(), rng.choice([0, 0.01, 0.02, 0.04]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_all_pairs(spark, seed):
    rows = family_texts(seed)
    got = jaccard_join.ngram_jaccard_join(frame(spark, rows))[0]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_one_group_of_near_copies_makes_no_pairs(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(150)]
    got, links, _ = jaccard_join.ngram_jaccard_join(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)
    assert links.count() < 20 * len(rows)


def test_jaccard_join_odd_rows(odd, none):
    got = jaccard_join.ngram_jaccard_join(odd)[0]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)
    assert jaccard_join.ngram_jaccard_join(none)[0].count() == 0
    kept = jaccard_join.one_per_component(odd, got)
    assert kept.columns == odd.columns and {1, 2, 3, 4, 8} <= {r.doc_id for r in kept.collect()}


def test_containment_equals_brute_force(spark, odd, none):
    rng = random.Random(3)
    items = [(j, " ".join(f"i{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 12, 30, 70])))) for j in range(40)]
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 50, 3000]))]
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = edited(rng, items[rng.randrange(40)][1].split(), rng.choice([0, 0, 0.03]))
        texts.append((i, " ".join(words)))
    texts.append((500, items[0][1]))
    items += [(90, None), (91, ""), (0, items[0][1])]
    want = sorted(
        (i, j, len(shingles(u)), len(shingles(u) & shingles(t)) / len(shingles(u)))
        for i, t in texts for j, u in items if shingles(u) and len(shingles(u) & shingles(t)) >= 0.75 * len(shingles(u))
    )
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(frame(spark, texts), bench)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    small = decontaminate.BLOCK_SHINGLES
    try:
        decontaminate.BLOCK_SHINGLES = 200
        assert sorted(map(tuple, decontaminate.contained_items(frame(spark, texts), bench).collect())) == want
    finally:
        decontaminate.BLOCK_SHINGLES = small
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(odd, bench.limit(0)).count() == 0
    left = decontaminate.without_leaks(frame(spark, texts), got)
    assert left.count() == len(texts) - len({w[0] for w in want})


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] + [1.0] * 23), (None, [1.0] * 24), (5050, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(axis=1))
    hits = 0
    for q in range(0, 1500, 50):
        s = y @ y[q] / norm / norm[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in got[q])
        hits += len(set(best.tolist()) & {v for _, v, _ in got[q]})
    assert set(got) == set(range(0, 1500, 50)) and hits >= 0.9 * 150
    assert [v for _, v, _ in got[700]] == [701, 702, 703, 704, 705]


def test_neighbours_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest_neighbours(df, lambda i: i == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest_neighbours(df.limit(0), lambda i: i == 0).count() == 0
    assert neighbours.nearest_neighbours(df.limit(1), lambda i: i == 0).count() == 0


def packed_ok(rows, texts, capacity):
    tokenizer = packing.T.load(WORD)
    want = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert not used or max(used.values()) <= capacity
    return used


def test_a_fragment_takes_few_times_its_bytes():
    """Classes meet in a fragment: the arrays of the count stay small against the shingles themselves, which are counted right."""
    rng = np.random.default_rng(1)
    rows, sets = [], {}
    for first in range(0, 2_000, 100):
        keys = np.arange(first, first + 100, dtype=np.int64)
        found = [np.unique(rng.integers(0, 1 << 63, 497, dtype=np.uint64)) for _ in keys]
        found = [np.unique(np.append(v, np.uint64(k % 50))) for k, v in zip(keys, found, strict=True)]
        sets |= dict(zip(keys.tolist(), found, strict=True))
        rows.append((0, None, None, None, keys.tobytes(), np.array([len(v) for v in found], np.uint32).tobytes(), np.concatenate(found).tobytes()))
    rows.append(rows[0])
    names = ["frag", "doc_id", "n", "key", "keys", "counts", "values"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, types, strict=True)], names=names) for r in rows]
    size = sum(map(len, sets.values())) * 8
    tracemalloc.start()
    out = pa.Table.from_batches(jaccard_join._count(iter(batches))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r["key"]: (r["shared"], np.frombuffer(r["values"], np.uint64)[0], np.frombuffer(r["freqs"], np.uint32)[0]) for r in out} == {k: (1, k % 50, 40) for k in sets}
    assert peak < 5 * size


def test_classes_of_many_shingles_are_sent_few_at_a_time():
    """A batch of sets is bounded by its shingles, not by its classes."""
    n = 5_000
    values, freqs = np.arange(n, dtype=np.uint64).tobytes(), np.repeat(np.array([2, 9], np.uint32), n // 2).tobytes()
    rows = [r for k in range(300) for r in ((k, n, None, None), (k, None, values, freqs))]
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("values", pa.binary()), ("freqs", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    out = list(jaccard_join._ordered(iter([batch])))
    assert max(sum(b.column("shared").to_pylist()) for b in out) < 300_000
    assert [k for b in out for k in b.column("key").to_pylist()] == list(range(300))
    last = out[-1].slice(out[-1].num_rows - 1).to_pylist()[0]
    assert (last["n"], last["shared"], last["prefix"]) == (n, n, list(range(1251)))
    assert (last["parts"], last["pieces"]) == ([2, 4], [list(range(n // 2)), list(range(n // 2, n))])


def best_fit_decreasing(lengths, capacity):
    """Sequences of placing piece by piece, largest first, each into the smallest gap that holds it."""
    gaps = []
    sequences = 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        if k == len(gaps):
            sequences += 1
            gap = capacity
        else:
            gap = gaps.pop(k)
        bisect.insort(gaps, gap - x)
    return sequences


def test_packing_is_whole_and_tight(spark, odd, none):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "of", "thing", "Ünder."]) for _ in range(rng.choice([0, 1, 3, 20, 70, 300])))) for i in range(600)]
    rows = packing.pack_documents(frame(spark, texts), WORD, 128).collect()
    used = packed_ok(rows, texts, 128)
    assert len(used) == best_fit_decreasing([r.length for r in rows], 128)
    same = [(i, "") for i in range(500)] + [(900, "the the")]
    used = packed_ok(packing.pack_documents(frame(spark, same), WORD, 64).collect(), same, 64)
    assert len(used) == -(-sum(used.values()) // 64)
    packed_ok(packing.pack_documents(odd, WORD, 4096).collect(), [(r.doc_id, r.text) for r in odd.collect()], 4096)
    assert packing.pack_documents(none, WORD).count() == 0


def test_rounds_open_as_many_sequences_as_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for capacity in (10, 64, 1000):
        for _ in range(20):
            size = rng.choice(np.arange(1, capacity + 1), size=rng.integers(1, min(40, capacity)), replace=False)
            n = rng.integers(1, 60, len(size))
            gaps, sequences, room, placed = packing.Gaps(capacity), 0, {}, 0
            for x, k in sorted(zip(size.tolist(), n.tolist(), strict=True), reverse=True):
                put, sequences = packing._sweep(gaps, x, k, capacity, sequences)
                at = 0
                for length, run, start, times, first, offset in put:
                    assert (length, start) == (x, at)
                    at += run * times
                    for q in range(first, first + run):
                        assert room.get(q, 0) == offset
                        room[q] = offset + times * length
                placed += at
            assert placed == n.sum() and max(room.values()) <= capacity
            assert len(room) == sequences == best_fit_decreasing(np.repeat(size, n).tolist(), capacity)


def test_filters_decide_by_row(spark):
    """Null and repeated ids: each row stays or goes for its own text."""
    rng = random.Random(31)
    text = lambda: " ".join(f"w{rng.randrange(100_000)}" for _ in range(40))
    copied, own, item, clean = text(), text(), text(), text()
    docs = frame(spark, [(None, copied), (None, copied), (7, copied), (3, own), (3, own), (7, own + " more"), (7, clean), (None, None), (None, None), (8, "")])
    kept = jaccard_join.one_row_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, copied), (3, own), (7, clean), (None, None), (None, None), (8, "")], key=repr)
    docs = frame(spark, [(None, f"{clean} {item}"), (5, item), (5, clean), (None, own)])
    left = decontaminate.without_leaking_rows(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and {(r.doc_id, r.text) for r in left.collect()} == {(5, clean), (None, own)}
    good, bad = "eins zwei drei", "x"
    rows = [(i, good, "de", "good") for i in range(100)] + [(200 + i, bad, "de", "bad") for i in range(100)] + [(None, good, "de", "good"), (None, bad, "de", "bad"), (900, good, "de", "good"), (900, bad, "de", "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200 + i, 0) for i in range(100)], "doc_id long, quality int")
    from pregame.llm import quality

    assert sorted(map(tuple, quality.keep_good_rows(docs, labels).collect()), key=repr) == sorted([r for r in rows if r[3] == "good"], key=repr)


@pytest.mark.parametrize(("spread", "many"), [(1e-3, 700), (1e-6, 400)])
def test_neighbours_inside_a_group_of_near_copies(spark, spread, many):
    """Vectors at a cosine of 1 less ``spread`` from each other, beside unrelated ones: recall at 5 within both."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=32)
    near = centre / np.linalg.norm(centre) + rng.normal(size=(many, 32)) * np.sqrt(spread / 32)
    x = rng.permutation(np.concatenate([near, rng.normal(size=(400, 32))]))
    df = spark.createDataFrame([(i, [float(c) for c in v], "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string, rank int")
    got = {}
    for r in neighbours.nearest_neighbours(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q, found in got.items():
        sims = unit @ unit[q]
        sims[q] = -2
        hits.append(len(found & set(np.lexsort((np.arange(len(x)), -sims))[:5].tolist())) / 5)
    assert len(got) == (len(x) + 19) // 20 and np.mean(hits) >= 0.95
