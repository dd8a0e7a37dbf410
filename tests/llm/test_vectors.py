"""Whitening against plain arithmetic."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from pregame.llm import whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, dims int, x string, weight long, n long"


def frame(spark, vectors):
    """Vectors with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in vectors], SCHEMA)


def brute(vectors, by_rows=False, top=4):
    """id -> (n, deviation, |whitened| per component, explained)."""
    rows = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = [x for _, x in rows] if by_rows else sorted({x for _, x in rows})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, dtype=float) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    return [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.abs((np.array(x) - mean) @ axes / np.sqrt(values)), values / np.trace(centred.T @ centred / n)) for i, x in rows]


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(((r.id, r.n, int(r.deviation), np.abs(r.whitened), r.explained) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3]
        assert np.allclose(g[3], w[3], atol=1e-8) and np.allclose(g[4], w[4], rtol=1e-9)


@pytest.mark.parametrize("by_rows", [False, True])
def test_whitening_equals_plain_arithmetic(spark, by_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 7)) * [5, 4, 3, 2, 1, 1, 1] + 40
    vectors = [(i, [float(c) for c in base[i % 300 if i < 400 else 7]]) for i in range(2_000)]  # 1,600 rows share one vector
    got = whitening.whiten_embeddings(frame(spark, vectors), by_rows=by_rows).collect()
    same(got, brute(vectors, by_rows))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i if i % 9 else None, [float(c) for c in rng.normal(size=5) * [9, 7, 5, 3, 1]]) for i in range(60)]
    good += [good[3], good[3], (7, good[5][1])]
    odd = [(101, None), (102, []), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [1.0, float("nan"), 2.0, 3.0, 4.0]), (105, [float("inf")] * 5)]
    same(whitening.whiten_embeddings(frame(spark, good + odd)).collect(), brute(good))


def test_each_length_is_a_list_of_its_own(spark):
    rng = np.random.default_rng(5)
    five = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    three = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    got = whitening.whiten_embeddings(frame(spark, five + three)).collect()
    same([r for r in got if r.dims == 5], brute(five))
    same([r for r in got if r.dims == 3], brute(three))


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in rng.normal(size=4) * 1e9]) for i in range(50)]
    same(whitening.whiten_embeddings(frame(spark, vectors)).collect(), brute(vectors))
    vast = whitening.whiten_embeddings(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 0.0])])).collect()
    assert {r.id for r in vast} == {1, 2, 3}


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten_embeddings(frame(spark, [])).count() == 0
    one = whitening.whiten_embeddings(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [r.whitened for r in one] == [[], []]
    line = whitening.whiten_embeddings(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {len(r.whitened) for r in line} == {1}


def test_query_has_the_stated_rows(spark):
    got = whitening.op12_embedding_whitening(spark, SMALL)
    assert [f.simpleString() for f in got.schema] == [
        "vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double",
    ]
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    found = got.toPandas()
    assert len(found) == 4 * rows and found.identity_error.max() < 1e-8
