"""Collocations against counting every window."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pregame.llm import collocations as C
from tests.llm.conftest import frame

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2_000):
    """(text, lang) -> the rows of the query."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    inside = {}
    for (lang, p), c in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                inside[key] = max(inside.get(key, 0), c)
    out = []
    for lang in n:
        best = []
        for (g, p), a in f.items():
            if g != lang or len(p) < 2 or inside.get((g, p), 0) >= a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, many=200):
    rng = random.Random(seed)
    fixed = [[f"P{k}{j}" for j in range(rng.randrange(2, 9))] for k in range(6)]
    out = []
    for i in range(many):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words += rng.choice(fixed) if rng.random() < 0.3 else [f"w{int(rng.paretovariate(0.8)) % 90}"]
            words[-1:] = [words[-1] + rng.choice(["", "", "", ".", ",", "\n", "  ", "\t", " ! "])] if words else []
        out.append((i, " ".join(words)))
    return out, {i: ["en", "de", None][i % 3] for i in range(many)}


@pytest.mark.parametrize(("seed", "sample", "top"), [(1, 10, 2_000), (2, 1, 7), (3, 1_000_000, 2_000)])
def test_collocations_equal_counting_all(spark, seed, sample, top):
    """With a tenth, all and (nearly) nothing as the sample: the proposal never changes the result."""
    rows, langs = texts(seed)
    got = C.collocations(frame(spark, rows, langs), least=8, top=top, sample=sample)
    want = plain([(t, langs[i]) for i, t in rows], 8, top=top)
    assert sorted(map(tuple, got.collect())) == want and len({len(w[2].split()) for w in want}) > (2 if top > 7 else 0)


def test_expansion_passes_run(spark, monkeypatch):
    """An empty proposal fails at each border and is closed by expansion."""
    rows, langs = texts(4)
    passes = []
    count_all = C._count_all
    monkeypatch.setattr(C, "_count_all", lambda *a: passes.append(1) or count_all(*a))
    monkeypatch.setattr(C, "propose", lambda *_: np.zeros(C.FILTER_BITS >> 3, np.uint8))
    got = C.collocations(frame(spark, rows, langs), least=8)
    assert sorted(map(tuple, got.collect())) == plain([(t, langs[i]) for i, t in rows], 8)
    assert 2 < len(passes) <= 6


def test_few_failures_are_closed_by_one_pass(spark, monkeypatch):
    """Phrases of five words that the sample misses whole: one more pass, not one per level."""
    rows, langs = texts(6)
    missed = [(1_000 + i, f"r1 r2  r3 r4 r5 w{i % 3}, r4 r5 r1 r2") for i in range(9)]
    langs |= {i: "en" for i, _ in missed}
    passes = []
    count_all, propose = C._count_all, C.propose
    monkeypatch.setattr(C, "_count_all", lambda *a: passes.append(1) or count_all(*a))
    monkeypatch.setattr(C, "propose", lambda sample, *a: propose(sample.filter("text NOT LIKE 'r1 r2%'"), *a))
    got = sorted(map(tuple, C.collocations(frame(spark, rows + missed, langs), least=8, sample=1).collect()))
    assert got == plain([(t, langs[i]) for i, t in rows + missed], 8)
    assert any(p == "r1 r2 r3 r4 r5" for _, _, p, *_ in got) and len(passes) == 2


def test_full_filter_counts_more_and_finds_the_same(spark, monkeypatch):
    rows, langs = texts(5)
    monkeypatch.setattr(C, "propose", lambda *_: np.full(C.FILTER_BITS >> 3, 255, np.uint8))
    got = C.collocations(frame(spark, rows, langs), least=8)
    assert sorted(map(tuple, got.collect())) == plain([(t, langs[i]) for i, t in rows], 8)


def test_collocations_of_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(map(tuple, C.collocations(odd, least=2).collect())) == plain(rows, 2)
    assert C.collocations(none).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r of a large corpus, by the plan's own expression."""
    big = spark.createDataFrame([(10**13, 10**14, 10**13, 9 * 10**13)], "a long, n long, l long, r long")
    got = big.selectExpr(*[f"CAST({c} AS DECIMAL(19,0)) AS {c}" for c in "anlr"]).selectExpr("(1000 * a * n) div (l * r) AS s").first().s
    assert got == 1000 * 10**13 * 10**14 // (10**13 * 9 * 10**13)


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(C.sql(20))
    got = C.collocations(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), least=20)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
