"""Quality rules against a plain version and their SQL."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from pregame.llm import divergence as D
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def classes(text):
    n = [0] * 6
    for c in "".join(WORD.findall(text)):
        n[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in ".,;:!?'\"()-" else 4 if ord(c) < 128 else 5] += 1
    return n


def lowered(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def js(p, q):
    kl = lambda a: sum(x * math.log2(x / ((x + y) / 2)) for x, y in a if x > 0)
    return math.sqrt(max(0.0, (kl(zip(p, q, strict=True)) + kl(zip(q, p, strict=True))) / 2))


def plain_rules(rows):
    """(doc_id, text, lang) -> one row per document."""
    rows = [(i, t or "", lang or "und") for i, t, lang in rows]
    figures = [plain_figures(t) for _, t, _ in rows]
    failed = [f[0] < 50 or 100 * f[4] > 50 * f[0] for f in figures]
    words = [Counter(lowered(w) for w in WORD.findall(t) if all("a" <= c <= "z" or "A" <= c <= "Z" or ord(c) >= 128 for c in w)) for _, t, _ in rows]
    counts = [classes(t) for _, t, _ in rows]

    def means(of_class, of_word, cand):
        mean = [sum(counts[k][c] / figures[k][1] for k in of_class) / len(of_class) for c in range(6)]
        near = Counter(w for k in of_word for w in words[k])
        common = sorted((w for w in cand if near[w]), key=lambda w: (-near[w], cand.index(w)))[:50]
        shares = [sum(words[k][w] / figures[k][0] for k in of_word) / len(of_word) for w in common]
        return mean, common, [*shares, 1 - sum(shares)]

    def away(k, mean, common, shares):
        mine = [words[k][w] / figures[k][0] for w in common] if figures[k][0] else []
        return (
            js([c / figures[k][1] for c in counts[k]], mean) if figures[k][1] >= 200 else None,
            js([*mine, 1 - sum(mine)], shares) if figures[k][0] >= 50 and common else None,
        )

    reference = {}
    for lang, n in Counter(r[2] for r in rows).items():
        texts = list({t: k for k, (_, t, g) in reversed(list(enumerate(rows))) if g == lang and not failed[k]}.values())
        if n * 1000 < len(rows) or len(texts) < 20:
            continue
        df = Counter(w for k, r in enumerate(rows) if r[2] == lang for w in words[k])
        cand = sorted(df, key=lambda w: (-df[w], w.encode()))[:500]
        first = means(texts, texts, cand)
        halves = []
        for kind in (0, 1):
            bins = {k: math.floor(1000 * d) for k in texts if (d := away(k, *first)[kind]) is not None}
            middle = sorted(bins.values())[(len(bins) - 1) // 2]
            halves.append([k for k, v in bins.items() if v <= middle])
        reference[lang] = means(*halves, cand)
    out = []
    for k, (i, _, lang) in enumerate(rows):
        a, b = away(k, *reference[lang]) if lang in reference else (None, None)
        kept = not failed[k] and (a or 0) <= (0.18 if figures[k][1] >= 1000 else 0.33) and (b or 0) <= (0.33 if figures[k][0] >= 200 else 0.45)
        out.append((i, *figures[k], failed[k], kept, a, b))
    return out


def check(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r[:8])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        for a, b in zip(g[8:], w[8:], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_rules_equal_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    got = D.quality_rules(docs).collect()
    check(got, plain_rules(rows))
    assert any(not r.base_failed and not r.kept for r in got)


def test_rules_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    check(D.quality_rules(odd).collect(), plain_rules(rows))
    assert D.quality_rules(none).count() == 0


def test_many_copies_do_not_bend_the_reference(spark):
    """A third of the rows repeat one text of rare words: clean texts stay, symbol junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'")
    texts = [r.text for r in docs.collect()]
    odd_text = " ".join(f"qu{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300))
    rows = list(enumerate(texts + [odd_text] * (len(texts) // 2)))
    langs = {i: "en" for i, _ in rows}
    before = {r.doc_id: r.kept for r in D.quality_rules(frame(spark, list(enumerate(texts)), langs)).collect()}
    after = {r.doc_id: r.kept for r in D.quality_rules(frame(spark, rows, langs)).collect()}
    assert sum(before[i] != after[i] for i in before) <= 1


@pytest.mark.parametrize("sf", ["0.001"])
def test_sql_gives_the_same_rows(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(D.OP13_SQL)
    got = D.op13_quality_rules(spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_labelled_junk_goes_and_good_stays(spark):
    """Held against the quality labels of a larger table, which the rules never see."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    shown = D.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").collect()
    good, junk = [r.kept for r in shown if r.quality == 1], [r.kept for r in shown if r.quality == 0]
    assert sum(good) == len(good) and sum(junk) <= 0.3 * len(junk)
