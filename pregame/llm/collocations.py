"""Phrase collocations per language, mined the way of Toivonen: a sample proposes, full passes count exactly until closed.

1. A sample of the documents is mined level by level at a lowered threshold. Its frequent phrases are the proposal.
2. A full pass counts every word, every proposed phrase and the negative border: windows that are not proposed though
   both their parts without the last and without the first word are. All counts are exact.
3. A border phrase that reaches the threshold joins the proposal, and another pass counts it. A frequent phrase that is still missing
   holds such a phrase, as every part of a frequent phrase is frequent. Where they are few (``AHEAD`` of the words), this pass also counts
   all windows that hold one and whose other parts are not known to be rare, by their text, and is the last. Where they are many, it
   counts the windows that they bring into the border; passes end when no border phrase is frequent, at most one more than the phrase
   length after the first.

Workers test membership of the proposal in a Bloom filter of fixed size (``FILTER_BITS``), whatever the number of phrases. A false
positive only has more windows counted. Proposed phrases are grouped by their text, so their counts are exact; the many of the border
by a 64-bit key, where a shared key could only propose a phrase in vain. Tasks add up their windows before the shuffle.

A phrase of 2 to ``longest`` words with at least ``least`` occurrences is a candidate; it is scored at its weakest cut, left out where a
longer candidate holds it and occurs as often, and ranked per language.

A null or empty text has no words; a null language is ``und``. Rows with null or repeated ids and repeated rows count as rows.
An empty table, or one without frequent phrases, gives no rows. Scores are whole numbers of up to 38 digits before division.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import arrow_rows, materialise, spread_join, table

LEAST, LONGEST, TOP = 100, 5, 2_000
#: One document in ``SAMPLE`` is mined for the proposal, with this share of the threshold that its size calls for.
SAMPLE, LOWERED = 10, 0.4
FILTER_BITS = 1 << 26
SLICE_BYTES, BATCH_ROWS = 1_000_000, 2_000
#: Border windows are added up in a worker until so many keys are held.
HELD_KEYS = 1_000_000
#: Share of all words up to which the occurrences of failed border phrases count as few. One of them lies in at most 14 longer windows of up to five words.
AHEAD = 0.05

_C = np.arange(256)
_BREAK = np.isin(_C, [ord(c) for c in ".,;:!?"]) | ((_C >= 10) & (_C <= 13))
_BLANK = (_C == 32) | (_C == 9)


_LOWER_BLANK = W.lower(np.arange(256).astype(np.uint8))
_LOWER_BLANK[9] = 32


@dataclass
class Words:
    """Words of a run of documents: value, document and piece of each, and where they begin and end in the lower-cased ``text``."""

    value: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    text: bytes
    starts: np.ndarray
    ends: np.ndarray

    def phrases(self, first: np.ndarray, size: int) -> list[bytes]:
        """Words ``first`` to ``first + size`` with one blank between."""
        a, b = self.starts[first], self.ends[first + size - 1]
        letters = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        tight = b - a == letters[first + size] - letters[first] + size - 1
        out = [self.text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        for k in np.flatnonzero(~tight):
            out[k] = b" ".join(w for w in out[k].split(b" ") if w)
        return out


def _words(p: W.Part) -> Words:
    breaks = _BREAK[p.data]
    inside = ~(breaks | _BLANK[p.data])
    edge = np.zeros(len(p.data) + 1, dtype=bool)
    edge[p.at] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]])[: len(inside)] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]])[: len(inside)] | edge[1:])) + 1
    doc = np.searchsorted(p.at, starts, side="right") - 1
    piece = np.concatenate([np.zeros(1, np.int32), np.cumsum(breaks, dtype=np.int32)])[starts] + doc
    return Words(W.Spans(p.data).of(starts, ends), doc, piece, _LOWER_BLANK[p.data].tobytes(), starts, ends)


def lang_value(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Filter:
    """A Bloom filter over 64-bit keys as one array of bytes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield (W.mix(keys + np.uint64(k)) % np.uint64(FILTER_BITS)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for p in self.places(keys):
            found &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return found


def _windows(
    w: Words, salt: np.ndarray, longest: int, known: Filter | None, before: Filter | None, ahead: bool = False
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, first words, keys of the windows to count, and which of them are ``known``: all words, and windows whose two parts are known.

    With ``before``, only what became known since, or came into the border since; ``ahead`` takes what came into the border as known,
    so that the windows around it come too. ``salt`` holds each word's language.
    """
    sums = np.zeros(len(w.value), dtype=np.uint64)
    in_known = in_before = None
    for size in range(1, longest + 1):
        n = len(w.value) - size + 1
        if n <= 0:
            return
        sums = sums[:n] + w.value[size - 1 :] * W.STEPS[(size - 1) % 8]

        def allowed(parts: np.ndarray | None) -> np.ndarray:
            whole = w.piece[:n] == w.piece[size - 1 :]
            return whole if parts is None else whole & parts[:n] & parts[1 : n + 1]

        now = np.flatnonzero(allowed(in_known))
        keys = W.mix(sums[now] + np.uint64(size) + salt[now])
        has = known.has(keys) if known else np.zeros(len(keys), dtype=bool)
        fresh = np.ones(len(now), dtype=bool)
        if before is not None:
            old = allowed(in_before)[now]
            if ahead:
                has |= ~old
            had = np.zeros(len(now), dtype=bool)
            kept = np.flatnonzero(old & has)  # what is in ``before`` is known too
            had[kept] = before.has(keys[kept])
            fresh = np.where(has, ~had, ~old)
            in_before = np.zeros(n, dtype=bool)
            in_before[now[had]] = True
        yield size, now[fresh], keys[fresh], has[fresh]
        if known is None:
            return
        in_known = np.zeros(n, dtype=bool)
        in_known[now[has]] = True


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words, language of each word and its value."""
    langs = batch.column("lang").to_numpy(zero_copy_only=False)
    values = {lang: lang_value(lang) for lang in set(langs)}
    by_row = np.array([values[x] for x in langs], dtype=np.uint64)
    for p in W.parts(batch.column("text"), SLICE_BYTES):
        w = _words(p)
        if len(w.value):
            row = p.first + w.doc
            yield w, langs[row], by_row[row]


def _count_sample(size_wanted: int, known: Broadcast | None):
    """Keys of the windows of one size whose parts are known, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(known.value) if known else None
        for batch in batches:
            for w, _, salt in _slices(batch):
                for size, _, keys, _ in _windows(w, salt, size_wanted, held, None):
                    if size == size_wanted:
                        key, count = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "f"])

    return run


_COUNTS = "border long, key string, f long"


def _count_all(longest: int, known: Broadcast, before: Broadcast | None, ahead: bool = False):
    """Counts per slice: known phrases as language, a tab and the text; those of the border by their key alone, which says enough for
    them. The empty phrase has the number of words, in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = Filter(known.value), Filter(before.value) if before else None

        def batch_of(border: np.ndarray | None, keys: list[bytes] | None, counts: np.ndarray) -> pa.RecordBatch:
            n = len(counts)
            first = pa.nulls(n, pa.int64()) if border is None else pa.array(border.view(np.int64))
            second = pa.nulls(n, pa.string()) if keys is None else pa.array(keys, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([first, second, pa.array(counts.astype(np.int64))], names=["border", "key", "f"])

        border: list[tuple[np.ndarray, np.ndarray]] = []

        def added_up() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*border, strict=True))
            key, place = np.unique(keys, return_inverse=True)
            border.clear()
            return batch_of(key, None, np.bincount(place, weights=counts))

        for batch in batches:
            for w, langs, salt in _slices(batch):
                heads = {lang: f"{lang}\t".encode() for lang in set(langs)}
                if old is None:
                    found, n = np.unique(langs.astype(str), return_counts=True)
                    yield batch_of(None, [heads[x] for x in found], n)
                for size, first, keys, has in _windows(w, salt, longest, now, old, ahead):
                    if not has.all():
                        border.append(np.unique(keys[~has], return_counts=True))
                    if has.any():
                        _, at, count = np.unique(keys[has], return_index=True, return_counts=True)
                        at = first[has][at]
                        yield batch_of(None, [heads[x] + t for x, t in zip(langs[at], w.phrases(at, size), strict=True)], count)
                if sum(len(k) for k, _ in border) > HELD_KEYS:
                    yield added_up()
        if border:
            yield added_up()

    return run


def _bytes_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the keys of one task, as bytes that are not 0."""
    bits = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for batch in batches:
        for p in Filter.places(batch.column("key").to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    set_ = np.flatnonzero(bits.view(np.uint64))
    yield pa.RecordBatch.from_arrays([pa.array(set_.astype(np.int64)), pa.array(bits.view(np.uint64)[set_].view(np.int64))], names=["place", "bits"])


def _filter_of(keys: DataFrame, before: np.ndarray | None = None) -> np.ndarray:
    """Bits of the filter with ``keys`` added. The driver gets ``FILTER_BITS`` / 64 rows at most."""
    found = keys.select("key").mapInArrow(_bytes_set, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits.view(np.uint8) if before is None else bits.view(np.uint8) | before


def propose(sample: DataFrame, least: int, longest: int) -> np.ndarray:
    """Filter of the phrases of up to ``longest`` words with ``least`` occurrences in the sample, mined level by level."""
    bits, held = None, None
    for size in range(1, longest + 1):
        counts = sample.mapInArrow(_count_sample(size, held), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
        bits = _filter_of(counts.filter(F.col("f") >= least), bits)
        held = sample.sparkSession.sparkContext.broadcast(bits)
    return bits


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """lang, phrase, f of all phrases of 1 to ``longest`` words with ``least`` occurrences, and per language the empty phrase with its number of words."""
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id")
    )
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(sample)) == 0
    part = materialise(base.filter(drawn).select("lang", "text"), "sample")
    base = base.select("lang", "text")
    with arrow_rows(spark, BATCH_ROWS):
        bits = propose(part, max(1, int(least / sample * LOWERED)), longest)
        before, found, words, ahead = None, None, None, False
        while True:
            known = spark.sparkContext.broadcast(bits)
            counts = base.mapInArrow(_count_all(longest, known, before, ahead), _COUNTS).groupBy("border", "key").agg(F.sum("f").alias("f"))
            counted = materialise(counts.filter((F.col("f") >= least) | F.col("key").endswith("\t")), "counted")
            # phrases hold no tab
            lang = F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)")
            phrases = counted.filter("key IS NOT NULL").select(lang.alias("lang"), F.substring_index("key", "\t", -1).alias("phrase"), "f")
            found = phrases if found is None else found.unionByName(phrases)
            if ahead:
                return found
            sums = counted.agg(F.sum(F.when(F.col("border").isNotNull(), F.col("f"))).alias("failed"), F.sum(F.when(F.col("key").endswith("\t"), F.col("f"))).alias("words")).first()
            if sums.failed is None:
                return found
            words = sums.words if words is None else words
            ahead = sums.failed <= AHEAD * words
            failed = counted.filter("border IS NOT NULL").select(F.col("border").alias("key"))
            before, bits = known, _filter_of(failed, bits)


def _parts(of: str, first: str, count: str) -> str:
    return f"array_join(slice({of}, {first}, {count}), ' ')"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    found = frequent_phrases(docs, least, longest, sample, text_col, lang_col, id_col)
    phrases = found.filter("phrase != ''").withColumn("words", F.split("phrase", " "))
    candidates = phrases.filter(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr(_parts("words", "1", "k")).alias("head"), F.expr(_parts("words", "k + 1", "size(words) - k")).alias("tail")
    )
    cuts = materialise(cuts, "cuts")
    counts = found.filter("phrase != ''")
    for side, name in (("head", "l"), ("tail", "r")):
        sizes = cuts.groupBy("lang", side).agg(F.count("*").alias("rows_of_key"))
        cuts = spread_join(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], sizes)
    n = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))  # a row per language, with many phrases each
    cuts = spread_join(cuts, n, ["lang"], cuts.groupBy("lang").agg(F.count("*").alias("rows_of_key")))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumns({c: whole(c) for c in "alrn"}).withColumn("score", F.expr("(1000 * a * n) div (l * r)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    ranges = [(i, m) for m in range(2, longest) for i in range(1, longest - m + 2)]
    inner = F.filter(
        F.array(*[F.when(F.size("words") >= i + m - 1, F.struct(F.lit(m).alias("m"), F.expr(_parts("words", str(i), str(m))).alias("phrase"))) for i, m in ranges]),
        lambda x: x.isNotNull() & (x["m"] < F.size("words")),
    ) if ranges else F.array()
    held = candidates.filter(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("p")).groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("f").alias("most")) if ranges else None
    if held is not None:
        weakest = weakest.join(held, ["lang", "phrase"], "left").filter("most IS NULL OR most < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = weakest.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n")], F.col("score").cast("long").alias("score"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same rows by counting every window of every text."""
    return rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT COALESCE(lang, 'und') AS lang,
  UNNEST(string_split_regex(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(SUM(LEN(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, ws, k, UNNEST(range(1, LEN(ws) - k + 2)) AS i FROM pieces, range(1, {longest + 1}) t(k) WHERE LEN(ws) >= k),
freq AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, COUNT(*) AS f FROM spots GROUP BY ALL HAVING COUNT(*) >= {least}),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM freq WHERE k >= 2),
cuts AS (SELECT lang, phrase, k, a, c, array_to_string(ws[1:c], ' ') AS h, array_to_string(ws[c + 1:k], ' ') AS t FROM cand, range(1, {longest}) r(c) WHERE c < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN freq x ON x.lang = cuts.lang AND x.phrase = h JOIN freq y ON y.lang = cuts.lang AND y.phrase = t JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM cand, range(2, {longest}) r(m), range(1, {longest}) s(i) WHERE m < k AND i + m - 1 <= k),
held AS (SELECT lang, phrase, MAX(a) AS most FROM parts GROUP BY ALL),
ranked AS (SELECT w.lang, ROW_NUMBER() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, l, r, n, CAST(score AS BIGINT) AS score
  FROM weakest w LEFT JOIN held ON held.lang = w.lang AND held.phrase = w.phrase WHERE most IS NULL OR most < w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""


OP11_SQL = sql()
