"""Quality rules: distance of a document's histograms to those of its language.

Base figures of a whole text (below) reject by fixed rules. What passes is held against two references of its language
by the Jensen-Shannon distance (root of the divergence, base 2): the shares of six character classes, and the
shares of the language's commonest words, with one bin for all other words. References come from all documents that
pass the base rules, each distinct text weighing one, so copies do not bend them.

1. Document frequencies of all words of letters give ``CANDIDATES`` words per language.
2. One pass over the texts turns each row into its figures, class counts and counts of those words.
3. Over the distinct texts, the ``COMMON`` words in most texts are chosen and the mean shares taken; then again over the half of
   the texts that is nearest to them, which keeps junk and groups of near copies out of the references.
4. Rows too far from a reference are rejected. Guards: the class test wants ``MIN_CHARS`` characters in words, the word test
   ``MIN_WORDS`` words, and the narrow limits hold for long texts only, as short ones stray by chance; a language has a reference if it has at least
   ``MIN_TEXTS`` such texts and one in ``RARE`` of all rows (which bounds what is broadcast); else the base rules decide.

A null or empty text has figures 0 and fails the base rules. A null language is ``und``. Rows with null or repeated ids and
repeated rows are judged alike, row by row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import TEXT_ROWS, arrow_rows, materialise, table

CANDIDATES, COMMON = 500, 50
#: Largest distances: of any text that is tested, and of texts of ``LONG_CHARS`` and ``LONG_WORDS`` at least.
FAR_CLASSES, FAR_WORDS, LONG_FAR_CLASSES, LONG_FAR_WORDS = 0.33, 0.45, 0.18, 0.33
MIN_CHARS, MIN_WORDS, LONG_CHARS, LONG_WORDS, MIN_TEXTS, RARE = 200, 50, 1_000, 200, 20, 1_000
LEAST_WORDS, MOST_REPEATED = 50, 50
CLASSES = ["lower", "upper", "digit", "mark", "symbol", "other"]
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_C = np.arange(256)
_SPACE = (_C == 32) | ((_C >= 9) & (_C <= 13))
_FIRST = (_C < 128) | (_C >= 192)  # first bytes of code points
_LETTER = ((_C | 32) >= 97) & ((_C | 32) <= 122) & (_C < 128) | (_C >= 128)
_SYMBOL = np.isin(_C, [ord(c) for c in "#*$%&|<>"])
_MARK = np.isin(_C, [ord(c) for c in ".,;:!?'\"()-"])
#: Place in ``CLASSES`` of each byte that begins a code point in a word; 6 for the rest.
_CLASS = np.select(
    [_SPACE | ~_FIRST, (_C >= 97) & (_C <= 122), (_C >= 65) & (_C <= 90), (_C >= 48) & (_C <= 57), _MARK, _C < 128], [6, 0, 1, 2, 3, 4], 5
).astype(np.int64)


def _repeated(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, how often it occurs in its document, and whether it is the first of its kind there."""
    mine = W.mix(values ^ W.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, place, times = np.unique(mine, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(values), dtype=bool)
    is_first[first] = True
    return times[place], is_first


def base_figures(s: W.Slice) -> np.ndarray:
    """A row of ``FIGURES`` per document."""
    out = np.zeros((s.n, len(FIGURES)), dtype=np.int64)
    out[:, 0] = s.counts
    byte_doc = np.repeat(np.arange(s.n), s.sizes)
    out[:, 1] = np.bincount(byte_doc[_CLASS[s.data] < 6], minlength=s.n)
    out[:, 2] = np.bincount(byte_doc[_SYMBOL[s.data]], minlength=s.n)
    if not len(s.starts):
        return out
    spans = W.Spans(s.data, lowered=False)
    # lines: between line feeds and the borders of documents
    begins = np.concatenate([[0], np.cumsum(s.sizes)])[:-1]
    starts = np.union1d(begins[s.sizes > 0], np.flatnonzero(s.data == 10) + 1)
    starts = starts[starts < len(s.data)]
    ends = np.append(starts[1:], len(s.data))
    ends = ends - (s.data[ends - 1] == 10)
    full = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends = starts[full], ends[full]
    line_doc = byte_doc[starts]
    _, first = _repeated(spans.of(starts, ends), line_doc)
    out[:, 3] = np.bincount(line_doc[~first], minlength=s.n)
    words = spans.of(s.starts, s.ends)
    if len(words) >= 3:
        whole = np.flatnonzero(s.doc[2:] == s.doc[:-2])
        windows = W.mix(words[whole] * W.STEPS[0] + words[whole + 1] * W.STEPS[1] + words[whole + 2] * W.STEPS[2])
        times, _ = _repeated(windows, s.doc[whole])
        inside = np.zeros(len(words), dtype=bool)
        again = whole[times >= 2]
        for k in range(3):
            inside[again + k] = True
        out[:, 4] = np.bincount(s.doc[inside], minlength=s.n)
    return out


def class_counts(s: W.Slice) -> np.ndarray:
    """Characters in words per document and class."""
    cell = np.repeat(np.arange(s.n), s.sizes) * 7 + _CLASS[s.data]
    return np.bincount(cell, minlength=s.n * 7).reshape(s.n, 7)[:, :6]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per language and word of letters, added up per slice."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for s in W.slices(batch.column("text")):
            if not len(s.starts):
                continue
            plain = np.concatenate([[0], np.cumsum(~_LETTER[s.data])])
            keep = plain[s.ends] == plain[s.starts]
            words, doc, at, to = W.word_hash(s)[keep], s.doc[keep], s.starts[keep], s.ends[keep]
            _, once = _repeated(words, doc)
            lowered = W.lower(s.data).tobytes()
            mine = langs[s.first + doc]
            for lang in np.unique(mine[once]):
                here = np.flatnonzero(once & (mine == lang))
                _, first, count = np.unique(words[here], return_index=True, return_counts=True)
                texts = [lowered[a:b] for a, b in zip(at[here[first]], to[here[first]], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "word", "texts"]
                )


_FEATURES = "doc_id long, lang string, text_key long, " + ", ".join(f"{c} long" for c in FIGURES) + ", classes array<long>, word_places array<int>, word_counts array<long>"


def _features(words_of: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for lang, found in words_of.items():
            values = np.concatenate([W.word_hash(s) for s in W.slices(pa.array(found, pa.string()))])
            order = np.argsort(values)
            known[lang] = values[order], order
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            figures, classes, places, counts, sizes = [], [], [], [], []
            for s in W.slices(batch.column("text")):
                figures.append(base_figures(s))
                classes.append(class_counts(s))
                words = W.word_hash(s)
                ends = np.cumsum(s.counts)
                for k in range(s.n):
                    values, order = known.get(langs[s.first + k], (None, None))
                    mine = words[ends[k] - s.counts[k] : ends[k]]
                    if values is None or not len(mine):
                        sizes.append(0)
                        continue
                    at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                    hit = np.bincount(order[at[values[at] == mine]], minlength=len(values))
                    some = np.flatnonzero(hit)
                    sizes.append(len(some))
                    places.append(some)
                    counts.append(hit[some])
            figures = np.concatenate(figures) if figures else np.zeros((0, len(FIGURES)), np.int64)
            classes = np.concatenate(classes) if classes else np.zeros((0, 6), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"), batch.column("text_key"), *(pa.array(figures[:, k]) for k in range(len(FIGURES))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(classes) + 1, dtype=np.int32) * 6), pa.array(classes.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int64))),
                ],
                names=["doc_id", "lang", "text_key", *FIGURES, "classes", "word_places", "word_counts"],
            )

    return run


def _distances(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to the reference."""
    middle = (shares + reference) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / middle), 0.0).sum(axis=1)

    return np.sqrt(np.maximum((kl(shares) + kl(np.broadcast_to(reference, shares.shape))) / 2, 0.0))


References = dict[str, tuple[list[float], list[int], list[float]]]


def _away(references: References, columns: list[str]):
    """The rows with their distances, null where there is no test. ``references``: per language the class shares, the places of
    its common words and their shares, the rest last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.full((len(batch), 2), np.nan)
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            chars, n = batch.column("word_chars").to_numpy(), batch.column("n_words").to_numpy()
            classes = batch.column("classes").flatten().to_numpy().reshape(len(batch), 6)
            row = np.repeat(np.arange(len(batch)), batch.column("word_places").value_lengths().to_numpy())
            place, count = (batch.column(c).flatten().to_numpy() for c in ("word_places", "word_counts"))
            for lang in set(langs) & set(references):
                of_class, places, of_words = references[lang]
                long = np.flatnonzero((langs == lang) & (chars >= MIN_CHARS))
                if len(long):
                    far[long, 0] = _distances(classes[long] / chars[long, None], np.array(of_class))
                long = np.flatnonzero((langs == lang) & (n >= MIN_WORDS))
                if len(long) and places:
                    column = np.full(CANDIDATES, -1)
                    column[places] = np.arange(len(places))
                    hit = np.zeros((len(batch), len(places) + 1))
                    some = (langs[row] == lang) & (column[place] >= 0)
                    hit[row[some], column[place[some]]] = count[some]
                    shares = hit[long] / n[long, None]
                    shares[:, -1] = 1 - shares.sum(axis=1)
                    far[long, 1] = _distances(shares, np.array(of_words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(far[:, k], pa.float64(), from_pandas=True) for k in (0, 1))], names=[*columns, "class_distance", "word_distance"]
            )

    return run


def with_distances(features: DataFrame, references: References, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    return features.mapInArrow(_away(references, columns), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", class_distance double, word_distance double")


def _means(classes_of: DataFrame, words_of: DataFrame) -> References:
    """Mean shares of the given texts per language; the driver gets ``CANDIDATES`` rows per language at most."""
    share = lambda k: F.avg(F.get("classes", F.lit(k)) / F.col("word_chars")).alias(CLASSES[k])
    found = {r.lang: r for r in classes_of.groupBy("lang").agg(*[share(k) for k in range(6)]).collect()}
    texts = {r.lang: r["count"] for r in words_of.groupBy("lang").count().collect()}
    words = (
        words_of.select("lang", "n_words", F.explode(F.arrays_zip("word_places", "word_counts")).alias("w"))
        .groupBy("lang", F.col("w.word_places").alias("place"))
        .agg(F.count("*").alias("texts"), F.sum(F.col("w.word_counts") / F.col("n_words")).alias("share"))
    )
    common: dict[str, list] = {}
    for r in words.collect():
        common.setdefault(r.lang, []).append((-r.texts, r.place, r.share / texts[r.lang]))
    out = {}
    for lang, r in found.items():
        best = sorted(common.get(lang, []))[:COMMON]
        shares = [x[2] for x in best]
        out[lang] = [float(r[c]) for c in CLASSES], [x[1] for x in best], [*shares, 1 - sum(shares)]
    return out


def _middle(away: DataFrame, column: str) -> DataFrame:
    """lang, middle: the bin (a thousandth wide) that holds the median of ``column``."""
    bins = away.dropna(subset=[column]).groupBy("lang", F.floor(F.col(column) * 1000).alias("bin")).count()
    w = Window.partitionBy("lang")
    placed = bins.withColumn("so_far", F.sum("count").over(w.orderBy("bin"))).withColumn("texts", F.sum("count").over(w))
    return placed.filter(2 * F.col("so_far") >= F.col("texts")).groupBy("lang").agg(F.min("bin").alias("middle"))


def references_of(features: DataFrame) -> References:
    """Mean shares of the half of a language's texts that is nearest to the mean of all, so junk and near copies weigh little.

    At most ``RARE`` languages come to the driver.
    """
    kept = ["lang", "n_words", "word_chars", "classes", "word_places", "word_counts"]
    texts = materialise(features.filter(~_base_failed()).groupBy("lang", "text_key").agg(*[F.first(c).alias(c) for c in kept[1:]]), "texts")
    rows = features.groupBy("lang").agg(F.count("*").alias("rows"))
    total = rows.agg(F.sum("rows")).first()[0] or 0
    used = rows.filter(F.col("rows") * RARE >= total).join(texts.groupBy("lang").agg(F.count("*").alias("texts")).filter(F.col("texts") >= MIN_TEXTS), "lang").select("lang")
    texts = texts.join(F.broadcast(used), "lang")  # RARE rows at most
    away = materialise(with_distances(texts, _means(texts, texts), kept), "away", TEXT_ROWS)
    near = lambda c: away.join(F.broadcast(_middle(away, c)), "lang").filter(F.floor(F.col(c) * 1000) <= F.col("middle"))
    return _means(near("class_distance"), near("word_distance"))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the figures, base_failed, kept, class_distance and word_distance (null: not tested) per row."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    sizes = base.groupBy("lang").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    usual = sizes.filter(F.col("count") * RARE >= total).select("lang")  # RARE rows at most
    seen = base.select("lang", "text").join(F.broadcast(usual), "lang").mapInArrow(_frequencies, "lang string, word string, texts long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("texts"), "word"))
    best = seen.groupBy("lang", "word").agg(F.sum("texts").alias("texts")).withColumn("rank", rank).filter(F.col("rank") <= CANDIDATES)
    words_of: dict[str, list[str]] = {}
    with arrow_rows(base.sparkSession, TEXT_ROWS):
        for r in best.select("lang", "word", "rank").orderBy("lang", "rank").collect():
            words_of.setdefault(r.lang, []).append(r.word)
    features = materialise(base.withColumn("text_key", F.xxhash64("text")).select("doc_id", "lang", "text_key", "text").mapInArrow(_features(words_of), _FEATURES), "features", TEXT_ROWS)
    judged = with_distances(features, references_of(features), ["doc_id", *FIGURES])
    classes_far = F.when(F.col("word_chars") >= LONG_CHARS, LONG_FAR_CLASSES).otherwise(FAR_CLASSES)
    words_far = F.when(F.col("n_words") >= LONG_WORDS, LONG_FAR_WORDS).otherwise(FAR_WORDS)
    near = (F.coalesce("class_distance", F.lit(0.0)) <= classes_far) & (F.coalesce("word_distance", F.lit(0.0)) <= words_far)
    return judged.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & near).select(
        "doc_id", *FIGURES, "base_failed", "kept", "class_distance", "word_distance"
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *FIGURES, "base_failed", "kept")


def _sql_distances(n: str, of_classes: str, of_words: str) -> str:
    """CTEs ending in far``n``: rid, kind, js of every row against the mean shares of the given texts."""
    shares = ", ".join(f"AVG(c{k} / word_chars)" for k in range(6))
    return f"""many{n} AS (SELECT lang, COUNT(*) AS texts FROM {of_words} GROUP BY lang),
common{n} AS (SELECT lang, word, SUM(low.n / b.n_words) / ANY_VALUE(texts) AS q FROM low JOIN cand USING (lang, word) JOIN {of_words} t USING (lang, rid) JOIN base b USING (lang, rid)
  JOIN many{n} USING (lang) GROUP BY lang, word, place QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, place) <= {COMMON}),
bins{n} AS (SELECT base.rid, COALESCE(low.n / n_words, 0) AS p, q FROM base JOIN common{n} c ON c.lang = base.lang LEFT JOIN low ON low.rid = base.rid AND low.word = c.word
  WHERE n_words >= {MIN_WORDS}),
classes{n} AS (SELECT lang, UNNEST([{shares}]) AS q, UNNEST(range(6)) AS k FROM {of_classes} t JOIN base USING (lang, rid) GROUP BY lang),
every{n} AS (SELECT rid, 'word' AS kind, p, q FROM bins{n} UNION ALL SELECT rid, 'word', 1 - SUM(p), 1 - SUM(q) FROM bins{n} GROUP BY rid
  UNION ALL SELECT rid, 'class', [c0, c1, c2, c3, c4, c5][k + 1] / word_chars, q FROM base JOIN classes{n} USING (lang) WHERE word_chars >= {MIN_CHARS}),
far{n} AS (SELECT rid, kind, SQRT(GREATEST(SUM(CASE WHEN p > 0 THEN p * LOG2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * LOG2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js
  FROM every{n} GROUP BY rid, kind)"""


#: The same rows in SQL.
OP13_SQL = rf"""WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(lang, 'und') AS lang, COALESCE(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS chars FROM d),
w AS (SELECT rid, lang, UNNEST(ws) AS w, UNNEST(range(1, LEN(ws) + 1)) AS i FROM l),
three AS (SELECT rid, i, w || chr(32) || LEAD(w) OVER p || chr(32) || LEAD(w, 2) OVER p AS t FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM three WHERE t IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY rid, t) >= 2),
repeated AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY rid),
lines AS (SELECT rid, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT rid, UNNEST(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
figures AS (SELECT rid, doc_id, lang, text, CAST(LEN(ws) AS BIGINT) AS n_words, CAST(LENGTH(chars) AS BIGINT) AS word_chars,
  CAST(LENGTH(regexp_replace(chars, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(lines.n, 0) AS n_dup_lines, COALESCE(repeated.n, 0) AS n_repeat_words,
  LENGTH(regexp_replace(chars, '[^a-z]', '', 'g')) AS c0, LENGTH(regexp_replace(chars, '[^A-Z]', '', 'g')) AS c1, LENGTH(regexp_replace(chars, '[^0-9]', '', 'g')) AS c2,
  LENGTH(regexp_replace(chars, '[^.,;:!?\x27"()-]', '', 'g')) AS c3, LENGTH(regexp_replace(chars, '[\x00-\x7F]', '', 'g')) AS c5, LENGTH(chars) - c0 - c1 - c2 - c3 - c5 AS c4
  FROM l LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM figures),
usual AS (SELECT lang FROM d GROUP BY lang HAVING COUNT(*) * {RARE} >= (SELECT COUNT(*) FROM d)),
texts AS (SELECT lang, MIN(rid) AS rid FROM base WHERE NOT base_failed GROUP BY lang, text),
enough AS (SELECT lang, COUNT(*) AS texts FROM texts JOIN usual USING (lang) GROUP BY lang HAVING COUNT(*) >= {MIN_TEXTS}),
low AS (SELECT rid, lang, TRANSLATE(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, COUNT(*) AS n
  FROM w JOIN usual USING (lang) WHERE regexp_full_match(w, '[a-zA-Z\x{{80}}-\x{{10FFFF}}]+') GROUP BY ALL),
cand AS (SELECT lang, word, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, word) AS place FROM low GROUP BY lang, word QUALIFY place <= {CANDIDATES}),
passed AS (SELECT rid, lang FROM texts JOIN enough USING (lang)),
{_sql_distances("1", "passed", "passed")},
middles AS (SELECT lang, kind, bin FROM (SELECT lang, kind, CAST(FLOOR(js * 1000) AS BIGINT) AS bin, COUNT(*) AS n FROM far1 JOIN passed USING (rid) GROUP BY ALL)
  QUALIFY 2 * SUM(n) OVER (PARTITION BY lang, kind ORDER BY bin) >= SUM(n) OVER (PARTITION BY lang, kind)),
middle AS (SELECT lang, kind, MIN(bin) AS bin FROM middles GROUP BY ALL),
inner_half AS (SELECT rid, lang, kind FROM far1 JOIN passed USING (rid) JOIN middle USING (lang, kind) WHERE FLOOR(js * 1000) <= bin),
{_sql_distances("2", "(SELECT * FROM inner_half WHERE kind = 'class')", "(SELECT * FROM inner_half WHERE kind = 'word')")},
bad AS (SELECT DISTINCT rid FROM far2 JOIN base USING (rid) WHERE js > CASE WHEN kind = 'word' THEN CASE WHEN n_words >= {LONG_WORDS} THEN {LONG_FAR_WORDS} ELSE {FAR_WORDS} END
  WHEN word_chars >= {LONG_CHARS} THEN {LONG_FAR_CLASSES} ELSE {FAR_CLASSES} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM base LEFT JOIN bad USING (rid)"""
