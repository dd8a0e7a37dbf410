"""Quality classifier: text evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. Twelve figures of each whole text (length, symbols, case, repeats ...) go into a logistic model, fitted on labelled
   rows: at most ``SAMPLE`` of them, taken by a hash of the id. Its log odds less those of the labels it was
   fitted on are the document's evidence.
2. Labels are counted per host and per path (one grouped aggregation). A host's rate shrinks toward the global rate,
   a path's rate toward its host's; how strongly is estimated from the spread between the groups (beta-binomial
   moments), so sparse sites stay near their prior.
3. Path prior and evidence add up to the posterior log odds; ``keep`` means a posterior of at least ``threshold``.

Null or empty text has all figures 0 and is scored like any row. A null host or path is a group of its own. Several labels
of an id count by their mean (0.5 is good); null labels and labels without a document are ignored. Without
labels, or with labels of one class only, the evidence is 0 and the global rate is that of the labels smoothed by one
label of each class. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import ROW_KEY, TEXT_ROWS, materialise, spread_join, table, with_row_key, without_ids

SAMPLE = 50_000
FIGURES = [
    "log_words", "word_length", "symbols", "upper", "digits", "bars", "distinct", "top_share", "ends", "line_length", "distinct_trigrams", "long_words",
]
_C = np.arange(256)
_UPPER = (_C >= 65) & (_C <= 90)
_DIGIT = (_C >= 48) & (_C <= 57)
_LETTER = _UPPER | ((_C >= 97) & (_C <= 122)) | (_C >= 128)
_SYMBOL = (_C > 32) & ~_LETTER & ~_DIGIT & ~np.isin(_C, [ord(c) for c in ".,;:'\"()-"])


def figures(s: W.Slice) -> np.ndarray:
    """One row of ``FIGURES`` per document of the slice."""
    out = np.zeros((s.n, len(FIGURES)))
    if not len(s.starts):
        return out
    words = W.word_hash(s)
    first = np.concatenate([[0], np.cumsum(s.counts)])
    n = np.maximum(s.counts, 1).astype(float)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag[s.data])])
        mine = total[s.ends] - total[s.starts]
        return np.bincount(s.doc, weights=mine, minlength=s.n)

    length = s.ends - s.starts
    letters = np.bincount(s.doc, weights=length, minlength=s.n)
    chars = np.maximum(letters, 1)
    out[:, 0] = np.log1p(s.counts)
    out[:, 1] = letters / n
    for k, flag in ((2, _SYMBOL), (3, _UPPER), (4, _DIGIT), (5, _C == ord("|"))):
        out[:, k] = per_doc(flag) / chars
    last = s.data[s.ends - 1]
    out[:, 8] = np.bincount(s.doc, weights=np.isin(last, [46, 33, 63]), minlength=s.n) / n
    out[:, 11] = np.bincount(s.doc, weights=length > 24, minlength=s.n) / n
    lines = np.ones(s.n)
    gap_line = np.concatenate([[0], np.cumsum(s.data == 10)])
    full = s.counts > 0
    lines[full] += gap_line[s.ends[first[1:][full] - 1]] - gap_line[s.starts[first[:-1][full]]]
    out[:, 9] = np.log1p(n / lines)
    trigram = W.mix(words + np.roll(words, -1) * W.STEPS[1] + np.roll(words, -2) * W.STEPS[2])
    for d in np.flatnonzero(full):
        mine = np.sort(words[first[d] : first[d + 1]])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]])))
        out[d, 6], out[d, 7] = len(runs) / len(mine), runs.max() / len(mine)
        three = np.sort(trigram[first[d] : max(first[d] + 1, first[d + 1] - 2)])
        out[d, 10] = (1 + np.count_nonzero(three[1:] != three[:-1])) / len(three)
    out[~full] = 0
    return out


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [figures(s) for s in W.slices(batch.column("text"))]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FIGURES)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host", "path")), *(pa.array(rows[:, k]) for k in range(len(FIGURES)))], names=["doc_id", "host", "path", *FIGURES]
        )


def _model(train: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of the logistic model, less the log odds of its sample; zeros for one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, good = train.agg(F.count("*"), F.sum("label")).first()
    good = int(good or 0)
    if not 0 < good < n:
        return [0.0] * len(FIGURES), 0.0
    fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001, maxIter=60).fit(
        VectorAssembler(inputCols=FIGURES, outputCol="x").transform(train)
    )
    return [float(w) for w in fitted.coefficients], float(fitted.intercept) - float(np.log(good / (n - good)))


def _strength(groups: DataFrame, rate: float) -> float:
    """Concentration of a beta prior around ``rate``, by the moments of the groups' rates (1 to 10,000)."""
    share = F.col("good") / F.col("n")
    spread, within = groups.filter("n >= 2").agg(F.avg(F.pow(share - F.lit(rate), F.lit(2))), F.avg(1 / F.col("n"))).first()
    between = (spread or 0.0) - rate * (1 - rate) * (within or 0.0)
    return float(min(max(rate * (1 - rate) / between - 1, 1.0), 10_000.0)) if between > 0 else 10_000.0


def quality_scores(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score (posterior of good), keep per row."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("\0")).alias("path"),
    )
    schema = "doc_id long, host string, path string, " + ", ".join(f"{c} double" for c in FIGURES)
    seen = materialise(base.mapInArrow(_figures, schema), "quality", TEXT_ROWS)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    marks = marks.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = materialise(seen.join(marks, "doc_id"), "quality")
    total = known.count()
    share = F.lit(min(1.0, SAMPLE / max(total, 1)))
    weights, intercept = _model(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))

    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = ((good or 0.0) + 1) / ((n or 0) + 2)
    a, b = _strength(hosts, rate), _strength(paths, rate)
    host = hosts.select("host", ((F.col("good") + a * rate) / (F.col("n") + a)).alias("host_rate"))
    path = paths.join(host, "host").select("host", "path", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))
    evidence = sum((F.col(c) * w for c, w in zip(FIGURES, weights, strict=True)), F.lit(intercept))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence")
    sizes = seen.groupBy("host", "path").agg(F.count("*").alias("rows_of_key"))
    # the rates of each host and path are joined once, and rows of a large site are dealt to several tasks
    rates = (
        sizes.select("host", "path").join(host, "host", "left").join(path, ["host", "path"], "left")
        .withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    )
    return (
        spread_join(seen.select("doc_id", "host", "path", evidence.alias("evidence")), rates, ["host", "path"], sizes)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))
    )


def keep_good(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is rejected; all columns stay, rows without an id too."""
    return without_ids(docs, scores.filter("NOT keep"), id_col)


def keep_good_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``docs`` less the rows that are rejected themselves, with null or repeated ids too; labels are taken by id."""
    keyed = with_row_key(docs)
    marks = keyed.select(ROW_KEY, id_col).dropna().distinct().join(labels.select(id_col, label_col), id_col).select(ROW_KEY, label_col)
    return keep_good(keyed, quality_scores(keyed, marks, id_col=ROW_KEY, label_col=label_col), ROW_KEY).drop(ROW_KEY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
