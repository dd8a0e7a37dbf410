"""Language identification by hierarchical discrimination.

Families first: one linear support vector machine per family against the others. Then, inside the winning family,
one machine for each pair of its languages; most wins decide, equal wins by the sum of margins. Figures are the shares
of hashed byte trigrams of the whole text (letters lower-cased, all else as blanks), so a machine's margin is a sum over
the text's trigrams: one pass over a text serves all machines.

The machines are fitted on at most about ``SAMPLE`` rows of each language, taken by a hash of the id, each machine in a
task of its own. Null or letterless texts are ``und`` with score 0. Rows with a null language or id are not learned from.
With one language learned it is always predicted; with none every text is ``und``. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import materialise, remainder, table

#: Language codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi ur bn pa mr gu ne",
    "turkic": "tr az kk uz ky",
    "uralic": "fi et hu",
}
SAMPLE = 1_500
BUCKETS = 4_096
SCALE = 100.0
_B = np.arange(256)
_MAP = np.where((_B >= 65) & (_B <= 90), _B + 32, np.where(((_B >= 97) & (_B <= 122)) | (_B >= 128), _B, 32)).astype(np.uint32)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"={code}")


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and where each document's begin; blanks pad both ends of a text, runs of blanks go."""
    n = len(at) - 1
    mapped = _MAP[data]
    keep = mapped != 32
    keep[1:] |= mapped[:-1] != 32
    edge = at[:-1][np.diff(at) > 0]
    keep[edge] = mapped[edge] != 32
    sizes = np.concatenate([[0], np.cumsum(keep)])
    sizes = sizes[at[1:]] - sizes[at[:-1]]
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    line = np.full(starts[-1], 32, dtype=np.uint32)
    line[np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(n) + 1, sizes)] = mapped[keep]
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    value = line[:-2] | (line[1:-1] << np.uint32(8)) | (line[2:] << np.uint32(16))
    value = (value * np.uint32(0x9E3779B1)) >> np.uint32(20)
    inner = np.ones(len(value), dtype=bool)
    inner[starts[1:-1] - 1] = False
    inner[starts[1:-1] - 2] = False
    return value[inner].astype(np.int64), starts[:-1] - 2 * np.arange(n)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for s in W.parts(column):
        bucket, starts = trigrams(s.data, s.at)
        yield s.first, s.n, bucket, starts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, bucket, starts in _slices(batch.column("text")):
            rows = []
            for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                own, count = np.unique(bucket[a:b], return_counts=True)
                rows.append((own.astype(np.uint16).tobytes(), (count / max(b - a, 1)).astype(np.float32).tobytes()))
            x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, n), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["lang", "buckets", "shares"])


def _machine(rows: pd.DataFrame) -> pd.DataFrame:
    """Linear machine with squared hinge loss, by accelerated gradient steps; the last weight is the offset."""
    x = np.zeros((len(rows), BUCKETS + 1), dtype=np.float32)
    for i, (b, s) in enumerate(zip(rows.buckets, rows.shares, strict=True)):
        x[i, np.frombuffer(b, np.uint16)] = np.frombuffer(s, np.float32) * SCALE
    x[:, -1] = 1
    y = np.where(rows.positive, 1, -1).astype(np.float32)
    c = np.where(rows.positive, 0.5 / max(rows.positive.sum(), 1), 0.5 / max((~rows.positive).sum(), 1)).astype(np.float32)
    decay = 1e-3
    step = 1 / (2 * float((c * (x * x).sum(axis=1)).sum()) + decay)
    w = old = np.zeros(BUCKETS + 1, dtype=np.float32)
    for k in range(300):
        v = w + (k / (k + 3)) * (w - old)
        grad = -2 * ((c * y * np.maximum(0, 1 - y * (x @ v))) @ x) + decay * v
        old, w = w, v - step * grad
    return pd.DataFrame({"machine": [rows.machine.iloc[0]], "weights": [w.astype(np.float32).tobytes()]})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, families, machines, weights = shared.value
        column = {m: k for k, m in enumerate(machines)}
        for batch in batches:
            for first, n, bucket, starts in _slices(batch.column("text")):
                size = np.diff(np.append(starts, len(bucket)))
                margin = np.zeros((n, len(machines)))
                full = np.flatnonzero(size > 0)
                for k in range(len(machines)):
                    if len(full):
                        margin[full, k] = np.add.reduceat(weights[bucket, k], starts[full]) * SCALE / size[full]
                    margin[:, k] += weights[-1, k]
                best = np.zeros(n, dtype=np.int64)
                sure = np.ones(n)
                if len(families) > 1:
                    m = np.stack([margin[:, column[f"family {f}"]] for f in families], axis=1)
                    best = m.argmax(axis=1)
                    sure = 1 / (1 + np.exp(-2 * np.clip(m.max(axis=1), -15, 15)))
                pred = np.empty(n, dtype=object)
                for k, f in enumerate(families):
                    mine = np.flatnonzero(best == k)
                    own = languages[f]
                    wins, sums = np.zeros((len(mine), len(own))), np.zeros((len(mine), len(own)))
                    for i in range(len(own)):
                        for j in range(i + 1, len(own)):
                            v = margin[mine, column[f"pair {own[i]} {own[j]}"]]
                            wins[:, i] += v > 0
                            wins[:, j] += v <= 0
                            sums[:, i] += v
                            sums[:, j] -= v
                    top = (wins + 1e-3 * np.tanh(sums)).argmax(axis=1)
                    pred[mine] = np.array(own, dtype=object)[top]
                    if len(own) > 1:
                        mean = sums[np.arange(len(mine)), top] / (len(own) - 1)
                        sure[mine] *= 1 / (1 + np.exp(-2 * np.clip(mean, -15, 15)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in ("doc_id", "letters")), pa.array(pred.tolist(), pa.string()), pa.array(sure)], names=["doc_id", "letters", "pred", "sure"]
                )

    return run


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score per row of ``docs``; only ``labelled`` (id, text, lang) is learned from."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna().filter(F.rlike("text", F.lit(r"\p{L}")))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, SAMPLE / n)))[F.col("lang")]
    sample = materialise(
        known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).mapInArrow(_counts, "lang string, buckets binary, shares binary"), "languages"
    )
    languages: dict[str, list[str]] = {}
    for lang in sorted(counts):
        languages.setdefault(family_of(lang), []).append(lang)
    families = sorted(languages)
    tasks = []
    if len(families) > 1:
        tasks += [sample.select(F.lit(f"family {f}").alias("machine"), F.col("lang").isin(languages[f]).alias("positive"), "buckets", "shares") for f in families]
    for own in languages.values():
        tasks += [
            sample.filter(F.col("lang").isin(a, b)).select(F.lit(f"pair {a} {b}").alias("machine"), (F.col("lang") == a).alias("positive"), "buckets", "shares")
            for i, a in enumerate(own) for b in own[i + 1 :]
        ]
    machines, weights = [], np.zeros((BUCKETS + 1, 0), dtype=np.float32)
    if tasks:
        every = tasks[0]
        for t in tasks[1:]:
            every = every.unionByName(t)
        fitted = every.groupBy("machine").applyInPandas(_machine, "machine string, weights binary").collect()
        machines = [r.machine for r in fitted]
        weights = np.stack([np.frombuffer(r.weights, np.float32) for r in fitted], axis=1)
        for own in languages.values():  # a language of which the sample holds no row loses its pairs
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    if f"pair {a} {b}" not in machines:
                        machines.append(f"pair {a} {b}")
                        weights = np.concatenate([weights, np.zeros((BUCKETS + 1, 1), np.float32)], axis=1)
    shared = spark.sparkContext.broadcast((languages, families, machines, np.ascontiguousarray(weights)))
    out = rows.mapInArrow(_predict(shared), "doc_id long, letters boolean, pred string, sure double")
    return out.select("doc_id", F.when(F.col("letters"), F.col("pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("sure")).otherwise(0.0).alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = identify_languages(docs, docs.filter(remainder("doc_id", 5) != 0))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
