"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents; the tagger needs labelled tokens. Words and word beginnings that occur in toxic texts far more
often than in clean ones (by documents, each text once) label the words of toxic texts; words of clean texts are
all clean. The field has two states, weights for the word, its beginnings, its ending and its neighbours, and
transition weights; it is fitted by gradient steps over forward-backward marginals on a bounded sample of labelled
rows. Every text is then tagged whole: the marginals of its words add up to the document's evidence, which a logistic
curve, fitted on sample rows kept apart, turns into the score; words with a marginal of a half or more
are the offending spans.

The sample holds at most about ``TOXIC`` and ``CLEAN`` rows, chosen by a hash of the id. Several labels of an id count by
their mean, null labels and null ids are not learned from. Without labelled texts of both classes every score is the share of
toxic labels (0 without labels). Null, empty and wordless texts get the curve's value for no toxic word.
Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import words as W
from pregame.llm.common import materialise, remainder, table

TOXIC, CLEAN = 4_000, 8_000
#: Bits of the weight table, and how many templates there are.
BITS, TEMPLATES = 18, 8
BLOCK = 256
EPOCHS, RATE, DECAY = 6, 0.3, 1e-5
RATIO, SUPPORT = 20.0, 5
_TRIM = np.isin(np.arange(256), [ord(c) for c in ".,;:!?#*$%&|\"'()[]{}<>-_=+/~`"])


def tokens(s: W.Slice) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of the words less punctuation around them, and their lexical values."""
    starts, ends = s.starts.copy(), s.ends.copy()
    for _ in range(8):
        ends -= (ends - starts > 1) & _TRIM[s.data[ends - 1]]
        starts += (ends - starts > 1) & _TRIM[s.data[starts]]
    spans = W.Spans(s.data)
    lexical = [spans.of(starts, ends)] + [W.mix(spans.of(starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in (4, 5, 6, 7)]
    ending = W.mix(spans.of(np.maximum(starts, ends - 4), ends) + np.uint64(99))
    return starts, ends, [*lexical, ending]


def lookups(s: W.Slice, lexical: list[np.ndarray]) -> np.ndarray:
    """Rows of the weight table for each word: one column per template."""
    word = lexical[0]
    same = np.zeros(len(word) + 1, dtype=bool)
    same[1:-1] = s.doc[1:] == s.doc[:-1]
    before = np.where(same[:-1], np.roll(word, 1), np.uint64(1))
    after = np.where(same[1:], np.roll(word, -1), np.uint64(2))
    columns = [*lexical, before, after]
    shift = np.uint64(64 - BITS)
    return np.stack([W.mix(c + np.uint64((7 + k) * W.BASE & 0xFFFFFFFFFFFFFFFF)) >> shift for k, c in enumerate(columns)], axis=1).astype(np.int32)


def _chain(x: np.ndarray, reset: np.ndarray, start: float, a: np.ndarray, right: bool) -> np.ndarray:
    """Ratios along one long chain that begins anew where ``reset``; blocks are composed, then run side by side.

    Forward: r = x (a01 + a11 r) / (a00 + a10 r), or x * start at a reset. ``right`` gives the backward ratios, with the
    arrays reversed: the value after a position, b' = (a10 + a11 x b) / (a00 + a01 x b), from b = 1 at a reset.
    """
    n = len(x)
    if not n:
        return x
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    xs = np.concatenate([x, np.ones(pad)]).reshape(blocks, BLOCK).T
    rs = np.concatenate([reset, np.ones(pad, dtype=bool)]).reshape(blocks, BLOCK).T
    a00, a01, a10, a11 = a

    def maps(k: int) -> tuple[np.ndarray, ...]:
        v, on = xs[k], rs[k]
        if right:  # acts on the ratio behind this position; a reset replaces it by 1 first
            p, q, u, w = a11 * v, np.full(blocks, a10), a01 * v, np.full(blocks, a00)
            return np.where(on, 0, p), np.where(on, p + q, q), np.where(on, 0, u), np.where(on, u + w, w)
        return np.where(on, 0, a11 * v), np.where(on, v * start, a01 * v), np.where(on, 0, a10), np.where(on, 1, a00)

    p, q, u, w = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(BLOCK):
        mp, mq, mu, mw = maps(k)
        p, q, u, w = mp * p + mq * u, mp * q + mq * w, mu * p + mw * u, mu * q + mw * w
        top = np.maximum(np.maximum(p, q), np.maximum(u, w))
        p, q, u, w = p / top, q / top, u / top, w / top
    enter = np.ones(blocks)
    now = 1.0
    for k, (pk, qk, uk, wk) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), w.tolist(), strict=True)):
        enter[k] = now
        now = (pk * now + qk) / (uk * now + wk)
    out = np.empty((BLOCK, blocks))
    r = enter
    for k in range(BLOCK):
        if right:
            r = np.where(rs[k], 1.0, r)
            out[k] = r
            r = (a10 + a11 * xs[k] * r) / (a00 + a01 * xs[k] * r)
        else:
            r = np.where(rs[k], xs[k] * start, xs[k] * (a01 + a11 * r) / (a00 + a10 * r))
            out[k] = r
    return out.T.ravel()[:n]


def marginals(unary: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic state of each word, with forward and backward ratios.

    ``first`` marks the first word of each document; ``moves``: log weights of start, 0 to 1, 1 to 0, 1 to 1.
    """
    x = np.exp(np.clip(unary, -30, 30))
    a = np.array([1.0, *np.exp(moves[1:])])
    forward = _chain(x, first, float(np.exp(moves[0])), a, False)
    last = np.append(first[1:], True) if len(first) else first
    backward = _chain(x[::-1], last[::-1], 1.0, a, True)[::-1]
    odds = forward * backward
    return odds / (1 + odds), forward, backward


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a lexical value, summed over a batch."""
    for batch in batches:
        toxic = batch.column("label").to_numpy() == 1
        for s in W.slices(batch.column("text")):
            _, _, lexical = tokens(s)
            for values in lexical[:5]:
                order = np.lexsort((s.doc, values))
                v, d = values[order], s.doc[order]
                new = np.ones(len(v), dtype=bool)
                new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                v, t = v[new], toxic[s.first + d[new]]
                own, at = np.unique(v, return_index=True)
                if len(own):
                    bad = np.add.reduceat(t.astype(np.int64), at)
                    both = np.diff(np.append(at, len(v)))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(bad), pa.array(both - bad)], names=["value", "toxic", "clean"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column("text")):
            seq = W.sequence_hash(s).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.first, s.n) for c in ("doc_id", "text", "label")), pa.array(seq)], names=["doc_id", "text", "label", "seq"])


def _fit(shared):
    """Learns the field from the sample's rows, and the curve from a fifth of them kept apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rate = shared.value
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            label = batch.column("label").to_numpy() == 1
            for s in W.slices(batch.column("text"), 400_000):
                if not len(s.doc):
                    continue
                _, _, lexical = tokens(s)
                mine = label[s.first + s.doc]
                first = np.append(True, s.doc[1:] != s.doc[:-1])
                if len(parts) >= 4 * (len(kept) + 1):
                    kept.append((lookups(s, lexical), mine, first))
                    continue
                y = np.zeros(len(s.doc), dtype=bool)
                for v in lexical[:5] if len(lexicon) else []:
                    y |= lexicon[np.minimum(np.searchsorted(lexicon, v), len(lexicon) - 1)] == v
                parts.append((lookups(s, lexical), y & mine, first))
        weights, moves = _learn(parts)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([moves.tobytes()], pa.binary()), pa.array([np.array(_curve(kept or parts, weights, moves, rate)).tobytes()], pa.binary())], names=["weights", "moves", "curve"])

    return run


def _learn(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad over parts of the sample; gradients are expected less observed counts."""
    weights = np.zeros(1 << BITS)
    seen = np.full(1 << BITS, 1e-6)
    moves, seen_moves = np.array([-3.0, -3.0, 0.0, 0.0]), np.full(4, 1e-6)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(parts)):
            ids, y, first = parts[k]
            p, forward, backward = marginals(weights[ids].sum(axis=1), first, moves)
            grad = np.bincount(ids.ravel(), weights=np.repeat(p - y, TEMPLATES), minlength=1 << BITS) + DECAY * len(y) * weights
            seen += grad * grad
            weights -= RATE * grad / np.sqrt(seen)
            inner = np.flatnonzero(~first)
            x = np.exp(np.clip(weights[ids[inner]].sum(axis=1), -30, 30))
            a = np.exp(moves)
            f, b = forward[inner - 1], backward[inner]
            mass = np.stack([np.ones(len(inner)), a[1] * x * b, a[2] * f, a[3] * f * x * b])
            mass /= mass.sum(axis=0)
            was, now = y[inner - 1], y[inner]
            g = np.array([(p[first] - y[first]).sum(), mass[1].sum() - (~was & now).sum(), mass[2].sum() - (was & ~now).sum(), mass[3].sum() - (was & now).sum()])
            seen_moves += g * g
            moves = moves - 0.1 * g / np.sqrt(seen_moves)
    return weights, moves


def _per_doc(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Evidence of each document: -log of the chance that no word is toxic, each word weighed by its own marginal, so
    that the many faint marginals of a long clean text add up to nothing."""
    return np.add.reduceat(-np.log1p(-np.minimum(p, 1 - 1e-9)) * p, np.flatnonzero(first)) if len(p) else np.zeros(0)


def _curve(parts: list, weights: np.ndarray, moves: np.ndarray, rate: float) -> tuple[float, float]:
    """Logistic curve over the log of the evidence, moved to the labels' own rate."""
    if not parts:
        return 4.0, 1.0
    mass, y = [], []
    for ids, mine, first in parts:
        mass.append(_per_doc(marginals(weights[ids].sum(axis=1), first, moves)[0], first))
        y.append(mine[first])
    z, y = np.log(np.concatenate(mass) + 1e-3), np.concatenate(y).astype(float)
    if y.min() == y.max():
        return 4.0, 1.0
    b = np.zeros(2)
    x = np.stack([np.ones(len(z)), z], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        b = b + np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
    share = y.mean()
    return float(b[0] + np.log(rate / (1 - rate)) - np.log(share / (1 - share))), float(b[1])


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves, (bias, slope) = shared.value
        for batch in batches:
            for s in W.slices(batch.column("text")):
                starts, ends, lexical = tokens(s)
                first = np.append(True, s.doc[1:] != s.doc[:-1]) if len(s.doc) else np.zeros(0, dtype=bool)
                unary = np.zeros(len(s.doc))
                if len(s.doc):
                    ids = lookups(s, lexical)
                    for k in range(TEMPLATES):
                        unary += weights[ids[:, k]]
                p, _, _ = marginals(unary, first, moves)
                mass = np.zeros(s.n)
                mass[s.doc[first]] = _per_doc(p, first)
                score = 1 / (1 + np.exp(-np.clip(bias + slope * np.log(mass + 1e-3), -30, 30)))
                spans: list[list[str]] = [[] for _ in range(s.n)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                    begin = chars[np.concatenate([[0], np.cumsum(s.sizes)])[s.doc[hit]]]
                    for d, lo, hi in zip(s.doc[hit].tolist(), (chars[starts[hit]] - begin).tolist(), (chars[ends[hit]] - begin).tolist(), strict=True):
                        spans[d].append(f"{lo}:{hi}")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.n), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([",".join(x) for x in spans])],
                    names=["doc_id", "score", "predicted", "spans"],
                )

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, score, predicted, spans (code points, start:end of offending words) per row of ``docs``.

    ``labels`` (id, label) names the rows to learn from. The sample is drawn from it first, so what is joined to the
    texts has at most about ``TOXIC`` + ``CLEAN`` rows and is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    bad, good = counts.get(1.0, 0), counts.get(0.0, 0)
    rate = bad / (bad + good) if bad + good else 0.0
    flat = rows.select("doc_id", F.lit(rate).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"), F.lit("").alias("spans"))
    if not bad or not good:
        return flat
    share = F.when(F.col("label") == 1, TOXIC / bad).otherwise(CLEAN / good)
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    sample = materialise(
        rows.join(picked, "doc_id").select("doc_id", "text", "label").mapInArrow(_sample, "doc_id long, text string, label double, seq long").dropDuplicates(["seq", "label"]), "toxic"
    )
    bad, good = (sample.filter(F.col("label") == k).count() for k in (1, 0))
    if not bad or not good:
        return flat
    odds = F.log((F.col("toxic") + 0.1) / (bad + 0.2)) - F.log((F.col("clean") + 0.1) / (good + 0.2))
    lexicon = (
        sample.mapInArrow(_associations, "value long, toxic long, clean long").groupBy("value").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= F.lit(max(SUPPORT, bad // 200))) & (odds >= float(np.log(RATIO)))).select("value")
    )
    values = np.sort(np.array([r.value for r in lexicon.collect()], dtype=np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast((values, rate))
    model = sample.orderBy(F.xxhash64("seq")).coalesce(1).mapInArrow(_fit(held), "weights binary, moves binary, curve binary").first()
    arrays = np.frombuffer(model.weights, np.float32).astype(np.float64), np.frombuffer(model.moves), tuple(np.frombuffer(model.curve))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(arrays), threshold), "doc_id long, score double, predicted int, spans string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels.filter(remainder("doc_id", 4) != 2))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
