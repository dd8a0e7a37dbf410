"""Embedding whitening from a covariance weighted by multiplicity.

Entries c become whole numbers x = floor(256 * c). Rows with the same x vector are grouped; the groups are the fit list, each
weighted by its number of rows or by one. Two passes over the groups give exact sums per dimension and the centred,
weighted products, summed by Spark from one partial matrix per task. Its unit eigenvectors, numbered by falling
eigenvalue, whiten each distinct vector once, and rows get their values by a join on the x vector; a vector that many
rows share is dealt to several tasks.

A row whose vector is null, empty or holds null or non-finite entries is dropped. Entries beyond 64 bits count as the
largest or smallest long. Vectors of each length are a fit list of their own. Rows with null or repeated ids, and
repeated rows, stay as they are. Directions without variance (fewer distinct vectors than components, equal vectors)
have no component, so one distinct vector, or none, gives no rows. Equal eigenvalues share their plane: any unit base of it
may be returned. ``deviation`` is exact to 38 digits, beyond them null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm.common import materialise, spread_join, table

SCALE = 256
#: Eigenvalues below this share of the largest count as no variance.
FLAT = 1e-10
_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64))
_DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Model:
    """Fit of the vectors of one length: rows, exact sums, mean, components (one per row) and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float


def _whole(c: np.ndarray) -> np.ndarray:
    """floor(256 * c) as long; beyond 64 bits the nearest long."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(c * SCALE)
        x = y.astype(np.int64)
    x[y >= 2.0**63] = np.iinfo(np.int64).max
    x[y < -(2.0**63)] = np.iinfo(np.int64).min
    return x


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, equal for equal rows only: the narrowest width that holds the row, then its entries."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), dtype=bool)
    for width, kind in _WIDTHS:
        bounds = np.iinfo(kind)
        mine = np.flatnonzero(left & (low >= bounds.min) & (high <= bounds.max))
        left[mine] = False
        raw, size = x[mine].astype(kind).tobytes(), width * x.shape[1]
        for k, row in enumerate(mine):
            out[row] = bytes((width,)) + raw[k * size : (k + 1) * size]
    return out


def _unpacked(keys: list[bytes]) -> np.ndarray:
    """The rows of ``_packed``; all keys are of one length of vector."""
    d = (len(keys[0]) - 1) // keys[0][0]
    out = np.empty((len(keys), d), dtype=np.int64)
    at = np.array([k[0] for k in keys])
    for width, kind in _WIDTHS:
        mine = np.flatnonzero(at == width)
        if len(mine):
            out[mine] = np.frombuffer(b"".join(keys[k][1:] for k in mine), kind).reshape(len(mine), d)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vec")
        flat = column.flatten()
        entries = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null entry becomes not a number
        sizes = column.value_lengths().fill_null(0).to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
        good = (sizes > 0) & (bad[first[1:]] == bad[first[:-1]])
        for d in np.unique(sizes[good]):
            rows = np.flatnonzero(good & (sizes == d))
            x = _whole(entries[first[rows][:, None] + np.arange(d)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array(_packed(x), pa.binary())], names=["id", "dims", "x"]
            )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Length, rows, x vectors and weights, one length at a time."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            mine = batch.filter(pa.array(dims == d))
            yield int(d), mine, _unpacked(mine.column("x").to_pylist()), mine.column("weight").to_numpy()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums per length and dimension of one task."""
    totals: dict[int, list] = {}
    for d, _, x, w in _blocks(batches):
        most = max(abs(int(x.min())), abs(int(x.max())), 1) * int(w.max()) * len(x)
        part = (x * w[:, None]).sum(axis=0).astype(object) if most < 1 << 62 else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
        held = totals.setdefault(d, [0, np.zeros(d, dtype=object)])
        held[0] += int(w.sum())
        held[1] = held[1] + part
    for d, (n, total) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], _DECIMAL), pa.array(np.full(d, n, np.int64))],
            names=["dims", "place", "total", "n"],
        )


def _products(means: dict[int, np.ndarray]):
    """Upper triangles of the centred, weighted products of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for d, _, x, w in _blocks(batches):
            centred = x - means[d]
            totals[d] = totals.get(d, 0.0) + centred.T @ (centred * w[:, None])
        for d, m in totals.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array((i * d + j).astype(np.int64)), pa.array(m[i, j])], names=["dims", "cell", "value"])

    return run


def _fit(distinct: DataFrame, components: int) -> dict[int, Model]:
    """A model per vector length. The driver gets one matrix of dimension squared per length, whatever the number of rows."""
    sums = distinct.mapInArrow(_sums, "dims int, place int, total decimal(38,0), n long")
    found: dict[int, list] = {}
    for r in sums.groupBy("dims", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dims", "place").collect():
        found.setdefault(r.dims, []).append((int(r.total), r.n))
    means = {d: np.array([float(Fraction(t, n)) for t, n in rows]) for d, rows in found.items()}
    cells = distinct.mapInArrow(_products(means), "dims int, cell long, value double").groupBy("dims", "cell").agg(F.sum("value").alias("value")).toArrow()
    models = {}
    for d, rows in found.items():
        n = rows[0][1]
        mine = cells.filter(pc.equal(cells.column("dims"), d))
        v = np.zeros(d * d)
        v[mine.column("cell").to_numpy()] = mine.column("value").to_numpy() / n
        v = v.reshape(d, d)
        v = v + np.triu(v, 1).T
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > FLAT * max(values.max(), 0.0)]
        models[d] = Model(n, tuple(t for t, _ in rows), means[d], axes[:, order].T.copy(), values[order], float(np.trace(v)))
    return models


def _deviations(x: np.ndarray, m: Model) -> pa.Array:
    """Sum over the dimensions of (n * x - S) squared, in whole numbers of any size."""
    most = m.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, m.sums))
    if most * most * x.shape[1] < 1 << 63:
        away = m.n * x - np.array(m.sums, dtype=np.int64)
        return pa.array((away * away).sum(axis=1)).cast(_DECIMAL)
    away = m.n * x.astype(object) - np.array(m.sums, dtype=object)
    return pa.array([Decimal(int(t)) if t < 10**38 else None for t in (away * away).sum(axis=1)], _DECIMAL)


def _whiten(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows, x, _ in _blocks(batches):
            m = models[d]
            values = ((x - m.mean) @ m.axes.T) / np.sqrt(m.values)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(m.values)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("dims"), rows.column("x"), rows.column("weight"), lists, _deviations(x, m)], names=["dims", "x", "weight", "whitened", "deviation"])

    return run


def _identity_errors(white: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the whitened vectors' own covariance less the identity, per length, from a pass over all of them."""
    most = max((len(m.values) for m in models.values()), default=0)
    w, cell = F.col("weight"), lambda k: F.get("whitened", F.lit(k))
    if not most:
        return {}
    means = {r.dims: [r[f"m{k}"] for k in range(most)] for r in white.groupBy("dims").agg(*[(F.sum(cell(k) * w) / F.sum(w)).alias(f"m{k}") for k in range(most)]).collect()}
    out = {}
    for d, mean in means.items():
        k = len(models[d].values)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        if pairs:
            row = white.filter(F.col("dims") == d).agg(*[F.sum((cell(i) - mean[i]) * (cell(j) - mean[j]) * w) / F.sum(w) for i, j in pairs]).first()
            out[d] = max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))
    return out


def whiten_embeddings(vectors: DataFrame, components: int = 4, by_rows: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, dims, n, deviation (decimal), whitened, explained (lists, first component first) and identity_error of each remaining row.

    ``by_rows`` weights a distinct vector by its number of rows, else by one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).dropna(subset=["vec"])
    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(_keys, f"id {kind}, dims int, x binary")
    groups = materialise(coded.groupBy("dims", "x").agg(F.count("*").alias("rows_of_key")), "vectors")
    distinct = groups.select("dims", "x", (F.col("rows_of_key") if by_rows else F.lit(1).cast("long")).alias("weight"))
    models = _fit(distinct, components)
    white = distinct.mapInArrow(_whiten(models), "dims int, x binary, weight long, whitened array<double>, deviation decimal(38,0)")
    errors = _identity_errors(white, models)
    facts = [(d, m.n, [float(v) / m.trace for v in m.values], errors.get(d)) for d, m in models.items()]
    facts = spark.createDataFrame(facts, "dims int, n long, explained array<double>, identity_error double")
    joined = spread_join(coded.select("id", "x"), white.select("dims", "x", "whitened", "deviation"), ["x"], groups.select("x", "rows_of_key"))
    # one row per length of vector
    return joined.join(F.broadcast(facts), "dims").select("id", "dims", "n", "deviation", "whitened", "explained", "identity_error")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of every row, each distinct vector weighted by one."""
    found = whiten_embeddings(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").cast("long").alias("vec_id"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "explained", "identity_error",
        F.posexplode("whitened").alias("place", "whitened"),
    ).select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error")
