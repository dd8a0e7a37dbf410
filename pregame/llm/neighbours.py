"""Approximate nearest neighbours by cosine: an NN-descent graph over all rows, searched greedily.

Rows with the same vector are one node, so a vector that many rows share is no group of its own. The graph begins
with the best pairs inside the leaves of a few random hyperplane trees; then every round joins each node's neighbours
(forward and a bounded share of reverse ones) with each other, and a node keeps the best ``K`` it has seen. Rounds end
when fewer than ``SETTLED`` of the edges change. A query starts at its own node (or at ``ENTRIES`` fixed nodes), and
each round widens the best nodes it has not widened yet, until its best ``BEAM`` are all widened. Scores are exact: double
precision on the original vectors; graph and beam run on unit vectors in single precision, whose error of about 1e-7 is far
below the spread of any but equal vectors, and equal ones are one node.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the commonest. Rows with a null id take no part; of rows repeating an id with the same vector one counts. Ties go to
the smaller id. A query with fewer candidates gets all; an empty table gives no rows. The graph is approximate: recall is
measured in tests and stated in the README.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.llm.common import materialise, table

K = 28
TREES, LEAF = 4, 150
SETTLED = 0.005
BEAM, WIDTH, ENTRIES = 96, 16, 64
SEED = 11


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(unit: np.ndarray) -> pa.Array:
    """Unit vectors in single precision, for graph and beam."""
    return pa.array([r.tobytes() for r in unit.astype(np.float32)], pa.binary())


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of ``_packed``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _leaves(planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("vec"), np.float64)
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            packed = _packed(unit)
            for tree in range(TREES):
                normals = np.random.default_rng([SEED, tree]).normal(size=(x.shape[1], planes))
                code = ((unit @ normals > 0) @ (1 << np.arange(planes))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), packed, pa.array(np.full(len(x), tree, dtype=np.int32)), pa.array(code)], names=["node", "unit", "tree", "code"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *change], [*change, len(batch)], strict=True):
            key = tuple(c[a] for c in cols)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _best(node: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, top, axis=1)
    row = np.repeat(np.arange(len(node)), k)
    good = np.isfinite(value).ravel()
    return node[row[good]], node[top.ravel()[good]], value.ravel()[good]


_EDGES = "src long, dst long, sim float"


def _emit(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s.astype(np.float32))], names=["src", "dst", "sim"])


def _in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, size = [], 0
    for leaf in _groups(batches, ["tree", "code", "part"]):
        x, node = _units(leaf.column("unit")), leaf.column("node").to_numpy()
        if len(node) < 2:
            continue
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        found.append(_best(node, sims, K))
        size += len(found[-1][0])
        if size > 50_000:
            yield _emit(found)
            found, size = [], 0
    if found:
        yield _emit(found)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node with each other: pairs with a new end that beat the worst kept edge of their start."""
    found, size = [], 0
    for group in _groups(batches, ["hub"]):
        node, at = np.unique(group.column("node").to_numpy(), return_index=True)
        if len(node) < 2:
            continue
        x = _units(group.column("unit"))[at]
        new = group.column("new").to_numpy()[at]
        worst = group.column("worst").to_numpy()[at]
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        sims[~(new[:, None] | new[None, :])] = -np.inf
        sims[sims <= worst[:, None]] = -np.inf
        found.append(_best(node, sims, K))
        size += len(found[-1][0])
        if size > 50_000:
            yield _emit(found)
            found, size = [], 0
    if found:
        yield _emit(found)


def _kept(edges: DataFrame) -> DataFrame:
    """The best ``K`` edges of each node; an edge that is offered twice counts once, as an old one if it was kept."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= K).drop("rank")


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", members: int = 6) -> tuple[DataFrame, DataFrame]:
    """``nodes``: node, vec. ``rows``: node, member, for the ``members`` smallest ids of each node."""
    v = F.col("vec")
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).dropna()
        .filter(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    )
    length = clean.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    clean = clean.filter(F.size("vec") == (length.n if length else 0)).distinct()
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = clean.withColumn("place", rank).filter(F.col("place") <= members)
    rows = materialise(firsts.withColumn("node", F.min("id").over(Window.partitionBy("vec"))), "nodes")
    return rows.filter("place = 1").select("node", "vec"), rows.select("node", F.col("id").alias("member"))


def neighbour_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges src, dst, sim of every node's ``K`` best, and node, unit (single precision)."""
    count = nodes.count()
    planes = int(np.clip(np.ceil(np.log2(max(count, 1) / LEAF)), 0, 40))
    coded = materialise(nodes.mapInArrow(_leaves(planes), "node long, unit binary, tree int, code long"), "leaves")
    units = coded.filter("tree = 0").select("node", "unit")
    sizes = coded.groupBy("tree", "code").count()
    parted = coded.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / (2 * LEAF))))
    first = parted.drop("count").repartition("tree", "code", "part").sortWithinPartitions("tree", "code", "part").mapInArrow(_in_leaves, _EDGES)
    graph = materialise(_kept(first.withColumn("new", F.lit(True))), "graph")
    for step in itertools.count():  # each round replaces edges by better ones, so it ends
        back = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("new"), F.xxhash64("src", F.lit(step))))
        reverse = graph.withColumn("rank", back).filter(F.col("rank") <= K)
        near = graph.select(F.col("src").alias("hub"), F.col("dst").alias("node"), "new").unionByName(reverse.select(F.col("dst").alias("hub"), F.col("src").alias("node"), "new"))
        near = near.groupBy("hub", "node").agg(F.max("new").alias("new"))
        busy = near.filter("new").select("hub").distinct()
        worst = graph.groupBy(F.col("src").alias("node")).agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        carried = units.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
        offered = (
            near.join(busy, "hub", "left_semi").join(carried, "node").repartition("hub").sortWithinPartitions("hub")
            .select("hub", "node", "new", "unit", "worst").mapInArrow(_joined, _EDGES)
        )
        graph = materialise(_kept(graph.withColumn("new", F.lit(False)).unionByName(offered.withColumn("new", F.lit(True)))), "graph")
        if graph.filter("new").count() <= SETTLED * K * count:
            break
    return graph.select("src", "dst", "sim"), units


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sim = (_units(batch.column("query_unit")) * _units(batch.column("unit"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(sim.astype(np.float32))], names=["query_id", "node", "score"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_matrix(batch.column(c), np.float64) for c in ("query_vec", "vec"))
        sim = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(sim, pa.float64())], names=["query_id", "node", "score"])


def _query_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("query_vec"), np.float64)
        if len(batch):
            unit = _packed(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("start"), unit], names=["query_id", "start", "query_unit"])


def search(nodes: DataFrame, units: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries``: query_id, query_vec, start (a node or null). Returns query_id, node, score of each query's beam.

    The beam runs in single precision until all its nodes are widened; its last state is scored in double precision.
    """
    # all of a node's own edges, and up to K of those that point to it
    back = F.row_number().over(Window.partitionBy("dst").orderBy(F.xxhash64("dst", "src")))
    reverse = graph.select("src", "dst").withColumn("rank", back).filter(F.col("rank") <= K).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = materialise(graph.select("src", "dst").unionByName(reverse).distinct(), "links")
    entries = [r.node for r in nodes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]
    asked = materialise(queries.mapInArrow(_query_units, "query_id long, start long, query_unit binary"), "asked")

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(units, "node").join(asked.select("query_id", "query_unit"), "query_id")
        return full.select("query_id", "node", "query_unit", "unit").mapInArrow(_near, "query_id long, node long, score float")

    begin = asked.select("query_id", F.explode(F.when(F.col("start").isNotNull(), F.array("start")).otherwise(F.array(*map(F.lit, entries)).cast("array<bigint>"))).alias("node"))
    pool = materialise(scored(begin).withColumn("open", F.lit(True)), "beam")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    turn = F.sum(F.col("open").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    while True:  # a node is widened once per query at most, so it ends
        marked = pool.withColumn("turn", turn).withColumn("widen", F.col("open") & (F.col("turn") <= WIDTH))
        fresh = (
            marked.filter("widen").join(links, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
            .join(pool.select("query_id", "node"), ["query_id", "node"], "left_anti")
        )
        grown = marked.select("query_id", "node", "score", (F.col("open") & ~F.col("widen")).alias("open")).unionByName(scored(fresh).withColumn("open", F.lit(True)))
        pool = materialise(grown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEAM).drop("rank"), "beam")
        if not pool.filter("open").limit(1).count():
            break
    last = pool.select("query_id", "node").join(nodes, "node").join(queries.select("query_id", "query_vec"), "query_id")
    return last.select("query_id", "node", "query_vec", "vec").mapInArrow(_exact, "query_id long, node long, score double")


def nearest_neighbours(vectors: DataFrame, is_query, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id satisfies ``is_query`` (id -> Column)."""
    nodes, rows = nodes_of(vectors, id_col, vector_col, top + 1)
    graph, units = neighbour_graph(nodes)
    every = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("query_vec")).filter(is_query(F.col("query_id")))
    # nodes hold only vectors that take part, so the join also drops queries that do not
    queries = materialise(every.join(nodes.select(F.col("vec").alias("query_vec"), F.col("node").alias("start")), "query_vec").distinct(), "queries")
    found = search(nodes, units, graph, queries)
    near = found.join(rows, "node").filter(F.col("member") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", F.col("member").alias("vec_id"), "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
