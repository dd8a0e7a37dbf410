"""Reading, materialising and component search shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a worker's batch of whole texts. Spark's 10,000 texts are held several times over, in the executor and in the worker.
TEXT_ROWS = 1_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. ``rows``: of a worker's batch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows) if rows else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for workers, in jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``ids`` (column doc_id). Texts are shuffled only where the ids, counted first,
    are too many to be broadcast. All columns stay; rows with a null id stay."""
    gone = materialise(ids.select(F.col("doc_id").cast("long").alias("gone_id")).dropna().distinct(), "gone", TEXT_ROWS)
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col] == F.col("gone_id"), "left_anti").select(*docs.columns)


#: Column of ``with_row_key``.
ROW_KEY = "row_key_of_64_bits"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of the whole row, never null: filters by it decide on rows, whatever ids are null or repeated."""
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return docs.withColumn(ROW_KEY, F.xxhash64(*parts))


#: ``spread_join`` splits keys with more rows than this, ``HOT_KEYS`` of them at most and into ``HOT_PARTS`` parts at most.
HOT_ROWS, HOT_KEYS, HOT_PARTS = 500, 10_000, 4_096


def spread_join(rows: DataFrame, once: DataFrame, keys: list[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``once`` (one row per key) on ``keys``, with the rows of hot keys dealt to several tasks.

    ``sizes`` has ``keys`` and ``rows_of_key``. The ``HOT_KEYS`` largest keys over ``HOT_ROWS`` rows are broadcast (a list of
    that length at most, whatever the input); their row of ``once`` is repeated per part. Any other key has at most
    one row in ``HOT_KEYS`` of the input. Null keys match nothing.
    """
    largest = sizes.dropna(subset=keys).orderBy(F.desc("rows_of_key"), *keys).limit(HOT_KEYS).filter(F.col("rows_of_key") > HOT_ROWS)
    hot = materialise(largest.select(*keys, F.least(F.ceil(F.col("rows_of_key") / HOT_ROWS), F.lit(HOT_PARTS)).alias("parts_of_key")), "hot")
    parts = F.coalesce("parts_of_key", F.lit(1))
    # the part of a row only chooses between equal copies, so a recomputed task may choose otherwise
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("part_of_key", F.pmod(F.monotonically_increasing_id(), parts)).drop("parts_of_key")
    copies = once.join(F.broadcast(hot), keys, "left").withColumn("part_of_key", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("parts_of_key")
    return dealt.join(copies, [*keys, "part_of_key"], how).drop("part_of_key")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest id reachable from each end of ``edges`` (columns a, b): id, component.

    Each round takes the smallest label among neighbours, then follows labels once more (pointer jumping);
    labels shrink until nothing changes. All state stays in written tables.
    """
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name
    )
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("to")
        )
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        done = materialise(
            step.join(jump, "to").select("id", "was", F.least("to", "further").alias("component")), name
        )
        changed = done.filter("was <> component").limit(1).count()
        labels = done.select("id", "component")
        if not changed:
            return labels
