"""Session helpers: settings every query relies on, and the shared folder for materialised data."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("pregame")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings that results depend on (all are run-time settable)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


#: Bytes of game tables for each shuffle partition, and what adaptive execution joins partitions up to. A shuffled byte of a
#: thin, compressed table is some 15 bytes in a sort or a hash table.
PARTITION_BYTES = 2 << 20
ADVISORY_BYTES = 8 << 20
SPLIT_BYTES = 32 << 20
_table_bytes: dict[tuple[str, str], int] = {}


def spread(spark: SparkSession, sf_dir: str) -> None:
    """More shuffle partitions for larger tables, so that a task's share does not grow with the input.

    Adaptive execution starts from this many partitions and joins small ones again; ``spark.sql.shuffle.partitions``, which
    fixes the state of streams, stays. Sizes come from the file listing, no file is opened.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _table_bytes:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(sf_dir)
        games = files.filter(F.col("path").rlike(r"/(lineitem|orders|events)\.parquet"))
        _table_bytes[at] = games.agg(F.sum("length")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_table_bytes[at] // PARTITION_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(ADVISORY_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Read from ``spark.checkpoint.dir``; only a local session without that setting gets a new
    temporary folder, because a cluster must never write to a machine-local path.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="pregame-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def set_checkpoints(spark: SparkSession) -> None:
    """Reliable checkpoints go to the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the few iterative operators."""
    set_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
