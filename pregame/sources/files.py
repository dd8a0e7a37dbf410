"""Scans and sinks: season files, per-game files, text logs, JSON manifests, Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T




def scan_seasons(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All season files as one table with their file name; the schema is declared, never inferred.

    A row that does not fit the schema fails the read, and so does a file whose header is not the declared one.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def scan_game_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Many small per-game files kept lossless: every column text, blank stays blank.

    A row with a cell more or less, or another header, fails the read.
    Spark packs small files into one task by ``spark.sql.files.openCostInBytes``; compact the result
    with :func:`write_table` once.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    # The reader gives NULL for a blank cell; in these files a blank is a value.
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], "file")


def with_season_from_path(df: DataFrame, file: str = "file") -> DataFrame:
    """Season start year from the file path (``.../season=2019/...`` or ``games_2019-20.csv``)."""
    year = F.regexp_extract(F.col(file), r"(?:season=|_)(\d{4})(?:-\d{2})?", 1).try_cast("int")
    return df.withColumn("file_season", year)


def scan_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Projection scan: only ``cols`` are read from the Parquet files."""
    return spark.read.parquet(path).select(*cols)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and a position that orders lines within a file.

    A big file is read in several splits; the split's offset comes first, the reading order within it second.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    pos = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), pos.alias("pos"))


def scan_failure_log(spark: SparkSession, path: str) -> DataFrame:
    """``id <tab> reason`` lines to distinct ids; a malformed line fails the scan."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split("value", "\t")
    bad = (F.size(parts) != 2) | F.get(parts, F.lit(0)).try_cast("bigint").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))).otherwise(
        F.trim(F.get(parts, F.lit(0)))
    )
    return lines.select(checked.alias("game_id"), F.get(parts, F.lit(1)).alias("reason")).groupBy("game_id").agg(
        F.min("reason").alias("reason")
    )


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A small JSON document (declared columns, windows, parameters); refused above a few megabytes."""
    rows = spark.read.option("wholetext", True).text(path).select(
        "value", F.col("_metadata.file_size").alias("size")
    )
    big = rows.filter(F.col("size") > 4_000_000).limit(1).count()
    if big:
        raise ValueError("a manifest is a small document")
    docs = rows.limit(2).collect()
    if len(docs) != 1:
        raise ValueError(f"expected one manifest, found {len(docs)}")
    return json.loads(docs[0]["value"])


def scan_manifests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Many JSON documents as rows."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet table; the commit protocol publishes it whole or not at all.

    With partition columns rows are first clustered by them, so a task writes few files; AQE splits an
    outsized partition value over several tasks.
    """
    out = df
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if sort_by:
        out = out.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("emptyValue", "")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
