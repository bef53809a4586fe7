"""Readers and writers of the market, index, sample and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BOOK, FEATURES, LABELS, MANIFEST, SAMPLE, SHARD_SIZE, TRADE


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label table from CSV files with a header; columns are matched by name."""
    header = spark.read.option("header", True).csv(path)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LABELS.fields]
    return header.select(*typed)


def read_book(spark: SparkSession, root: str) -> DataFrame:
    """Book snapshots in folders ``stock_id=...``; only needed columns are read."""
    return spark.read.schema(BOOK).parquet(root)


def read_trade(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TRADE).parquet(root)


def bucket_lookup(table: DataFrame, stock_id: int, time_id: int) -> DataFrame:
    """Rows of one bucket: prunes to the instrument's folder and pushes the time down."""
    return table.where((F.col("stock_id") == stock_id) & (F.col("time_id") == time_id))


def write_by_stock(table: DataFrame, root: str) -> None:
    """Hive layout, one folder per instrument, rows in order of bucket and second.

    Ranges of buckets go to a task each: an instrument with most of the rows is written by many
    tasks, and a task writes few folders. The order lets a bucket lookup skip row groups.
    """
    key = ["stock_id", "time_id"]
    placed = table.repartitionByRange(*key).sortWithinPartitions(*key, "seconds_in_bucket")
    placed.write.partitionBy("stock_id").parquet(root)


def write_index(index: DataFrame, path: str) -> None:
    index.write.partitionBy("split").parquet(path)


def read_index(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Index table, or the folder of one split."""
    index = spark.read.schema(
        T.StructType([*LABELS.fields, T.StructField("split", T.StringType())])
    ).parquet(path)
    return index if split is None else index.where(F.col("split") == split)


def write_samples(samples: DataFrame, path: str) -> None:
    """Sample table, one folder per split; a file holds one or more whole shards, in order.

    The number of folders does not depend on the number of shards, and a shard is found by the
    statistics of ``shard_id`` in the files.
    """
    placed = samples.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "pos")
    placed.write.partitionBy("split").parquet(path)


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    samples = spark.read.schema(SAMPLE).parquet(path)
    return samples if split is None else samples.where(F.col("split") == split)


def manifest(
    shards: DataFrame,
    stats: DataFrame,
    columns: list[str] = FEATURES,
    shard_size: int = SHARD_SIZE,
    is_train: bool = True,
) -> DataFrame:
    """One row: feature names, shard count and size, train statistics.

    ``shards`` has one row per shard.
    """
    seen = F.col("count_seconds") if is_train else F.lit(0).cast("long")
    norm = F.struct("mean", "std", seen.alias("count_seconds"), "source")
    return stats.select(
        F.array(*map(F.lit, columns)).alias("feature_cols"),
        shards.agg(F.count(F.lit(1))).scalar().alias("num_shards"),
        F.lit(shard_size).cast("long").alias("shard_size"),
        norm.alias("norm"),
    )


def write_json(report: DataFrame, path: str) -> None:
    """Manifest or report (few rows) as JSON lines."""
    report.write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_stats(manifest_row: DataFrame) -> DataFrame:
    """Statistics of a manifest in the form ``apply_norm`` takes."""
    return manifest_row.select("norm.*")
