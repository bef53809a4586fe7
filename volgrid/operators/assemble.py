"""Training samples: one 600 x F matrix per bucket with its log label and shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_label
from ..schemas import BUCKET_KEY, BUCKET_SECONDS, FEATURES, SECOND, SHARD_SIZE, SLOT_KEY
from .features import bucket_features
from .ordering import assign_shards
from .split import SPLITS, assign_split


def attach_labels(
    labels: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    keep_trade_only: bool = True,
    unique_slots: bool = False,
) -> DataFrame:
    """Feature rows of every labelled bucket with its ``target``.

    The label table drives: a bucket absent from book and trade still gives 600 rows. Labels
    travel with the bucket's anchor row, so this adds no join.
    """
    return bucket_features(labels, book, trade, keep_trade_only, ("target",), unique_slots)


def bucket_tensor(
    features: DataFrame, columns: list[str] = FEATURES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per bucket: ``x`` as float matrix, rows in order of the second.

    Features are already placed by bucket, so the rows are collected where they are; a bucket
    has exactly 600. Missing values stay null in the matrix.
    """
    row = F.struct(
        F.col(SECOND).alias("second"),
        F.array(*[F.col(c).cast("float") for c in columns]).alias("values"),
    )
    rows = F.array_sort(F.collect_list(row))
    keep = [F.max(c).alias(c) for c in carry]
    return (
        features.groupBy(*BUCKET_KEY)
        .agg(rows.alias("_rows"), *keep)
        .select(*BUCKET_KEY, *carry, F.transform("_rows", lambda r: r["values"]).alias("x"))
    )


def tensor_rows(samples: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Matrices back to one row per second."""
    rows = samples.select(*BUCKET_KEY, F.posexplode("x").alias(SECOND, "_values"))
    return rows.select(*SLOT_KEY, *[F.col("_values")[i].alias(c) for i, c in enumerate(columns)])


def build_samples(
    labels: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    columns: list[str] = FEATURES,
    shard_size: int = SHARD_SIZE,
    keep_trade_only: bool = True,
    unique_slots: bool = False,
) -> DataFrame:
    """Samples of all splits in one plan: matrix, log label, split, shard and place in it.

    The narrow label table is split (unless it comes with one) and ranked first, and its columns reach the bucket with
    the anchor row: the wide matrices take part in no join.
    """
    split_code = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    split = labels if "split" in labels.columns else assign_split(labels)
    placed = assign_shards(split, shard_size, group=["split"])
    index = placed.withColumn("split_code", split_code.cast("int"))
    carry = ("target", "split_code", "shard_id", "pos")
    features = bucket_features(index, book, trade, keep_trade_only, carry, unique_slots)
    return bucket_tensor(features, columns, carry).select(
        *BUCKET_KEY,
        "pos",
        "x",
        log_label("target").cast("float").alias("y_log"),
        F.element_at(F.array(*map(F.lit, SPLITS)), F.col("split_code")).alias("split"),
        "shard_id",
    )


def bucket_summary(
    features: DataFrame, columns: list[str] = FEATURES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per bucket: each feature at the last second, and realized volatility ``rv``."""
    last = BUCKET_SECONDS - 1
    at_end = [F.max(F.when(F.col(SECOND) == last, F.col(c))).alias(c) for c in columns]
    rv = F.sqrt(F.sum(F.col("log_return") * F.col("log_return"))).alias("rv")
    keep = [F.max(c).alias(c) for c in carry]
    return features.groupBy(*BUCKET_KEY).agg(*at_end, rv, *keep)


def summarize_samples(samples: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """The same from sample matrices, row by row: ``x`` is replaced by the summary.

    ``columns`` names the columns of the matrices, in order. ``rv`` needs ``log_return`` among them.
    """
    at_end = F.element_at("x", -1)
    kept = [c for c in samples.columns if c != "x"]
    summary = [at_end[i].cast("double").alias(c) for i, c in enumerate(columns)]
    if "log_return" in columns:
        position = columns.index("log_return")
        squares = F.aggregate(
            "x", F.lit(0.0), lambda total, row: total + (row[position] * row[position]).cast("double")
        )
        summary.append(F.sqrt(squares).alias("rv"))
    return samples.select(*kept, *summary)
