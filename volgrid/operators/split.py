"""Deterministic train / validation / eval split of a label table.

Every row's split follows from its own key and the seed, so the split is a projection: no
shuffle, no sampling state, and the same answer whatever the partitioning or a task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..schemas import BUCKET_KEY, EVAL_FRACTION, SPLIT_SEED, VALIDATION_FRACTION

SPLITS = ["train", "validation", "eval"]


def split_thresholds(eval_fraction: float, validation_fraction: float) -> tuple[float, float]:
    """Upper bounds of train and of validation on the unit interval; eval is the rest."""
    train = 1 - eval_fraction - validation_fraction
    return train, train + validation_fraction


def split_name(
    unit: Column,
    eval_fraction: float = EVAL_FRACTION,
    validation_fraction: float = VALIDATION_FRACTION,
) -> Column:
    train_below, validation_below = split_thresholds(eval_fraction, validation_fraction)
    return (
        F.when(unit < train_below, "train")
        .when(unit < validation_below, "validation")
        .otherwise("eval")
    )


def assign_split(
    labels: DataFrame,
    keys: list[str] = BUCKET_KEY,
    eval_fraction: float = EVAL_FRACTION,
    validation_fraction: float = VALIDATION_FRACTION,
    seed: int = SPLIT_SEED,
    method: str = "md5",
) -> DataFrame:
    """Add ``split``."""
    unit = hash_unit(keys, seed, method)
    # The hash is projected once and read twice; only the split name leaves the operator.
    return (
        labels.withColumn("_unit", unit)
        .withColumn("split", split_name(F.col("_unit"), eval_fraction, validation_fraction))
        .drop("_unit")
    )


def derive_paths(labels: DataFrame, book_root: str, trade_root: str) -> DataFrame:
    """Add the storage folder of each label's instrument, per source."""
    stock = F.col("stock_id").cast("string")
    return labels.withColumns(
        {
            "book_path": F.concat(F.lit(f"{book_root.rstrip('/')}/stock_id="), stock),
            "trade_path": F.concat(F.lit(f"{trade_root.rstrip('/')}/stock_id="), stock),
        }
    )


def route_split(index: DataFrame, split: str) -> DataFrame:
    """Rows of one split, without the helper column."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    return index.where(F.col("split") == split).drop("split")


def split_balance(index: DataFrame) -> DataFrame:
    """Rows per instrument and split. Counts are combined before the shuffle."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return index.groupBy("stock_id").agg(*counts)
