"""Data checks: non-finite values, duplicate slots and sample shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BUCKET_SECONDS, SLOT_KEY


def nonfinite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nulls, NaNs, infinities and values in total."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(v.isNull()).alias("nulls"),
                F.count_if(F.isnan(v)).alias("nans"),
                F.count_if(F.abs(v) == float("inf")).alias("infinities"),
                F.count(F.lit(1)).alias("total"),
            )
        )
    return df.agg(F.array(*parts).alias("_parts")).select(F.inline("_parts"))


def require_finite(df: DataFrame, columns: list[str], allow_nulls: bool = False) -> DataFrame:
    """The rows as they are; the job fails on the first value that is not finite."""
    checked = {}
    for c in columns:
        v = F.col(c).cast("double")
        bad = F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
        if not allow_nulls:
            bad = bad | v.isNull()
        message = F.concat(F.lit(f"non-finite value in {c}: "), F.coalesce(v.cast("string"), F.lit("null")))
        checked[c] = F.when(bad, F.raise_error(message)).otherwise(F.col(c))
    return df.withColumns(checked)


def duplicate_keys(df: DataFrame, keys: list[str] = SLOT_KEY) -> DataFrame:
    """Keys that occur more than once, with their count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1)


def has_shape(x: Column | str, features: int, seconds: int = BUCKET_SECONDS) -> Column:
    """True if a sample has ``seconds`` rows of ``features`` values; false if it is null."""
    x = F.col(x) if isinstance(x, str) else x
    rows = F.size(x) == seconds
    widths = F.forall(x, lambda row: F.coalesce(F.size(row) == features, F.lit(False)))
    return F.coalesce(rows & widths, F.lit(False))


def shape_report(samples: DataFrame, features: int, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row: samples seen and samples of the wrong shape."""
    good = has_shape("x", features, seconds)
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~good).alias("bad_samples")
    )
