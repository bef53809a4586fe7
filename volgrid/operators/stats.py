"""Normalization statistics: fitted on the train split, applied to any split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null, sanitize
from ..schemas import FEATURES, STD_EPS, VARIANCE_FLOOR


def _observed(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def norm_moments(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """One row per column: sum, sum of squares and number of observed values.

    A single aggregation over all columns, combined before its one-row shuffle.
    """
    values = [_observed(c) for c in columns]
    one = df.agg(
        _array([F.coalesce(F.sum(v), F.lit(0.0)) for v in values]).alias("total"),
        _array([F.coalesce(F.sum(v * v), F.lit(0.0)) for v in values]).alias("total_sq"),
        _array([F.count(v) for v in values]).alias("observed"),
    )
    zipped = F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), "total", "total_sq", "observed")
    return one.select(F.inline(zipped))


def fit_norm(df: DataFrame, columns: list[str] = FEATURES, source: str = "train") -> DataFrame:
    """One row: ``mean`` and population ``std`` arrays in column order, rows seen, source.

    Missing and NaN values do not count; a column without any value gets mean 0, std 1.
    """
    values = [_observed(c) for c in columns]
    means = [F.coalesce(F.avg(v), F.lit(0.0)) for v in values]
    # ``greatest`` skips nulls, so a column without values needs a test of its own.
    stds = [
        F.when(F.count(v) > 0, F.sqrt(F.greatest(F.var_pop(v), F.lit(VARIANCE_FLOOR)))).otherwise(F.lit(1.0))
        for v in values
    ]
    return df.agg(
        _array(means).alias("mean"),
        _array(stds).alias("std"),
        F.count(F.lit(1)).alias("count_seconds"),
    ).withColumn("source", F.lit(source))


def apply_norm(df: DataFrame, stats: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Replace each column by ``(x - mean) / (std + 1e-12)``; ``stats`` has exactly one row.

    The row enters as a scalar subquery: computed once, then a constant of the projection.
    """
    one = stats.select(F.struct("mean", "std")).scalar()
    scaled = {
        c: (F.col(c) - F.col("_stats.mean")[i]) / (F.col("_stats.std")[i] + F.lit(STD_EPS))
        for i, c in enumerate(columns)
    }
    return df.withColumn("_stats", one).withColumns(scaled).drop("_stats")


def sanitize_columns(
    df: DataFrame, columns: list[str] = FEATURES, normalized: bool = True
) -> DataFrame:
    return df.withColumns({c: sanitize(c, normalized) for c in columns})
