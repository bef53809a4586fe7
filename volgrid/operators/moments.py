"""Moments of columns as rows that can be merged: number, mean and summed squared deviation.

Rows of ``feature, rows, n, mean, m2`` describe any part of the data; ``rows`` counts all rows of the
part and ``n`` those with a value. Two parts merge without loss of digits, because deviations are
taken from a mean and never from 0, so statistics can be kept per shard and updated by new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..schemas import FEATURES, VARIANCE_FLOOR

MOMENTS = "feature string, rows long, n long, mean double, m2 double"
_VALUES = ["rows", "n", "mean", "m2"]


def column_moments(df: DataFrame, columns: list[str] = FEATURES, by: list[str] = []) -> DataFrame:
    """One row per feature, and per group of ``by``. Missing and NaN values have no part in it."""
    structs = []
    for c in columns:
        value = nan_to_null(F.col(c).cast("double"))
        n = F.count(value)
        structs.append(
            F.struct(
                F.lit(c).alias("feature"), F.count(F.lit(1)).alias("rows"), n.alias("n"),
                F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
                F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias("m2"),
            )
        )
    return df.groupBy(*by).agg(F.array(*structs).alias("_moments")).select(*by, F.inline("_moments"))


def merge_moments(parts: DataFrame, by: list[str] = []) -> DataFrame:
    """The moments of all parts of a feature together, per group of ``by`` (keys without nulls).

    First the common mean, then the deviations about it: both are sums over the parts.
    """
    key = [*by, "feature"]
    whole = parts.groupBy(*key).agg(
        F.sum("rows").alias("_rows"), F.sum("n").alias("_n"),
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")), F.lit(0.0)).alias("_mean"),
    )
    off = F.col("mean") - F.col("_mean")
    joined = parts.join(whole, key)
    return joined.groupBy(*key).agg(
        F.first("_rows").alias("rows"), F.first("_n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
    )


def norm_of(moments: DataFrame, columns: list[str] = FEATURES, source: str = "train") -> DataFrame:
    """One row of statistics in the form of ``stats.fit_norm``, from one row per feature.

    A feature without any value, or without a row here, gets mean 0 and standard deviation 1.
    """
    known = F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*_VALUES).alias("v"))))
    one = moments.where(F.col("feature").isin(columns)).agg(known.alias("_v"))
    # A missing entry and one without values are alike.
    each = [F.when(F.col("_v")[c]["n"] > 0, F.col("_v")[c]) for c in columns]
    return one.select(
        F.array(*[F.coalesce(v["mean"], F.lit(0.0)) for v in each]).alias("mean"),
        F.array(
            *[F.when(v.isNotNull(), F.sqrt(F.greatest(v["m2"] / v["n"], F.lit(VARIANCE_FLOOR)))).otherwise(F.lit(1.0)) for v in each]
        ).alias("std"),
        F.coalesce(F.array_max(F.transform(F.map_values("_v"), lambda v: v["rows"])), F.lit(0)).alias("count_seconds"),
        F.lit(source).alias("source"),
    )
