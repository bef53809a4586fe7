"""Summary of request timings: mean, floor-rank percentiles, throughput.

Rows are combined to (group, value, count) once, with partial aggregation, so a group that
holds most of the rows, or a value that does, moves no more data than any other. Percentiles are
exact order statistics, found by selection instead of sorting: counts per narrow value range
locate the range that holds a rank, and only values of those ranges count in the next pass.
Null is a group of its own; a group without any latency has null percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EPS
from ..session import cut_lineage
from .ordering import null_free

QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
# Ranges per unit of the natural logarithm, and the offset that keeps indexes of tiny values
# positive: ln of the smallest positive double is above -746.
RESOLUTION = 2048
LOG_OFFSET = 746
LARGEST = 1.7e308
SUB_RANGES = 65536


def value_range(value: Column) -> Column:
    """Index of the value's range: never decreases as the value grows.

    Ranges are fixed in advance on a log scale, mirrored for negative values. There are at
    most ``2 * 1456 * RESOLUTION + 1`` of them, whatever the data.
    """
    size = F.least(F.abs(value), F.lit(LARGEST))
    index = F.floor((F.ln(size) + LOG_OFFSET) * RESOLUTION) + 1
    return F.when(value == 0, F.lit(0)).when(value > 0, index).otherwise(-index).cast("long")


def floor_rank(n: Column, p: float) -> Column:
    """1-based rank of the percentile: ``max(1, floor(p * n))``."""
    return F.greatest(F.lit(1), F.floor(F.lit(p) * n))


def _part_index() -> Column:
    """Index of the value between the bounds of its range; never decreases either."""
    span = F.col("_high") - F.col("_low")
    share = (F.col("_value") - F.col("_low")) / F.when(span > 0, span)
    return F.coalesce(F.floor(share * SUB_RANGES), F.lit(0))


def _rank_name(quantile: str) -> str:
    return f"_rank_{quantile}"


def _narrow(counts: DataFrame, parent: list[str], cell: str, names: list[str]) -> DataFrame:
    """Keep the cells that hold a wanted rank of their parent, with the rank inside the cell."""
    earlier = Window.partitionBy(*parent).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    placed = counts.withColumn("_before", before)
    local = {
        r: F.when(
            (F.col(r) > F.col("_before")) & (F.col(r) <= F.col("_before") + F.col("_rows")),
            F.col(r) - F.col("_before"),
        )
        for r in names
    }
    held = F.coalesce(*[F.col(r) for r in names]).isNotNull()
    return placed.withColumns(local).where(held).drop("_before", "_rows")


def combined(timings: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """``by, _value, _rows``: each distinct value of a group once, with its count.

    The rows are read once, when this is called: the table is written to the checkpoint folder.
    """
    counts = timings.groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    return cut_lineage(counts)


def _within(values: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in a hit cell, with the cell's columns. ``keys`` are never null."""
    carried = [c for c in cells.columns if c not in keys]
    return values.join(cells, keys).select(*values.columns, *carried)


def select_percentiles(
    values: DataFrame, by: list[str], quantiles: dict[str, float] = QUANTILES
) -> DataFrame:
    """One row per group of ``combined`` values: the value at each floor rank.

    The columns of ``by`` are never null (see ``ordering.null_free``). Three narrowing steps: fixed ranges, parts of the hit ranges, values of the hit parts. At
    most one range per group and quantile is looked at again.
    """
    ranks = {_rank_name(q): p for q, p in quantiles.items()}
    rows = values.where(F.col("_value").isNotNull()).withColumn("_range", value_range(F.col("_value")))
    total = F.sum("_rows").alias("_rows")
    bounds = [F.min("_value").alias("_low"), F.max("_value").alias("_high")]

    counts = rows.groupBy(*by, "_range").agg(total, *bounds)
    n = F.sum("_rows").over(Window.partitionBy(*by))
    wanted = counts.withColumns({r: floor_rank(n, p) for r, p in ranks.items()})
    in_range = _narrow(wanted, by, "_range", list(ranks))

    range_key = [*by, "_range", "_low", "_high", *ranks]
    parts = _within(rows, in_range, [*by, "_range"]).withColumn("_part", _part_index())
    part_counts = parts.groupBy(*range_key, "_part").agg(total)
    in_part = _narrow(part_counts, range_key[: -len(ranks)], "_part", list(ranks))

    hit = _within(rows, in_part, [*by, "_range"]).where(_part_index() == F.col("_part"))
    found = _narrow(
        hit.groupBy(*range_key, "_part", "_value").agg(total),
        [*range_key[: -len(ranks)], "_part"], "_value", list(ranks),
    )
    picks = [
        F.max(F.when(F.col(_rank_name(q)).isNotNull(), F.col("_value"))).alias(q)
        for q in quantiles
    ]
    return found.groupBy(*by).agg(*picks)


def percentiles(
    timings: DataFrame,
    by: list[str],
    value: str = "latency_ms",
    quantiles: dict[str, float] = QUANTILES,
) -> DataFrame:
    """One row per group that has a latency: the value at each floor rank.

    Calling this reads and combines the rows (see ``combined``).
    """
    keyed, keys, restored = null_free(timings, by)
    picked = select_percentiles(combined(keyed, keys, value), keys, quantiles)
    return picked.select(*restored, *quantiles)


def latency_summary(
    timings: DataFrame,
    batch_size: int,
    by: list[str] | None = None,
    value: str = "latency_ms",
) -> DataFrame:
    """Mean, percentiles, count, busy seconds and samples per busy second, per group.

    Without ``by`` all timings form one group. Calling this reads and combines the rows.
    """
    grouped = timings if by else timings.withColumn("_all", F.lit(0))
    keyed, keys, restored = null_free(grouped, by or ["_all"])
    values = combined(keyed, keys, value)
    busy = F.sum(F.col("_value") * F.col("_rows"))
    count = F.coalesce(F.sum(F.when(F.col("_value").isNotNull(), F.col("_rows"))), F.lit(0))
    totals = values.groupBy(*keys).agg(
        F.try_divide(busy, count).alias("mean_ms"), count.alias("count"), (busy / 1000).alias("total_s")
    )
    picked = select_percentiles(values, keys)
    rate = F.col("count") * batch_size / F.greatest(F.col("total_s"), F.lit(EPS))
    return totals.join(picked, keys, "left").select(
        *(restored if by else []), "mean_ms", *QUANTILES, "count", "total_s", rate.alias("throughput_qps")
    )


def latency_report(
    timings: DataFrame, batch_size: int, config: dict[str, str | int], mode: str = "mode"
) -> DataFrame:
    """One row per mode, with the load settings echoed in ``config``."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    return latency_summary(timings, batch_size, [mode]).withColumn("config", settings)
