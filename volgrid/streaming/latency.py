"""Live latency: counts per event-time window and value range, and percentiles with known bounds.

Timings arrive with an event time. Rows of one request that are sent again within the watermark
count once; rows later than the watermark are left out (``numRowsDroppedByWatermark`` of the
query's progress counts them). The state of a window is a histogram over ranges that are fixed in
advance, so histograms of several windows, groups or streams are merged by adding up their counts.

A range holds the values with the same leading bits (``BITS``) in whole microseconds, so its width
is below ``2 ** (1 - BITS)`` of its values, 3.2 percent. A percentile lies in the range that holds its
floor rank, between the least and the largest value seen there: these are its bounds. There are
at most 59 * 32 ranges a window and group, whatever the number of rows.

Values that are null, NaN, infinite or negative count as ``invalid`` and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_finite
from ..operators.latency import QUANTILES, floor_rank
from ..operators.ordering import null_free

#: Leading bits of a value that its range keeps.
BITS = 6
MICROS = 1000
#: Larger values count as this one: 146 years.
LARGEST = 2**62
HISTOGRAM = "low long, high long, n long, total long, least long, most long"


def micros(value: Column) -> Column:
    """Milliseconds as whole microseconds."""
    return F.least(F.round(value * MICROS), F.lit(float(LARGEST))).cast("long")


def range_of(value: Column) -> tuple[Column, Column]:
    """The least and the largest value of a range, in whole microseconds from 0."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    # Shifts by a column.
    low = F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)
    return low, low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def latency_histograms(
    timings: DataFrame,
    by: list[str],
    every: str = "1 minute",
    delay: str = "10 minutes",
    time: str = "ts",
    request: str | None = "request_id",
    value: str = "latency_ms",
) -> DataFrame:
    """``window_start, window_end``, the columns of ``by``, and counts per range (``HISTOGRAM``).

    Rows without a valid latency have a null range. With ``request`` the rows of one request are
    counted once. Works on streams and on tables; a stream emits a window when the watermark has
    passed its end, and keeps nothing of it then.
    """
    rows = timings.withWatermark(time, delay) if timings.isStreaming else timings
    if request:
        rows = rows.dropDuplicatesWithinWatermark([request]) if timings.isStreaming else rows.dropDuplicates([request])
    good = is_finite(value) & (F.col(value) >= 0)
    valued = rows.withColumn("_micros", F.when(good, micros(F.col(value))))
    low, high = range_of(F.col("_micros"))
    counted = (
        valued.withColumns({"low": low, "high": high})
        .groupBy(F.window(time, every).alias("_window"), *by, "low", "high")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("_micros").cast("decimal(38,0)")).alias("total"),
            F.min("_micros").alias("least"), F.max("_micros").alias("most"),
        )
    )
    names = [c for c in counted.columns if c != "_window"]
    return counted.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *names)


def write_histograms(histograms: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the counts of finished windows to a table."""
    writer = histograms.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def latency_bounds(histograms: DataFrame, by: list[str], quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """Per group the mean, counts, and for each quantile its bounds (``p50_ms_low``, ``p50_ms_high``).

    ``by`` names any columns of the histograms: without the window's, all windows are merged.
    Null is a group of its own.
    """
    keyed, keys, restored = null_free(histograms, by)
    ranges = keyed.groupBy(*keys, "low").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    valid = F.col("low").isNotNull()
    # At most 59 * 32 ranges a group.
    inside = Window.partitionBy(*keys, valid)
    placed = ranges.withColumns(
        {
            "_upto": F.when(valid, F.sum("n").over(inside.orderBy("low"))),
            "_all": F.when(valid, F.sum("n").over(inside)),
        }
    )
    out = []
    for name, p in quantiles.items():
        rank = floor_rank(F.col("_all"), p)
        hit = (rank > F.col("_upto") - F.col("n")) & (rank <= F.col("_upto"))
        out += [
            F.max(F.when(hit, F.col("least")) / MICROS).alias(f"{name}_low"),
            F.max(F.when(hit, F.col("most")) / MICROS).alias(f"{name}_high"),
        ]
    count = F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0))
    found = placed.groupBy(*keys).agg(
        F.try_divide(F.sum("total").cast("double") / MICROS, count).alias("mean_ms"), *out,
        count.alias("count"), F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid"),
    )
    return found.select(*restored, *[c for c in found.columns if c not in keys])


def read_histograms(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Histograms that ``write_histograms`` has stored; ``like`` gives their columns."""
    return spark.read.schema(like.schema).parquet(path)
