"""Market tables stored in the distribution that features are built in.

Book and trade rows are merged to one row per slot once, and stored in buckets of the hash of
(instrument, time bucket), sorted by bucket and second; the index is stored in the same buckets.
Features, matrices and realized volatility then read the tables as they lie: the join of index and
slots and all windows reuse the stored distribution, without any shuffle. Worth it for data that is
read more than once: for several feature lists, splits or labels.

The tables are in the session's catalog, with their files at a path of the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import features_of_states, states_of_slots
from ..operators.grid import merged_slots
from ..schemas import BOOK_VALUES, BUCKET_KEY, SECOND, SLOT_KEY, TRADE_VALUES


def _write(df: DataFrame, table: str, path: str, buckets: int, order: list[str]) -> None:
    """One file per bucket: rows go to the task that writes their bucket."""
    placed = df.repartition(buckets, *BUCKET_KEY)
    placed.write.bucketBy(buckets, *BUCKET_KEY).sortBy(*order).option("path", path).saveAsTable(table)


def write_slots(
    book: DataFrame, trade: DataFrame, table: str, path: str, buckets: int, keep_trade_only: bool = True
) -> None:
    """Store the merged slots of all buckets that book or trade have rows of.

    Each bucket has a row at second 0, so that features begin there. Copies of rows are combined,
    and rows of one source that differ fail the job, as in ``grid.merged_slots``. ``buckets`` should
    give files of some 100 MB; it has to be that of the index.
    """
    seen = book.select(*BUCKET_KEY).unionByName(trade.select(*BUCKET_KEY)).distinct()
    slots = merged_slots(seen, book, trade, keep_trade_only).drop("_anchor")
    _write(slots.select(*SLOT_KEY, *BOOK_VALUES, *TRADE_VALUES), table, path, buckets, SLOT_KEY)


def write_index(index: DataFrame, table: str, path: str, buckets: int) -> None:
    """Store an index (one row per bucket), with all its columns, in the buckets of the slots."""
    _write(index, table, path, buckets, BUCKET_KEY)


def placed_slots(spark: SparkSession, index_table: str, slots_table: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Slots of the indexed buckets in the form of ``grid.merged_slots``, without a shuffle.

    A bucket without any stored slot gets its row at second 0.
    """
    index = spark.table(index_table).select(*BUCKET_KEY, *carry)
    joined = index.join(spark.table(slots_table).hint("merge"), BUCKET_KEY, "left")
    return joined.withColumns({SECOND: F.coalesce(F.col(SECOND), F.lit(0)), "_anchor": F.lit(1)})


def bucket_features(spark: SparkSession, index_table: str, slots_table: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``features.bucket_features`` from the stored layout."""
    return features_of_states(states_of_slots(placed_slots(spark, index_table, slots_table, carry), carry), carry)
