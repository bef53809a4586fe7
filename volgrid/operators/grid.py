"""Book and trade rows merged onto a dense one-second grid.

Layout of the work, for every operator here:

1. Book rows, trade rows and one anchor row per wanted bucket (at second 0) are unioned and
   grouped by (bucket, second). Partial aggregation runs before the shuffle, so copies of a
   slot collapse on the map side and no bucket can send more than 600 rows per map task.
2. The sparse slots, at most 600 per bucket, move once to their bucket. Everything after
   that step (fills, lags, grid, rolling sums, tensors) reuses this one partitioning.
3. The grid comes last: a slot stands for the seconds up to the next slot, so the dense rows
   are generated inside the task that needs them and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..schemas import BOOK_VALUES, BUCKET_KEY, BUCKET_SECONDS, SECOND, SLOT_KEY, TRADE_VALUES

# Buckets that a task makes the 600 rows of and sorts them: some 180 MB.
BUCKETS_PER_TASK = 2_000


def by_second() -> WindowSpec:
    return Window.partitionBy(*BUCKET_KEY).orderBy(SECOND)


def so_far() -> WindowSpec:
    return by_second().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ffill(value: Column | str) -> Column:
    """Last non-null value of the bucket up to this row; leading nulls stay null."""
    return F.last(value, ignorenulls=True).over(so_far())


def ffill_before(value: Column | str) -> Column:
    """``ffill`` as it stood on the previous row."""
    before = by_second().rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(before)


def on_grid(df: DataFrame) -> DataFrame:
    """Rows whose second lies on the bucket's grid."""
    return df.where(F.col(SECOND).between(0, BUCKET_SECONDS - 1))


def _book_rows(book: DataFrame) -> DataFrame:
    values = [nan_to_null(c).alias(c) if c.endswith("price1") else F.col(c) for c in BOOK_VALUES]
    return book.select(*SLOT_KEY, *values, F.lit(1).alias("_has_book"))


def _trade_rows(trade: DataFrame) -> DataFrame:
    return trade.select(*SLOT_KEY, *TRADE_VALUES, F.lit(1).alias("_has_trade"))


def whole_rows(df: DataFrame, values: list[str]) -> DataFrame:
    """One row per slot of a source with differing copies: the largest by its values in order.

    The row is kept as a whole, so that no quote is made up from several.
    """
    row = F.max(F.struct(*values)).alias("_row")
    return df.groupBy(*SLOT_KEY).agg(row).select(*SLOT_KEY, *[F.col(f"_row.{c}") for c in values])


def _only_value(column: str, mark: str) -> Column:
    """The value that all of a slot's rows with ``mark`` have; the job fails if they differ."""
    at = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in SLOT_KEY])
    message = F.concat(F.lit(f"rows of one source differ in {column} at "), at)
    counted = F.col(f"_n_{column}")
    differ = (F.col(f"_low_{column}") != F.col(column)) | ((counted > 0) & (counted != F.col(mark)))
    return F.when(differ, F.raise_error(message)).otherwise(F.col(column))


def _merge_rows(rows: DataFrame, carry: tuple[str, ...] = (), anchored: bool = False) -> DataFrame:
    """One row per slot; copies of a source's row are combined.

    Rows of one source that differ fail the job, and so does a second anchor: both are found in
    the aggregation that combines copies, for the columns that the plan uses.
    """
    sources = {c: "_has_book" for c in BOOK_VALUES} | {c: "_has_trade" for c in TRADE_VALUES}
    marks = ["_has_book", "_has_trade", *(["_anchor"] if anchored else [])]
    merged = rows.groupBy(*SLOT_KEY).agg(
        *[F.max(c).alias(c) for c in (*sources, *carry)],
        *[F.min(c).alias(f"_low_{c}") for c in sources],
        *[F.count(c).alias(f"_n_{c}") for c in sources],
        *[F.sum(m).alias(m) for m in marks],
    )
    values = [_only_value(c, mark).alias(c) for c, mark in sources.items()]
    anchor = []
    if anchored:
        twice = F.raise_error(F.concat(F.lit("more than one label row at "), F.concat_ws(", ", *BUCKET_KEY)))
        anchor = [F.when(F.col("_anchor") > 1, twice).otherwise(F.col("_anchor")).alias("_anchor")]
    return merged.select(*SLOT_KEY, *values, *carry, "_has_book", *anchor)


def _only_with_book(merged: DataFrame) -> DataFrame:
    """Forget trades of the slots that have no book row."""
    return merged.withColumns(
        {c: F.when(F.col("_has_book") > 0, F.col(c)) for c in TRADE_VALUES}
    )


def merge_book_trade(book: DataFrame, trade: DataFrame, keep_trade_only: bool = True) -> DataFrame:
    """Full outer join on (bucket, second), as a union and one aggregation.

    With ``keep_trade_only=False`` a trade is kept only where the book has a row too.
    """
    rows = _book_rows(book).unionByName(_trade_rows(trade), allowMissingColumns=True)
    merged = _merge_rows(rows)
    if not keep_trade_only:
        merged = merged.where("_has_book > 0")
    return merged.drop("_has_book")


def merge_book_trade_by_join(book: DataFrame, trade: DataFrame) -> DataFrame:
    """The same result with a full outer join; kept as a cross-check of the union form."""
    left = _book_rows(book).drop("_has_book")
    return left.join(trade.select(*SLOT_KEY, *TRADE_VALUES), SLOT_KEY, "full")


def merged_slots(
    index: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    keep_trade_only: bool = True,
    carry: tuple[str, ...] = (),
    unique_slots: bool = False,
) -> DataFrame:
    """Observed slots plus an anchor at second 0 of each indexed bucket, placed by bucket.

    Numeric ``carry`` columns of the index (such as the label) ride along on the anchor, which
    attaches them to the bucket without a join.

    The index has one row per bucket and a source one row per slot, or copies of it: a second
    label row or a differing one of a source fails the job (``whole_rows`` picks one
    beforehand). ``unique_slots=True`` promises that there are no copies, hence at most 1,201
    rows per bucket, which then move to their bucket at once: that saves the shuffle that
    combines copies. The result is the same either way.

    Buckets are placed in as many tasks as the session says, or more if these would get over
    ``BUCKETS_PER_TASK`` each: the index is counted when this is called.
    """
    anchors = index.select(
        *BUCKET_KEY, F.lit(0).alias(SECOND), *carry, F.lit(1).alias("_anchor")
    )
    rows = (
        on_grid(_book_rows(book))
        .unionByName(on_grid(_trade_rows(trade)), allowMissingColumns=True)
        .unionByName(anchors, allowMissingColumns=True)
    )
    # A sparse slot stands for many grid rows, so the size of this shuffle says little about
    # the work behind it: the partition count follows the buckets instead of being left to coalescing.
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(usual, -(-index.count() // BUCKETS_PER_TASK))
    if unique_slots:
        rows = rows.repartition(partitions, *BUCKET_KEY)
    merged = _merge_rows(rows, carry, anchored=True)
    if not keep_trade_only:
        merged = _only_with_book(merged)
    if not unique_slots:
        merged = merged.repartition(partitions, *BUCKET_KEY)
    return merged.drop("_has_book")


def slot_marks(carry: tuple[str, ...] = ()) -> list[Column]:
    """Window columns that go with ``merged_slots``.

    Second 0 sorts first, so a running maximum sees the anchor on every row of its bucket.
    ``next_second`` is where the slot's validity ends.
    """
    following = F.coalesce(F.lead(SECOND).over(by_second()), F.lit(BUCKET_SECONDS))
    marks = [F.max(c).over(so_far()).alias(c) for c in ("_anchor", *carry)]
    return [following.alias("next_second"), *marks]


def indexed_only(slots: DataFrame) -> DataFrame:
    """Drop slots of buckets that have no anchor, that is, are not in the index."""
    return slots.where(F.col("_anchor") == 1).drop("_anchor")


def expand_seconds(slots: DataFrame) -> DataFrame:
    """Dense rows: each slot is repeated for the seconds up to the next one.

    ``is_slot`` marks the second the slot was observed in. Columns already carry the state
    known at the slot, so the repeated rows are the forward fill.
    """
    kept = [c for c in slots.columns if c not in (SECOND, "next_second")]
    dense = slots.select(
        *kept,
        F.col(SECOND).alias("_slot"),
        F.explode(F.sequence(F.col(SECOND), F.col("next_second") - 1)).alias(SECOND),
    )
    return dense.withColumn("is_slot", F.col(SECOND) == F.col("_slot")).drop("_slot")


def densify(
    index: DataFrame, book: DataFrame, trade: DataFrame, keep_trade_only: bool = True
) -> DataFrame:
    """Left join of the 600-second grid with the merged rows; unobserved seconds are null."""
    merged = merged_slots(index, book, trade, keep_trade_only)
    slots = merged.select(*SLOT_KEY, *BOOK_VALUES, *TRADE_VALUES, *slot_marks())
    dense = expand_seconds(indexed_only(slots))
    values = [F.when(F.col("is_slot"), F.col(c)).alias(c) for c in (*BOOK_VALUES, *TRADE_VALUES)]
    return dense.select(*SLOT_KEY, *values)


def asof_book(index: DataFrame, book: DataFrame, trade: DataFrame) -> DataFrame:
    """Book state known at every second of every indexed bucket."""
    fills = [ffill(c).alias(c) for c in BOOK_VALUES]
    slots = merged_slots(index, book, trade).select(*SLOT_KEY, *fills, *slot_marks())
    return expand_seconds(indexed_only(slots)).select(*SLOT_KEY, *BOOK_VALUES)
