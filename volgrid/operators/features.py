"""The fourteen per-second features of a bucket, and its realized volatility.

Fills, staleness marks and log returns are computed on the sparse slots, in one window pass.
Only the rolling sums need the dense seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import square
from ..functions.scalars import nan_to_null
from ..schemas import BUCKET_KEY, EPS, FEATURES, SECOND, SLOT_KEY, STALE_CAP
from .grid import (
    by_second,
    expand_seconds,
    ffill,
    ffill_before,
    indexed_only,
    merged_slots,
    slot_marks,
)

# All rolling sums are built from one 30-row frame: longer windows add its lagged values.
BASE_WINDOW = 30
WINDOWS = {"rv_30s": 30, "order_intensity_60s": 60, "rv_120s": 120}


def wap() -> Column:
    """Size-weighted price of the best level; null unless all four values are present."""
    bid, ask = F.col("bid_price1"), F.col("ask_price1")
    bid_size, ask_size = F.col("bid_size1"), F.col("ask_size1")
    return nan_to_null((bid * ask_size + ask * bid_size) / (bid_size + ask_size + F.lit(EPS)))


def spread() -> Column:
    return F.col("ask_price1") - F.col("bid_price1")


def mid() -> Column:
    return (F.col("ask_price1") + F.col("bid_price1")) / 2


def size_imbalance() -> Column:
    bid_size, ask_size = F.col("bid_size1"), F.col("ask_size1")
    return (bid_size - ask_size) / (bid_size + ask_size + F.lit(EPS))


def staleness(last_seen: Column | str) -> Column:
    """Seconds since ``last_seen``, counting from 1 before the first one, capped."""
    second = F.col(SECOND)
    seen = F.col(last_seen) if isinstance(last_seen, str) else last_seen
    return F.least(F.coalesce(second - seen, second + 1), F.lit(STALE_CAP))


def _log_price(c: str) -> Column:
    return F.when(F.col(c) > 0, F.ln(F.col(c)))


def slot_states(
    index: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    keep_trade_only: bool = True,
    carry: tuple[str, ...] = (),
    unique_slots: bool = False,
) -> DataFrame:
    """State after each observed slot: filled values, last-seen seconds and log return.

    Between two slots the filled price does not move, so its log return is 0 there and the
    slots hold every non-zero return of the bucket.
    """
    return states_of_slots(merged_slots(index, book, trade, keep_trade_only, carry, unique_slots), carry)


def states_of_slots(slots: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The same from slots that are placed by bucket, in the form of ``grid.merged_slots``."""
    raw = slots.select(
        *SLOT_KEY,
        *carry,
        "_anchor",
        "size",
        "order_count",
        wap().alias("_wap"),
        spread().alias("_spread"),
        mid().alias("_mid"),
        size_imbalance().alias("_imbalance"),
    )
    # All columns share one window specification, so they take one pass over one sort.
    states = raw.select(
        *SLOT_KEY,
        *slot_marks(carry),
        "size",
        "order_count",
        ffill("_wap").alias("wap_last"),
        ffill_before("_wap").alias("_wap_before"),
        ffill("_spread").alias("spread_last"),
        ffill("_mid").alias("mid_last"),
        ffill("_imbalance").alias("ofi_last"),
        ffill(F.when(F.col("_wap").isNotNull(), F.col(SECOND))).alias("_wap_second"),
        ffill(F.when(F.col("size").isNotNull(), F.col(SECOND))).alias("_trade_second"),
    )
    # A price that is not positive has no logarithm: both differences it takes part in are 0.
    log_return = F.coalesce(_log_price("wap_last") - _log_price("_wap_before"), F.lit(0.0))
    return indexed_only(states).withColumn("log_return", log_return).drop("_wap_before")


def _rolling(base: str, seconds: int) -> Column:
    """Trailing sum over ``seconds`` rows from trailing sums over ``BASE_WINDOW`` rows.

    Adds whole blocks and never subtracts, so sums of squares cannot turn negative and a
    quiet window is exactly 0.
    """
    total = F.col(base)
    for back in range(BASE_WINDOW, seconds, BASE_WINDOW):
        total = total + F.coalesce(F.lag(base, back).over(by_second()), F.lit(0))
    return total


def _root(c: str) -> Column:
    return F.coalesce(F.sqrt(nan_to_null(c)), F.lit(0.0))


def bucket_features(
    index: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    keep_trade_only: bool = True,
    carry: tuple[str, ...] = (),
    unique_slots: bool = False,
) -> DataFrame:
    """600 rows per indexed bucket: second, carried columns and the features in order."""
    return features_of_states(slot_states(index, book, trade, keep_trade_only, carry, unique_slots), carry)


def features_of_states(states: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The features from the states after each slot (see ``slot_states``)."""
    seconds_since_trade = staleness("_trade_second")

    def at_slot(value: Column) -> Column:
        return F.when(F.col("is_slot"), value).otherwise(F.lit(0))

    dense = expand_seconds(states).select(
        *SLOT_KEY,
        *carry,
        at_slot(F.coalesce(F.col("size"), F.lit(0))).alias("size"),
        at_slot(F.coalesce(F.col("order_count"), F.lit(0))).alias("order_count"),
        "wap_last",
        staleness("_wap_second").alias("seconds_since_last_wap"),
        at_slot(F.col("log_return")).alias("log_return"),
        "spread_last",
        "mid_last",
        (F.col("spread_last") / (F.col("mid_last") + F.lit(EPS))).alias("rel_spread_last"),
        "ofi_last",
        seconds_since_trade.alias("seconds_since_last_trade"),
        (seconds_since_trade >= STALE_CAP).cast("byte").alias("last_trade_gap_geq_cap"),
    )
    base = by_second().rowsBetween(1 - BASE_WINDOW, Window.currentRow)
    summed = dense.select(
        "*",
        F.sum(square(F.col("log_return"))).over(base).alias("_squares"),
        F.sum("order_count").over(base).alias("_orders"),
    )
    rolled = summed.select(
        "*",
        _rolling("_squares", WINDOWS["rv_30s"]).alias("_squares_short"),
        _rolling("_squares", WINDOWS["rv_120s"]).alias("_squares_long"),
        _rolling("_orders", WINDOWS["order_intensity_60s"]).alias("order_intensity_60s"),
    ).withColumns({"rv_30s": _root("_squares_short"), "rv_120s": _root("_squares_long")})
    return rolled.select(*SLOT_KEY, *carry, *FEATURES)


def bucket_rv(
    index: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    keep_trade_only: bool = True,
    unique_slots: bool = False,
) -> DataFrame:
    """Realized volatility of each bucket: root of the summed squared log returns.

    Works on the sparse slots alone; no grid is generated.
    """
    states = slot_states(index, book, trade, keep_trade_only, (), unique_slots)
    return states.groupBy(*BUCKET_KEY).agg(F.sqrt(F.sum(square(F.col("log_return")))).alias("rv"))
