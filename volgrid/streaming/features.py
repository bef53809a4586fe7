"""The features of a bucket while it fills: seconds are emitted as the watermark passes them.

Rows of both sources arrive with an event time, in any order within the watermark's delay. The
state of a bucket is what its next second needs: the filled values, the seconds of the last price
and trade, 120 squared log returns and 60 order counts, and the rows that have arrived for seconds
which are not final yet (at most 600 a source). A second is final when the watermark has passed
its end; its features are emitted once and never change. After its last second nothing is kept of
a bucket, and rows later than the watermark are left out.

Buckets share calls and state by groups: one call takes the rows of its group's buckets, and what
they changed is made into rows of all seconds behind the state, several buckets at once.

When all rows are on time and the watermark has passed the end of a bucket, its 600 rows are those
of ``operators.features.bucket_features``.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.features import WINDOWS
from ..operators.grid import on_grid
from ..schemas import BOOK_VALUES, BUCKET_KEY, BUCKET_SECONDS, EPS, FEATURES, SECOND, STALE_CAP, TRADE_VALUES

_INTEGERS = {"size", "order_count", "order_intensity_60s"}
_COUNTERS = {"seconds_since_last_wap", "seconds_since_last_trade"}
RESULT = f"stock_id int, time_id int, {SECOND} int, " + ", ".join(
    f"{c} " + ("long" if c in _INTEGERS else "int" if c in _COUNTERS else "byte" if c == "last_trade_gap_geq_cap" else "double")
    for c in FEATURES
)
_VALUES = [*BOOK_VALUES, *TRADE_VALUES]
#: The buckets of a group that are not finished, as bytes: each with what ``_Bucket.state`` returns.
STATE = "buckets binary"
#: Groups of buckets, and rows that are computed at once.
GROUPS, ROWS_AT_ONCE = 200, 10_000
_NAN = math.nan
_SQUARES, _ORDERS = max(WINDOWS["rv_30s"], WINDOWS["rv_120s"]), WINDOWS["order_intensity_60s"]
#: Earlier seconds that a sum reaches back to.
_EARLIER = max(_SQUARES, _ORDERS) - 1
BOOK, TRADE, ANCHOR = 0, 1, 2


def bucket_rows(book: DataFrame, trade: DataFrame, index: DataFrame | None = None, time: str = "ts") -> DataFrame:
    """Arriving rows of both sources as one stream; all come with their event time.

    Rows of an ``index`` open a bucket without a row in it: their time is that of second 0.
    """
    parts = [
        on_grid(book).select(*BUCKET_KEY, SECOND, time, *BOOK_VALUES, F.lit(BOOK).alias("source")),
        on_grid(trade).select(*BUCKET_KEY, SECOND, time, *TRADE_VALUES, F.lit(TRADE).alias("source")),
    ]
    if index is not None:
        parts.append(index.select(*BUCKET_KEY, F.lit(0).alias(SECOND), time, F.lit(ANCHOR).alias("source")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(_NAN)).alias(c) for c in _VALUES]
    return rows.select(*BUCKET_KEY, SECOND, F.col(time).cast("timestamp").alias("ts"), "source", *values)


class _Bucket:
    """One bucket between two calls. Missing numbers are NaN, missing seconds -1."""

    def __init__(self, state: tuple | None):
        if state is None:
            state = (0, None, _NAN, _NAN, _NAN, _NAN, -1, -1, [], [], [], [], [])
        (self.next, self.start, self.wap, self.spread, self.mid, self.ofi, self.wap_second, self.trade_second,
         self.squares, self.orders, seconds, sources, rows) = state
        self.squares, self.orders = list(self.squares), list(self.orders)
        self.held = {(s, k): tuple(r) for s, k, r in zip(seconds, sources, rows)}

    def state(self) -> tuple:
        keys = sorted(self.held)
        return (
            self.next, self.start, self.wap, self.spread, self.mid, self.ofi, self.wap_second, self.trade_second,
            self.squares, self.orders, [s for s, _ in keys], [k for _, k in keys], [list(self.held[k]) for k in keys],
        )

    def add(self, second: int, source: int, values: tuple[float, ...]) -> None:
        if second < self.next or source == ANCHOR:
            return
        known = self.held.setdefault((second, source), values)
        if known is not values and any(a != b and not (a != a and b != b) for a, b in zip(known, values)):
            raise ValueError(f"rows of one source differ at second {second}")

    def _quote(self, second: int, bid: float, ask: float, bid_size: float, ask_size: float) -> float:
        """Take over a book row; the log return that it makes."""
        before = self.wap
        wap = (bid * ask_size + ask * bid_size) / (bid_size + ask_size + EPS)
        if wap == wap:
            self.wap, self.wap_second = wap, second
        if (spread := ask - bid) == spread:
            self.spread = spread
        if (mid := (ask + bid) / 2) == mid:
            self.mid = mid
        if (ofi := (bid_size - ask_size) / (bid_size + ask_size + EPS)) == ofi:
            self.ofi = ofi
        return math.log(self.wap) - math.log(before) if self.wap > 0 and before > 0 else 0.0

    def seconds(self, final: int) -> dict[str, np.ndarray]:
        """The features of all seconds from the next one to before ``final``."""
        done = _Seconds()
        done.take(self, final)
        return done.columns()

    def second(self) -> tuple:
        """The features of the next second."""
        return tuple(column[0].item() for column in self.seconds(self.next + 1).values())


class _Seconds:
    """Seconds of several buckets that are final: taken bucket by bucket, computed at once.

    What is taken are the values that slots changed, with their places among all seconds; before the
    seconds of each bucket there is room for the squares and counts of earlier ones.
    """

    def __init__(self):
        self.keys, self.firsts, self.lengths, self.rows = [], [], [], 0
        self.places, self.quotes = [], []
        self.trade_places, self.trade_seconds = [], []
        self.size_places, self.sizes, self.counts = [], [], []
        self.square_places, self.squares = [], []
        self.count_places, self.all_counts = [], []

    def take(self, bucket: _Bucket, final: int, key: tuple | None = None) -> None:
        """The seconds of a bucket from its next one to before ``final``."""
        first, bucket.next = bucket.next, final
        n, start = final - first, self.rows
        # Where second 0 of the bucket would be among the squares.
        room = start + _EARLIER * (len(self.keys) + 1) - first
        for known, most, places, values in (
            (bucket.squares, _SQUARES, self.square_places, self.squares), (bucket.orders, _ORDERS, self.count_places, self.all_counts)
        ):
            recent = known[-(most - 1) :]
            places.extend(range(room + first - len(recent), room + first))
            values.extend(recent)
        squares, counts = [*bucket.squares, *[0.0] * n][-_SQUARES:], [*bucket.orders, *[0.0] * n][-_ORDERS:]
        self.places.append(start)
        self.quotes.append((0.0, bucket.wap, bucket.spread, bucket.mid, bucket.ofi, bucket.wap_second))
        self.trade_places.append(start)
        self.trade_seconds.append(bucket.trade_second)
        for s, source in sorted(k for k in bucket.held if k[0] < final):
            row, place = bucket.held.pop((s, source)), start + s - first
            if source == BOOK:
                log_return = bucket._quote(s, *row[: len(BOOK_VALUES)])
                self.places.append(place)
                self.quotes.append((log_return, bucket.wap, bucket.spread, bucket.mid, bucket.ofi, bucket.wap_second))
                square = log_return * log_return
                self.square_places.append(room + s)
                self.squares.append(square)
                if final - s <= len(squares):
                    squares[s - final] = square
            else:
                size, count = row[len(BOOK_VALUES) :]
                if size == size:
                    bucket.trade_second = s
                    self.trade_places.append(place)
                    self.trade_seconds.append(s)
                size, count = (0 if v != v else int(v) for v in (size, count))
                self.size_places.append(place)
                self.sizes.append(size)
                self.counts.append(count)
                self.count_places.append(room + s)
                self.all_counts.append(float(count))
                if final - s <= len(counts):
                    counts[s - final] = float(count)
        bucket.squares, bucket.orders = squares, counts
        self.keys.append(key)
        self.firsts.append(first)
        self.lengths.append(n)
        self.rows += n

    def columns(self) -> dict[str, np.ndarray]:
        """The features of all seconds that were taken, in the order of their buckets."""
        n, lengths = self.rows, np.array(self.lengths)
        before = np.cumsum(lengths) - lengths
        second = np.arange(n) + np.repeat(np.array(self.firsts) - before, lengths)
        places = np.array(self.places)
        changes = np.array(self.quotes).T
        log_returns = np.zeros(n)
        # An entry of the bucket's state has no return and may share the place of a row after it.
        log_returns[places] = changes[0]
        held = np.diff(places, append=n)
        wap, spread, mid, ofi, wap_second = (np.repeat(c, held) for c in changes[1:])
        if (mid + EPS == 0).any():
            raise ZeroDivisionError("mid price")
        trade_second = np.repeat(self.trade_seconds, np.diff(self.trade_places, append=n))
        sizes, orders = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        sizes[self.size_places], orders[self.size_places] = self.sizes, self.counts

        def since(last: np.ndarray) -> np.ndarray:
            return np.minimum(np.where(last >= 0, second - last, second + 1), STALE_CAP)

        squares, counts = np.zeros(n + _EARLIER * len(lengths)), np.zeros(n + _EARLIER * len(lengths))
        squares[self.square_places] = self.squares
        counts[self.count_places] = self.all_counts
        kept = np.arange(n) + np.repeat(_EARLIER * np.arange(1, len(lengths) + 1), lengths)
        since_trade = since(trade_second)
        values = {
            "size": sizes, "order_count": orders, "wap_last": wap, "seconds_since_last_wap": since(wap_second),
            "log_return": log_returns, "rv_30s": np.sqrt(_trailing(squares, WINDOWS["rv_30s"])[kept]),
            "rv_120s": np.sqrt(_trailing(squares, WINDOWS["rv_120s"])[kept]), "spread_last": spread,
            "mid_last": mid, "rel_spread_last": spread / (mid + EPS), "ofi_last": ofi,
            "seconds_since_last_trade": since_trade, "last_trade_gap_geq_cap": since_trade >= STALE_CAP,
            "order_intensity_60s": _trailing(counts, _ORDERS)[kept],
        }
        return {SECOND: second, **{c: values[c] for c in FEATURES}}

    def batch(self) -> pa.RecordBatch:
        """The columns with the keys of their buckets, in the form of ``RESULT``."""
        keys = (np.repeat(np.array([_NAN if k is None else k for k in ks]), self.lengths) for ks in zip(*self.keys, strict=True))
        columns = dict(zip(BUCKET_KEY, keys)) | self.columns()
        # NaN becomes null.
        arrays = [pa.array(v.astype(np.int8) if v.dtype == bool else v, type=_KINDS[c], from_pandas=True) for c, v in columns.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _trailing(values: np.ndarray, window: int) -> np.ndarray:
    """Sums over the last ``window`` values: added from the earliest on."""
    total = np.zeros(len(values))
    for back in range(min(window, len(values)) - 1, -1, -1):
        total[back:] += values[: len(values) - back]
    return total


_KINDS = dict.fromkeys([*BUCKET_KEY, SECOND, *_COUNTERS], pa.int32()) | {
    c: pa.int64() if c in _INTEGERS else pa.int8() if c == "last_trade_gap_geq_cap" else pa.float64()
    for c in FEATURES
    if c not in _COUNTERS
}


def _whole(column: pd.Series) -> list:
    """Keys of a column as integers; null is None."""
    if not column.hasnans:
        return column.tolist()
    return [None if v != v else int(v) for v in column.tolist()]


def _add_rows(buckets: dict[tuple, _Bucket], frame: pd.DataFrame, slot_ms: int) -> None:
    """Arriving rows to their buckets; a first row opens its bucket."""
    times = frame["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[frame["ts"].dt.unit]
    starts = ((times // slot_ms - frame[SECOND]) * slot_ms).tolist()
    keys = zip(*(_whole(frame[c]) for c in BUCKET_KEY))
    values = zip(*(frame[c].tolist() for c in _VALUES))
    for key, start, second, source, row in zip(keys, starts, frame[SECOND].tolist(), frame["source"].tolist(), values):
        bucket = buckets.get(key)
        if bucket is None:
            bucket = buckets[key] = _Bucket(None)
            bucket.start = start
        bucket.add(second, source, row)


def _dumps(value: object) -> bytes:
    """About a third of the pickled size: states and batches of these stay in memory."""
    return zlib.compress(pickle.dumps(value, 5), 1)


def _loads(value: bytes) -> object:
    return pickle.loads(zlib.decompress(value))


def _update(slot_ms: int, groups: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buckets = {}
        if state.exists:
            known, stored = _loads(state.get[0])
            if known != groups:
                raise ValueError(f"the stored state has {known} groups of buckets, not {groups}")
            buckets = {k: _Bucket(s) for k, s in stored}
        if not state.hasTimedOut:
            for frame in frames:
                _add_rows(buckets, frame, slot_ms)
        watermark = state.getCurrentWatermarkMs()
        done = _Seconds()
        for k, bucket in buckets.items():
            final = min(BUCKET_SECONDS, max(0, (watermark - bucket.start) // slot_ms))
            if final > bucket.next:
                done.take(bucket, final, k)
                if done.rows >= ROWS_AT_ONCE:
                    yield pd.DataFrame({"done": [_dumps(done)]})
                    done = _Seconds()
        if done.rows:
            yield pd.DataFrame({"done": [_dumps(done)]})
        unfinished = [(k, b) for k, b in buckets.items() if b.next < BUCKET_SECONDS]
        if unfinished:
            state.update((_dumps((groups, [(k, b.state()) for k, b in unfinished])),))
            # The next call is due when the next second of a bucket is final; a group is called when
            # the watermark is beyond its time.
            due = min(b.start + (b.next + 1) * slot_ms for _, b in unfinished)
            state.setTimeoutTimestamp(max(due - 1, watermark + 1))
        else:
            state.remove()

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for done in batch.column(0):
            yield _loads(done.as_py()).batch()


def live_features(rows: DataFrame, delay: str = "30 seconds", slot_seconds: int = 1, groups: int = GROUPS) -> DataFrame:
    """The features of every second that is final, from a stream of ``bucket_rows``.

    ``slot_seconds`` is the length of a grid second in event time. A bucket's second 0 begins at a
    multiple of it. Missing features are null.

    Buckets are kept and computed in ``groups`` groups by a hash of their key: a call works on all
    buckets of a group, so there should be some hundred open ones in each. The number stays as it is
    for the life of a checkpoint; another one fails.
    """
    timed = rows.withWatermark("ts", delay).withColumn("_group", F.pmod(F.xxhash64(*BUCKET_KEY), F.lit(groups)))
    # What slots changed comes from the state, and the rows of all seconds are made behind it: its
    # way from Python is slow, by the row.
    done = timed.groupBy("_group").applyInPandasWithState(
        _update(1000 * slot_seconds, groups), "done binary", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return done.mapInArrow(_expand, RESULT)


def write_features(features: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the seconds that have become final to a table."""
    writer = features.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
