"""Features by a function of the user's own, called once per bucket with the rows of both sources.

The function gets ``(stock_id, time_id, book, trade)``, where book and trade are pandas frames of
the bucket's rows in order of the second, one row per second. It returns columns of exactly 600
values, one for each second: a frame or a mapping of names to arrays, with the names that were
declared and no others. Anything else fails the job and names the bucket.

Book rows, trade rows and one anchor row per indexed bucket are cogrouped by bucket: one shuffle a
side, and a group has at most 1,201 rows and their copies. The index decides which buckets there
are: others are dropped, and one without rows is called with empty frames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOK_VALUES, BUCKET_KEY, BUCKET_SECONDS, SECOND, TRADE_VALUES
from .grid import on_grid

BucketFunction = Callable[[int, int, pd.DataFrame, pd.DataFrame], pd.DataFrame | Mapping[str, np.ndarray]]


def _call(function: BucketFunction, columns: list[str], second: str, seconds: int):
    """Arrow function of a cogroup. All it needs is in its closure."""
    book_columns, trade_columns = list(BOOK_VALUES), list(TRADE_VALUES)

    def one_per_second(table: pa.Table, values: list[str], source: str, where: str) -> pd.DataFrame:
        rows = table.select([second, *values]).to_pandas().drop_duplicates()
        twice = rows[second].duplicated()
        if twice.any():
            at = rows[second][twice].iloc[0]
            raise ValueError(f"rows of {source} differ at {where}, second {at}")
        return rows.sort_values(second, ignore_index=True)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        stock, time = (k.as_py() for k in key)
        where = f"stock_id {stock}, time_id {time}"
        anchors = left.filter(left.column("_anchor"))
        names = ["stock_id", "time_id", second, *columns]
        if not anchors.num_rows:
            empty = [pa.array([], pa.int32())] * 3 + [pa.array([], pa.float64())] * len(columns)
            return pa.Table.from_arrays(empty, names=names)
        if anchors.num_rows > 1:
            raise ValueError(f"more than one index row at {where}")
        quotes = left.filter(pc.invert(left.column("_anchor")))
        book = one_per_second(quotes, book_columns, "book", where)
        trade = one_per_second(right, trade_columns, "trade", where)
        made = function(stock, time, book, trade)
        if set(made.keys()) != set(columns):
            raise ValueError(f"the function returned {sorted(made.keys())} instead of {sorted(columns)} at {where}")
        arrays = []
        for c in columns:
            values = np.asarray(made[c], dtype=np.float64)
            if values.shape != (seconds,):
                raise ValueError(f"the function returned {values.shape} values of {c} instead of {seconds} at {where}")
            arrays.append(pa.array(values))
        at = [np.full(seconds, stock, np.int32), np.full(seconds, time, np.int32), np.arange(seconds, dtype=np.int32)]
        return pa.Table.from_arrays([*map(pa.array, at), *arrays], names=names)

    return run


def bucket_udf(
    index: DataFrame, book: DataFrame, trade: DataFrame, function: BucketFunction, columns: list[str]
) -> DataFrame:
    """600 rows per indexed bucket with the function's ``columns`` as doubles."""
    rows = on_grid(book).select(*BUCKET_KEY, SECOND, *BOOK_VALUES, F.lit(False).alias("_anchor"))
    anchors = index.select(*BUCKET_KEY, F.lit(True).alias("_anchor"))
    left = rows.unionByName(anchors, allowMissingColumns=True)
    right = on_grid(trade).select(*BUCKET_KEY, SECOND, *TRADE_VALUES)
    schema = f"stock_id int, time_id int, {SECOND} int, " + ", ".join(f"`{c}` double" for c in columns)
    pairs = left.groupBy(*BUCKET_KEY).cogroup(right.groupBy(*BUCKET_KEY))
    return pairs.applyInArrow(_call(function, list(columns), SECOND, BUCKET_SECONDS), schema)
