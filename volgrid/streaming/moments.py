"""Normalization statistics over rows that keep arriving.

Each task sums up its rows of a micro-batch to one row of moments per feature; the state of a
feature holds what has arrived so far and merges these rows. Every trigger appends the new
statistics of all features to a table, so statistics of any time can be looked up, and a run that
starts again from its checkpoint goes on with the stored state. Shuffled are ``features`` rows a
task, whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.moments import MOMENTS
from ..schemas import FEATURES
from .scoring import read_sample_stream

STATE = "version long, rows long, n long, mean double, m2 double"
RESULT = f"{MOMENTS}, version long"
_RESULT_COLUMNS = ["feature", "rows", "n", "mean", "m2", "version"]

Part = tuple[int, int, float, float]


def merged(a: Part, b: Part) -> Part:
    """Two parts as one: means by weight, deviations plus that between the means."""
    rows, n = a[0] + b[0], a[1] + b[1]
    if not a[1] or not b[1]:
        return (rows, n, *(a if a[1] else b)[2:])
    off = b[2] - a[2]
    return rows, n, a[2] + off * b[1] / n, a[3] + b[3] + off * off * a[1] * b[1] / n


def read_row_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Rows of Parquet files as they arrive, however old the files are."""
    return read_sample_stream(spark, path, schema, files_per_trigger)


def _partial(columns: list[str]):
    """Arrow-batch function: the moments of a task's rows, one row per feature."""

    def moments(values: np.ndarray) -> Part:
        seen = values[~np.isnan(values)]
        if not len(seen):
            return len(values), 0, 0.0, 0.0
        mean = seen.mean()
        return len(values), len(seen), float(mean), float(((seen - mean) ** 2).sum())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(0, 0, 0.0, 0.0)] * len(columns)
        for batch in batches:
            arrays = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
            held = [merged(part, moments(a)) for part, a in zip(held, arrays)]
        if held[0][0]:
            out = [pa.array(columns), *(pa.array(v) for v in zip(*held))]
            yield pa.RecordBatch.from_arrays(out, names=["feature", "rows", "n", "mean", "m2"])

    return run


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, *rest = state.get if state.exists else (0, 0, 0, 0.0, 0.0)
    part: Part = tuple(rest)
    for frame in frames:
        for new in zip(*(frame[c].tolist() for c in ("rows", "n", "mean", "m2"))):
            part = merged(part, new)
    state.update((version + 1, *part))
    yield pd.DataFrame([(key[0], *part, version + 1)], columns=_RESULT_COLUMNS)


def moment_stream(
    rows: DataFrame, path: str, checkpoint: str, columns: list[str] = FEATURES, available_now: bool = False
) -> StreamingQuery:
    """Append the moments of all rows so far to ``path`` at every trigger."""
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = values.mapInArrow(_partial(columns), MOMENTS)
    totals = parts.groupBy("feature").applyInPandasWithState(
        _update, RESULT, STATE, "append", GroupStateTimeout.NoTimeout
    )
    writer = totals.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def latest_moments(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its moments as of the last trigger that had rows."""
    seen = spark.read.schema(RESULT).parquet(path)
    last = F.max_by(F.struct("rows", "n", "mean", "m2"), "version").alias("v")
    return seen.groupBy("feature").agg(last).select("feature", "v.*")
