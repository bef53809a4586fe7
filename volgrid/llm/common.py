"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows per Arrow batch that a text function works on at once, so that a batch of very long
#: texts stays small.
BATCH_CHARS = 1_000_000
#: Words and stretches up to this length are kept in the look-up tables of tasks.
LONGEST_KEPT = 64


#: Rows of an Arrow batch at most. With Spark's 10,000 rows of text the buffers of an executor,
#: which it keeps, grow to some hundred MB.
ROWS_PER_BATCH = 1_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in tasks, once per application.

    Needed only where neither the path of the workers nor their folder leads to it: the package
    is then sent along as an archive.
    """
    root = Path(__file__).resolve().parents[2]
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if context.applicationId in _shipped or root in [Path(p).resolve() for p in paths if p]:
        return
    archive = Path(tempfile.mkdtemp()) / "volgrid-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "volgrid").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared scratch folder and read from there.

    Cuts the lineage: later stages and lost executors read files, nothing is computed twice.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for tables that are removed when they have been read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written_at`` or a stream has made in the shared scratch folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keep_short(known: dict, found: dict) -> None:
    """Remember what was found, but no long keys, so that a table is bounded in bytes."""
    known.update((k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT)


def small_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``BATCH_CHARS`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for at, size in enumerate(sizes):
        if total and total + size > BATCH_CHARS:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, if they are not bounded lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, ROWS_PER_BATCH)


def give_back() -> None:
    """Return unused memory to the system: workers live on for the tasks after this one."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    column: str = "text",
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in small_slices(batch, column):
                out = function(part, state) if setup else function(part)
                if out is not None and out.num_rows:
                    yield out
        del state
        give_back()

    return df.mapInArrow(run, schema)


def stratum(column: str) -> Column:
    """A key for a nullable string: null is a value of its own."""
    return F.when(F.col(column).isNull(), F.lit("0")).otherwise(
        F.concat(F.lit("1"), F.col(column).cast("string"))
    )
