"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that are already sorted by bucket are collected in passing, without a hash table.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Checkpoints go when nothing reads them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "volgrid", master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution on. ``settings`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="volgrid-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so every executor
    sees it. A local temporary folder is used only in local mode, where that setting may be
    unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()  # set on the context instead
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/volgrid/{name}-{uuid.uuid4().hex}"


def bound_arrow_batches(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most so many rows in this session, if they are not bounded lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and read from there.

    For reduced tables that a plan reads several times: they are computed once, and a lost
    executor does not take them along.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    return df.checkpoint()
