"""Request and synthetic sample sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BUCKET_SECONDS, REQUEST_BODY

#: Matrices per Arrow batch that the generator returns: 600 x 14 floats each, so about 9 MB.
MATRICES_AT_ONCE = 256


def parse_json_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Replace the JSON text ``{"x": [[[...]]]}`` by the tensor ``x``; null if malformed."""
    parsed = F.from_json(F.col(body), REQUEST_BODY)
    others = [c for c in df.columns if c != body]
    return df.select(*others, parsed["x"].alias("x"))


def encode_json_responses(answers: DataFrame) -> DataFrame:
    """``response``: ``{"y": [...]}`` for an answered request, ``{"error": ...}`` otherwise."""
    text = F.when(F.col("error").isNull(), F.to_json(F.struct("y"))).otherwise(
        F.to_json(F.struct("error"))
    )
    return answers.withColumn("response", text).drop("y", "error")


def _normal_matrices(seconds: int, features: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = MATRICES_AT_ONCE
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                keys = piece.column(piece.schema.get_field_index("_key")).to_numpy().view(np.uint64)
                cells = np.empty((len(keys), seconds * features), dtype=np.float32)
                for i, key in enumerate(keys):
                    random = np.random.Generator(np.random.Philox(key=[key, np.uint64(seed)]))
                    random.standard_normal(out=cells[i], dtype=np.float32)
                lines = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), features)
                lines = lines.cast(pa.list_(pa.float32()))
                ends = np.arange(0, len(keys) * seconds + 1, seconds, dtype=np.int32)
                x = pa.ListArray.from_arrays(pa.array(ends), lines)
                names = [n for n in piece.schema.names if n != "_key"]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(piece.schema.get_field_index(n)) for n in names], x], [*names, "x"]
                )

    return run


def synthetic_samples(
    keys: DataFrame, features: int, seconds: int = BUCKET_SECONDS, seed: int = 0
) -> DataFrame:
    """One ``x`` of standard normal values, [seconds, features], per row of ``keys``.

    Values come from a counter-based generator keyed by the row, so that a repeated task makes
    the same ones. A short key becomes thousands of values: keys are spread over all partitions.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By the hash, not by the columns: keys that are placed by these already, as after ``distinct``,
    # would stay in the few tasks that their size asks for.
    keyed = keys.withColumn("_key", F.xxhash64(*keys.columns)).repartition(partitions, "_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keyed.mapInArrow(
        _normal_matrices(seconds, features, seed), f"{fields}, x array<array<float>>"
    )
