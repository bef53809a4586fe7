"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` code points is encoded in one go. A longer one is cut into overlapping
chunks, which are rows of their own and are dealt to all tasks. Each chunk is encoded with the
offsets of its boundaries; two neighbours are spliced at the first boundary that both found in
their overlap. Such a boundary is *proven* if

- it is one at which the encoding starts anew: what follows does not depend on what lies before
  (see ``segments``), so that both encodings agree from there on; and
- it lies at least ``MARGIN`` code points before the end of the left chunk, further than the
  tokenizer looks ahead, so that the cut cannot have made it.

Where two neighbours share no such boundary (one word longer than the overlap), the document is
cut again with both lengths four times as large, until every splice is proven.

Null text counts as empty (0 tokens). Rows keep their number: equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, written
from .segments import ByteCounts, byte_counts

CHUNK = 32_768
OVERLAP = 512
#: More than the tokenizer looks ahead: two characters of a contraction, one behind white space,
#: or the rest of a special string (13).
MARGIN = 16

_PIECES = "key string, no int, last int, start long, text string"
_MARKS = (
    "key string, no int, last int, head_p array<long>, head_c array<long>, "
    "tail_p array<long>, tail_c array<long>, total long"
)


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                last = max(0, (len(text) - 1) // chunk)
                for no in range(last + 1):
                    start = max(0, no * chunk - overlap)
                    part = text[start : (no + 1) * chunk + overlap if no < last else None]
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key], "no": pa.array([no], pa.int32()),
                         "last": pa.array([last], pa.int32()), "start": [start], "text": [part]}
                    )

    return run


def _mark(path: str, chunk: int, overlap: int):
    def run(part: pa.RecordBatch, coder: ByteCounts) -> pa.RecordBatch:
        out = {name: [] for name in ("head_p", "head_c", "tail_p", "tail_c", "total")}
        numbers, lasts = part.column(1).to_pylist(), part.column(2).to_pylist()
        starts, texts = part.column(3).to_pylist(), part.column(4).to_pylist()
        for no, last, start, text in zip(numbers, lasts, starts, texts):
            p, c = coder.marks(text)
            p = p + start
            # The boundary at the chunk's own start is no finding, nor is one near its end.
            head = (p <= no * chunk + overlap) & ((p > start) | (no == 0)) & (no > 0)
            end = start + len(text) - MARGIN
            cut = (no + 1) * chunk
            tail = (p >= cut - overlap) & (p <= min(cut + overlap, end)) & (no < last)
            for name, keep in (("head", head), ("tail", tail)):
                out[f"{name}_p"].append(p[keep])
                out[f"{name}_c"].append(c[keep])
            out["total"].append(int(c[-1]))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2)]
            + [pa.array(out[n], longs) for n in ("head_p", "head_c", "tail_p", "tail_c")]
            + [pa.array(out["total"], pa.int64())],
            names=["key", "no", "last", "head_p", "head_c", "tail_p", "tail_c", "total"],
        )

    return run, lambda: byte_counts(path)


def _spliced(marks: DataFrame) -> DataFrame:
    """``key, n_tokens`` per text; null where a splice is not proven."""
    chain = Window.partitionBy("key").orderBy("no")
    pairs = marks.dropDuplicates(["key", "no"]).select(
        "no", "last", "key", "head_p", "head_c", "total",
        F.lag("tail_p").over(chain).alias("left_p"),
        F.lag("tail_c").over(chain).alias("left_c"),
    )
    at = F.array_min(F.array_intersect("left_p", "head_p"))
    pairs = pairs.withColumn("at", at).withColumns(
        {
            "before": F.expr("get(left_c, cast(array_position(left_p, at) as int) - 1)"),
            "skipped": F.expr("get(head_c, cast(array_position(head_p, at) as int) - 1)"),
        }
    )
    # Tokens up to each splice in the left chunk, less those before it in the right one.
    gained = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.col("before") - F.col("skipped"))
    own = F.when(F.col("no") == F.col("last"), F.col("total")).otherwise(F.lit(0))
    proven = F.bool_and((F.col("no") == 0) | F.col("at").isNotNull())
    return pairs.groupBy("key").agg(F.when(proven, F.sum(gained + own)).alias("n_tokens"))


def huge_counts(
    texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``key, n_tokens`` of distinct ``key, text`` rows, by overlapping chunks."""
    done = None
    while True:
        pieces = texts.mapInArrow(_cut(chunk, overlap), _PIECES).repartition("key", "no")
        run, setup = _mark(path, chunk, overlap)
        counts = written(_spliced(map_texts(pieces, run, _MARKS, setup=setup)), "token-chunks")
        proven = counts.where(F.col("n_tokens").isNotNull())
        done = proven if done is None else done.unionAll(proven)
        failed = counts.where(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * 4, overlap * 4


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``path`` names the file of a byte-level tokenizer. One row out for each row in; an empty
    table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    fits = F.length("text") <= chunk

    def direct(part: pa.RecordBatch, coder: ByteCounts) -> pa.RecordBatch:
        counts = coder.counts(part.column(1).to_pylist())
        sizes = pc.cast(pc.binary_length(part.column(1)), pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column(0), sizes, pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    short = map_texts(
        rows.where(fits), direct, "doc_id long, n_bytes long, n_tokens long",
        setup=lambda: byte_counts(path),
    )
    long_rows = rows.where(~fits).withColumn("key", F.sha2("text", 256))
    counts = huge_counts(long_rows.select("key", "text"), path, chunk, overlap)
    long = long_rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key"
    ).join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionAll(long).withColumn("over_limit", F.col("n_tokens") > limit)
