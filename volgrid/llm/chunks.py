"""Repeated passages by content-defined chunks.

*Borders.* A gear hash rolls over the bytes: each byte adds a random value and doubles what came
before, so the hash depends on the last ``REACH`` bytes alone. The position with the smallest hash of
every ``SPAN`` positions in a row is a border. Borders so follow content and move along with it: an
insertion changes those around it and no others, and no two are more than ``SPAN`` bytes apart.

*Chunks.* The bytes between two borders are a variable chunk. Chunks are deduplicated by the digest of
a chunk and the one after it, some 55 bytes, since single ones are so short that common phrases
repeat them. The smallest doc_id that has a digest keeps the chunk; in other documents it is a repeat.

*Passages.* Repeats that touch or overlap are a passage. It is reported if it may have more than
``WORDS`` words: those of its chunks, and those within ``MARGIN`` bytes at either end, as a passage
begins and ends between borders. What two documents share of ``5 * SPAN + REACH`` bytes or more
always has a chunk; of shorter ones (51 words of one or two letters) most do. On 10,000 documents 1,199
of the 1,200 with 51 words of an earlier one are found, and 158 others, of which 149 share 30 or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import map_texts, written

#: Positions in a row of which one is a border.
SPAN = 54
#: Bytes that the hash looks back.
REACH = 16
#: Positions that are hashed at once.
AT_ONCE = 1 << 20
#: Passages of more words are reported.
WORDS = 50
#: Bytes at either end of a passage that its repeated chunks may not reach.
MARGIN = REACH + SPAN
#: Chunks whose digest is compared.
TOGETHER = 2

#: A random value per byte, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20_240_101)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: White space between words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: How the measures of a chunk are packed into one long: name and bits.
_NONE = np.int64(-(1 << 63))
_PACKED = (("start", 31), ("size", 8), ("step_words", 6), ("words", 6), ("left", 6), ("right", 6))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash behind each byte from the ``REACH``-th on: the sum of ``GEAR[byte] << bytes since``."""
    h = GEAR[data]
    width = 1
    # Doubling: the sum over 2w bytes is that over the last w, and that over the w before, shifted.
    while width < REACH:
        if len(h) > width:
            h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h[REACH - 1 :]


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` values in a row."""
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _thinned(at: np.ndarray, value: np.ndarray, span: int) -> np.ndarray:
    """Without most of the borders of a text that repeats one word for ever.

    Equal hashes at equal distances have the same bytes between them, so of these every one that
    is about ``span`` after the one before will do: chunks are the same wherever counting begins.
    """
    gap, same = np.diff(at), value[1:] == value[:-1]
    inside = np.zeros(len(at), dtype=bool)
    inside[1:-1] = same[:-1] & same[1:] & (gap[:-1] == gap[1:])
    places = np.arange(len(at))
    since = places - np.maximum.accumulate(np.where(inside, 0, places))
    every = np.ones(len(at), dtype=np.int64)
    every[1:] = np.maximum(1, span // gap)
    return at[~inside | (since % every == 0)]


def borders(data: bytes, span: int = SPAN) -> np.ndarray:
    """Ends of the chunks of ``data`` in order; the last one is its length. None of an empty text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) - REACH + 1
    found = [np.array([len(raw)][: len(raw)], dtype=np.int64)]
    for begin in range(0, max(0, n - span + 1), AT_ONCE):
        h = gear_hashes(raw[begin : begin + AT_ONCE + span - 1 + REACH - 1])
        least = _least(h, span)
        # A position is a border if a stretch that it is in has no smaller hash: if the largest of
        # the minima of these stretches is its own.
        edge = np.zeros(span - 1, dtype=np.uint32)
        best = ~_least(~np.concatenate([edge, least, edge]), span)
        at = np.flatnonzero(best == h)
        found.append(begin + _thinned(at, h[at], span) + REACH)
    return np.unique(np.concatenate(found))


def chunk_rows(data: bytes, span: int = SPAN) -> tuple[np.ndarray, list[int]]:
    """The measures of each chunk with its followers, packed, and their digests.

    ``start``; ``size`` in bytes; words that begin before the next chunk starts, and before the end;
    words that begin within ``MARGIN`` bytes before the start and behind the end.
    """
    ends = borders(data, span)
    if not len(ends):
        return np.empty(0, dtype=np.int64), []
    cuts = np.concatenate([[0], ends])
    last = max(1, len(cuts) - TOGETHER)
    start, following = cuts[:last], cuts[1 : last + 1]
    end = cuts[TOGETHER : last + TOGETHER] if len(cuts) > TOGETHER else cuts[-1:]
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    begins = ~space
    begins[1:] &= space[:-1]
    before = np.concatenate([[0], np.cumsum(begins)])  # words that begin before each place
    size = len(data)
    measures = (
        start, end - start, before[following] - before[start], before[end] - before[start],
        before[start] - before[np.maximum(start - MARGIN, 0)], before[np.minimum(end + MARGIN, size)] - before[end],
    )
    packed = np.zeros(len(start), dtype=np.int64)
    for (_, bits), values in zip(_PACKED, measures):
        packed = packed << bits | np.minimum(values, (1 << bits) - 1)
    return packed, [xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]


def chunked(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc, packed, digest`` of every chunk; ``doc`` is the doc_id. Without one it is a hash of the
    text, and ``packed`` is negative."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, measures, digests = [], [], [], []
        for doc, data in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            packed, found = chunk_rows(data or b"", span)
            if not found:
                continue
            ids.append(xxh3_64_intdigest(data) - (1 << 63) if doc is None else doc)
            counts.append(len(found))
            # The sign tells that there is no doc_id.
            measures.append(packed | _NONE if doc is None else packed)
            digests += found
        rows = np.repeat(np.arange(len(ids)), counts) if ids else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, dtype=np.int64)[rows]),
             pa.array(np.concatenate(measures) if measures else np.empty(0, np.int64)),
             pa.array(np.array(digests, dtype=np.uint64).view(np.int64))],
            names=["doc", "packed", "digest"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, run, "doc long, packed long, digest long")


def _unpacked(name: str):
    below = sum(bits for _, bits in _PACKED[[n for n, _ in _PACKED].index(name) + 1 :])
    return F.shiftright("packed", below).bitwiseAND(F.lit((1 << dict(_PACKED)[name]) - 1).cast("long"))


def repeated_passages(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """``doc_id, start, end, n_chunks, n_words, first_doc_id``: passages that an earlier document has.

    Positions are UTF-8 bytes, the end exclusive, of the chunks that repeat: all of it is repeated,
    and up to ``MARGIN`` bytes more may be at either end. ``n_words`` is the most words that it may
    have, ``first_doc_id`` the document that keeps most of its chunks. Repeats within one document
    are not reported. Null and empty texts have no passage. Rows without doc_id are compared with
    documents that have one; rows that repeat a doc_id are one document. An empty table gives no
    rows. Other columns are not looked at.
    """
    found = written(chunked(docs, span), "chunks")
    # One row a digest and task after partial aggregation.
    none = F.col("packed") < 0
    known = F.when(~none, F.col("doc"))
    many = (
        found.groupBy("digest")
        .agg(F.min(known).alias("first"), F.max(known).alias("last"), F.bool_or(none).alias("more"))
        .where("first IS NOT NULL AND (last > first OR more)")
        .select("digest", "first")
    )
    repeats = found.join(many, "digest").where("packed < 0 OR doc <> first").select(
        "doc", none.alias("none"), "first", *[_unpacked(n).alias(n) for n, _ in _PACKED]
    )
    inside = Window.partitionBy("doc", "none").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    marked = repeats.withColumns(
        {"end": end, "next": F.lead("start").over(inside), "reach": F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))}
    ).withColumn("new", F.coalesce((F.col("reach") < F.col("start")).cast("int"), F.lit(1)))
    runs = marked.withColumns(
        {
            "run": F.sum("new").over(inside),
            # Words up to where the next repeat of the passage takes over.
            "counted": F.when(F.col("next") < F.col("end"), F.col("step_words")).otherwise(F.col("words")),
        }
    )
    return (
        runs.groupBy("doc", "none", "run", "first")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sum("counted").alias("counted"),
            F.min(F.struct("start", "left")).alias("opens"), F.max(F.struct("end", "right")).alias("closes"),
        )
        .groupBy("doc", "none", "run")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_chunks"),
            (F.sum("counted") + F.min("opens")["left"] + F.max("closes")["right"]).alias("n_words"),
            F.max(F.struct("n", "first")).getField("first").alias("first_doc_id"),
        )
        .where(F.col("n_words") > words)
        .select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "start", "end", "n_chunks", "n_words", "first_doc_id")
    )
