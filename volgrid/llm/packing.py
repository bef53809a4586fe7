"""Best-two-fit packing of documents into sequences.

1. Every text is encoded in tasks and cut into pieces of at most ``capacity`` tokens.
2. Pieces are counted by length: at most ``capacity`` numbers, whatever the size of the corpus.
3. The packing is found on these counts. A sequence is opened with the longest piece left and
   filled greedily with the longest that fits. Then its smallest piece is replaced by two
   unpacked ones that fit the gap (enlarged by that piece) more tightly, while that helps.
   The same filling is repeated as often as the counts allow; each one exhausts a length, so
   that the number of distinct fillings is bounded by the capacity, not by the corpus.
4. Pieces are numbered within their length, in parallel, and read their place from the list of
   fillings. A length that a third of all pieces have is numbered in many small buckets.

Null text is an empty document: one piece with the end mark alone. Equal rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, written
from .segments import WordIds, word_ids

CAPACITY = 4096
END_ID = 1
#: Pieces that are numbered by one window.
PER_BUCKET = 50_000
#: A text is encoded in slices of about so many code points, cut at white space.
SLICE = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _slices(text: str):
    """The text in slices that end before a space or line end, where no token can span."""
    start = 0
    while len(text) - start > SLICE:
        cut = max(text.rfind(" ", start + 1, start + SLICE), text.rfind("\n", start + 1, start + SLICE))
        if cut < 0:
            later = [p for p in (text.find(" ", start + SLICE), text.find("\n", start + SLICE)) if p > 0]
            if not later:
                break
            cut = min(later)
        yield text[start:cut]
        start = cut
    yield text[start:]


def _id_blocks(texts: list[str], coder: WordIds):
    """Per text its ids, as one or several blocks of bytes."""
    short = [t for t in texts if len(t) <= SLICE]
    encoded = iter(coder.encode(short))
    for text in texts:
        yield [next(encoded)] if len(text) <= SLICE else (coder.encode([s])[0] for s in _slices(text))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents, cut where too long."""
    end = np.uint32(END_ID).astype("<u4").tobytes()
    width = 4 * capacity

    def cut(part: pa.RecordBatch, coder: WordIds) -> pa.RecordBatch:
        ids, numbers, starts, lengths, sums = [], [], [], [], []
        documents = part.column(0).to_pylist()
        texts = [t or "" for t in part.column(1).to_pylist()]
        for doc, blocks in zip(documents, _id_blocks(texts, coder)):
            rest, number = b"", 0

            def add(block: bytes) -> None:
                nonlocal number
                ids.append(doc)
                numbers.append(number)
                starts.append(number * capacity)
                lengths.append(len(block) // 4)
                sums.append(zlib.crc32(block))
                number += 1

            for block in blocks:
                rest += block
                while len(rest) > width:
                    add(rest[:width])
                    rest = rest[width:]
            rest += end
            if len(rest) > width:
                add(rest[:width])
                rest = rest[width:]
            add(rest)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
             pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, cut, _PIECES, setup=lambda: word_ids(path))


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on counts by length: (lengths in one sequence, number of such sequences)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    out: list[tuple[tuple[int, ...], int]] = []

    def longest() -> np.ndarray:
        """By room: the longest piece left that fits, 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    fit = longest()
    while fit[capacity]:
        took: list[int] = []
        gap = capacity

        def take(length: int) -> None:
            nonlocal gap, fit
            took.append(length)
            gap -= length
            left[length] -= 1
            if not left[length]:
                fit = longest()

        while gap and fit[gap]:
            take(int(fit[gap]))
        while gap and len(took) > 1:
            smallest = min(took)
            room = gap + smallest
            first = sizes[1:room][left[1:room] > 0]
            if not len(first):
                break
            second = fit[room - first]
            # Two of one length need two pieces of it.
            alone = (second == first) & (left[first] < 2)
            for at in np.flatnonzero(alone):
                below = np.flatnonzero(left[1 : first[at]] > 0)
                second[at] = below[-1] + 1 if len(below) else 0
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            took.remove(smallest)
            left[smallest] += 1
            gap += smallest
            take(int(first[best]))
            take(int(second[best]))
            fit = longest()
        uses: dict[int, int] = {}
        for length in took:
            uses[length] = uses.get(length, 0) + 1
        more = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= more * n
        if more:
            fit = longest()
        out.append((tuple(sorted(took, reverse=True)), 1 + more))
    return out


def _places(packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per filling and length: the ranks it takes, and where they go. Sorted by length, rank."""
    rows, used, sequence = [], {}, 0
    for lengths, n in packed:
        offset, at = 0, 0
        while at < len(lengths):
            length, uses = lengths[at], lengths.count(lengths[at])
            rows.append((length, used.get(length, 0), uses, sequence, offset))
            used[length] = used.get(length, 0) + n * uses
            offset += uses * length
            at += uses
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "uses", "sequence", "offset"), table.T.copy()))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``.

    ``path`` names the file of a word tokenizer. Sequences are numbered from 0.
    """
    cut = written(pieces(docs, path, capacity), "pieces")
    # Bounded by the capacity: one number per length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(fillings(counts, capacity))

    buckets = [1] * (capacity + 1)
    for length, n in counts.items():
        buckets[length] = -(-n // PER_BUCKET)
    share = F.get(F.lit(buckets), F.col("length").cast("int")) if max(buckets) > 1 else F.lit(1)
    keyed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), share))
    before = (
        keyed.groupBy("length", "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n"),
        )
        .drop("_n")
    )
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_b"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_in") + F.col("_before")).alias("rank")
    )
    keys = places["length"] * (1 << 48) + places["rank"] if len(places["length"]) else None

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            within = rank - places["rank"][at]
            sequence = places["sequence"][at] + within // places["uses"][at]
            offset = places["offset"][at] + within % places["uses"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
