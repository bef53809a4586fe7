"""Benchmark passages in documents, by greedy string tiling.

1. Every five-word window of a benchmark text is a seed. One pass over the documents keeps the
   places where a document has a seed, and nothing else of it.
2. Places are joined with the seeds; a (document, test) pair is a candidate if its shared seeds
   can cover enough of the test.
3. Each candidate is tiled: the longest match that is not yet covered on either side is found by
   Karp-Rabin hashes of windows (bisecting over the length) and marked, again and again, until no
   match of five words is left. Tiles may lie in any order, so that a reordered passage counts
   as one.
4. A document is contaminated by a test of whose words tiles cover ``threshold`` or more.

Words are compared in lower case and without ASCII punctuation around them. The only seed of a
test of fewer than five words is its whole sequence, and a document that has it holds the test.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import map_texts, written

WORDS = 5
THRESHOLD = 0.5
#: Seeds that tasks hold at once (8 bytes each). More are looked for in several passes.
SEEDS_AT_ONCE = 2_000_000

_PUNCTUATION = string.punctuation.encode()
_MULTIPLIERS = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
)]
_BASE = 0x9E3779B97F4A7C55


def _bare(word: bytes) -> bytes:
    return word.strip(_PUNCTUATION)


class Words:
    """Codes of words without their punctuation; words of punctuation alone do not count."""

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words, the text that each is in, and the place where each text starts."""
        split = [[w for w in map(_bare, t.split()) if w] for t in texts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        codes = map(xxh3_64_intdigest, chain.from_iterable(split))
        h = np.fromiter(codes, dtype=np.uint64, count=int(sizes.sum())) | np.uint64(1)
        starts = np.cumsum(sizes) - sizes
        return h, np.repeat(np.arange(len(texts)), sizes), starts

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all five-word windows, the text that each is in, and its word position."""
        return self.cut(*self.words(texts), WORDS)

    @staticmethod
    def cut(h: np.ndarray, text: np.ndarray, first: np.ndarray, width: int):
        """As ``windows``, of that many words."""
        n = max(0, len(h) - width + 1)
        total = np.full(n, WORDS - width, dtype=np.uint64)  # widths differ in their codes
        for k in range(width):
            part = h[k : n + k] * _MULTIPLIERS[k]
            total += part ^ (part >> np.uint64(29))
        whole = text[:n] == text[width - 1 : n + width - 1]
        position = np.arange(n) - first[text[:n]]
        return total[whole].view(np.int64), text[:n][whole], position[whole]


def seeds_of(tests: DataFrame) -> DataFrame:
    """``item_id, n_words, seeds`` of ``tests(item_id, text)``: the window codes in order."""

    def run(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        texts = pc.utf8_lower(pc.fill_null(part.column(1), "")).cast(pa.binary()).to_pylist()
        h, text, first = words.words(texts)
        sizes = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
        seeds: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        for width in range(1, WORDS + 1):
            codes, at, _ = words.cut(h, text, first, width)
            for i in np.flatnonzero(np.minimum(sizes, WORDS) == width):
                low, high = np.searchsorted(at, [i, i + 1])
                seeds[i] = codes[low:high]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))],
            names=["item_id", "n_words", "seeds"],
        )

    rows = tests.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_texts(rows, run, "item_id long, n_words long, seeds array<long>", setup=Words).where(
        F.size("seeds") > 0
    )


def _places(docs: DataFrame, seeds: np.ndarray, widths: list[int]) -> DataFrame:
    """``doc_id, key, pos, seed``: where documents have one of the sorted ``seeds``.

    The seeds have ``widths`` words; of those of fewer than five the first place is enough.
    """

    def run(part: pa.RecordBatch, state) -> pa.RecordBatch | None:
        words, table, mask = state
        raw = pc.utf8_lower(pc.fill_null(part.column(1), "")).cast(pa.binary()).to_pylist()
        found = []
        split = words.words(raw)
        for width in widths:
            codes, text, position = words.cut(*split, width)
            maybe = np.flatnonzero(table[(codes & mask)])
            at = np.searchsorted(seeds, codes[maybe])
            at[at == len(seeds)] = 0
            hit = maybe[seeds[at] == codes[maybe]]
            if width < WORDS and len(hit):
                _, once = np.unique(np.stack([text[hit], codes[hit]]), axis=1, return_index=True)
                hit = hit[once]
            found.append((text[hit], position[hit], codes[hit]))
        rows, position, codes = (np.concatenate(x) for x in zip(*found))
        if not len(rows):
            return None
        keys = np.zeros(len(raw), dtype=np.uint64)
        for i in np.unique(rows):
            keys[i] = xxh3_64_intdigest(raw[i])
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(rows)), pa.array(keys[rows].view(np.int64)),
             pa.array(position.astype(np.int32)), pa.array(codes)],
            names=["doc_id", "key", "pos", "seed"],
        )

    def setup():
        bits = max(16, int(len(seeds)).bit_length() + 4)
        table = np.zeros(1 << bits, dtype=bool)
        mask = np.int64((1 << bits) - 1)
        table[seeds & mask] = True
        return Words(), table, mask

    return map_texts(docs, run, "doc_id long, key long, pos int, seed long", setup=setup)


def _window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of that length, modulo 2**64."""
    n = len(codes) - length + 1
    if length == 1:
        return codes.copy()
    out = np.zeros(n, dtype=np.uint64)
    # Doubling: a window of 2w is two windows of w; the binary digits of the length are added up.
    piece, width, done = codes, 1, 0
    while True:
        if length & width:
            out = out * np.uint64(pow(_BASE, width, 1 << 64)) + piece[done : done + n]
            done += width
        if 2 * width > length:
            return out
        piece = piece[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + piece[width:]
        width *= 2


def tiles(test: np.ndarray, pos: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in the test, start in the document, words)``, longest first.

    ``test`` holds the window codes of the test in order; ``pos, seeds`` the places of the
    document that have any of them, by position. A run of ``m`` equal windows is a match of
    ``m + 4`` words.
    """
    test = test.view(np.uint64)
    # The document's places as one sequence; a gap between places ends a run.
    doc, run = seeds.view(np.uint64), np.cumsum(np.diff(pos, prepend=pos[:1] - 1) != 1)
    free_test = np.ones(len(test) + WORDS - 1, dtype=bool)
    covered_doc = np.zeros(int(pos[-1]) + WORDS + 1 if len(pos) else 0, dtype=bool)
    out = []

    def matches(m: int) -> Iterator[tuple[int, int]]:
        """Free windows of ``m`` codes that both have, by place in the test."""
        if m > len(test) or m > len(doc):
            return
        words = m + WORDS - 1
        taken = np.concatenate([[0], np.cumsum(~free_test)])
        a = np.flatnonzero(taken[words:] == taken[: len(taken) - words])[: len(test) - m + 1]
        last = len(doc) - m + 1
        whole = run[:last] == run[m - 1 :]
        used = np.concatenate([[0], np.cumsum(covered_doc)])
        b = np.flatnonzero(whole & (used[pos[:last] + words] == used[pos[:last]]))
        if not len(a) or not len(b):
            return
        ha, hb = _window_hashes(test, m)[a], _window_hashes(doc, m)[b]
        order = np.argsort(hb, kind="stable")
        low = np.searchsorted(hb[order], ha, side="left")
        high = np.searchsorted(hb[order], ha, side="right")
        for i in np.flatnonzero(high > low):
            for k in range(low[i], high[i]):
                x, y = int(a[i]), int(b[order[k]])
                if (test[x : x + m] == doc[y : y + m]).all():
                    yield x, y

    longest = len(test)
    while longest:
        low, high = 0, longest  # the longest free match has a length in low..high
        while low < high:
            middle = (low + high + 1) // 2
            if next(matches(middle), None):
                low = middle
            else:
                high = middle - 1
        longest = low
        if not longest:
            break
        words = longest + WORDS - 1
        for x, y in list(matches(longest)):
            at = int(pos[y])
            if free_test[x : x + words].all() and not covered_doc[at : at + words].any():
                free_test[x : x + words] = False
                covered_doc[at : at + words] = True
                out.append((x, at, words))
    return out


def contaminated(docs: DataFrame, tests: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_words, covered, tiles, coverage``: documents that hold a test.

    One row per (doc_id, test) with the largest coverage among rows of that doc_id. Null texts
    hold nothing; tests that repeat an item_id are looked for each. Empty tables give no rows.
    Columns other than ``doc_id``, ``item_id`` and ``text`` are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = written(seeds_of(tests).withColumn("item", F.xxhash64("item_id", "seeds")), "tests").dropDuplicates(["item"])
    # With the number of their places in the test, which may repeat itself.
    seeds = items.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").agg(F.count("*").alias("times"))
    widths = [r[0] for r in items.select(F.least("n_words", F.lit(WORDS))).distinct().collect()]  # five at most
    wanted = written(seeds.select("seed").distinct(), "seeds")
    passes = max(1, -(-wanted.count() // SEEDS_AT_ONCE))
    places = None
    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("seed"), F.lit(passes)) == k)
        held = np.sort(np.array([r[0] for r in part.collect()], dtype=np.int64))  # a bounded slice
        found = _places(texts, held, sorted(widths)) if len(held) else None
        if found is not None:
            places = found if places is None else places.unionAll(found)
    if places is None:
        places = texts.sparkSession.createDataFrame([], "doc_id long, key long, pos int, seed long")
    hits = written(places.distinct(), "places")

    by_doc = ["doc_id", "key"]
    enough = F.col("shared") * WORDS >= F.lit(threshold) * F.col("n_words")
    pairs = (
        hits.select(*by_doc, "seed").distinct().join(seeds, "seed")
        .groupBy(*by_doc, "item").agg(F.sum("times").alias("shared"))
        .join(items, "item").where(enough)
    )
    # All places of one document: bounded by its own length.
    whole = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "seed"))).alias("places")
    )
    candidates = pairs.join(whole, F.expr("doc_id <=> d and key <=> k")).select(
        "doc_id", "item_id", "n_words", "seeds", F.col("places.pos").alias("pos"), F.col("places.seed").alias("found")
    )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, covered, counts = [], [], []
            for size, test, pos, found in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                test = test.values.to_numpy()
                some = np.isin(found.values.to_numpy(), test)
                n_words.append(size.as_py())
                if n_words[-1] < WORDS:  # the seed is all of it
                    covered.append(n_words[-1])
                    counts.append(1)
                    continue
                made = tiles(test, pos.values.to_numpy()[some].astype(np.int64), found.values.to_numpy()[some])
                covered.append(sum(t[2] for t in made))
                counts.append(len(made))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                 pa.array(covered, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "item_id", "n_words", "covered", "tiles"],
            )

    tiled = candidates.mapInArrow(tile, "doc_id long, item_id long, n_words long, covered long, tiles long")
    tiled = tiled.withColumn("coverage", F.col("covered") / F.col("n_words"))
    best = F.max(F.struct("coverage", "covered", "n_words", "tiles")).alias("best")
    return (
        tiled.where(F.col("coverage") >= threshold)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.n_words", "best.covered", "best.tiles", "best.coverage")
    )
