"""Near-duplicate documents by circulant MinHash, with exact verification.

A document is the set of its distinct five-word shingles. All signature coordinates come from
two fixed permutations of the universe of 2**32 shingle codes: the first scatters the codes, the
second is applied to them after a circular shift by 0, 1, 2, ... (the shift is what makes one
coordinate differ from the next); a coordinate is the minimum over the set.

1. Equal sets are one *node* (the smallest doc_id of theirs), so copies cost one row each.
2. Nodes that agree in a band of ``ROWS`` coordinates share a bucket. Each node is paired with
   the smallest node of each of its buckets, never with all others, and each pair is confirmed
   on the full sets.
3. Confirmed links are contracted to connected components. A bucket whose nodes now have one
   component needs no further pair. In the others, pairs of different components are looked at
   too, block against block of at most about ``BLOCK`` nodes, so that no link is lost: a task
   holds two blocks, and only links leave it.

At the similarity asked for a pair misses all bands with a probability of ``MISSED`` at most (the
number of bands follows from it); above that it falls fast. Every confirmed link is exact.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import map_texts, written

WORDS = 5
ROWS = 5
#: A link has at least so many hundredths of the union in common, if nothing else is asked for.
PERCENT = 85
#: A pair at the least similarity misses all bands with this probability at most.
MISSED = 8e-7
#: Nodes per block where blocks are compared.
BLOCK = 128
#: Pairs inside blocks are screened by their coordinates before their sets are compared; a linked
#: pair fails the screen with this probability at most.
SCREENED = 4e-6
#: Above this many rows a table of ids is joined by shuffle instead of being broadcast.
BROADCAST_IDS = 500_000
#: Shingles that are hashed at once.
AT_ONCE = 100_000



@dataclass(frozen=True)
class Search:
    """Least hundredths in common; bands; coordinates that must agree for the sets to be compared."""

    percent: int
    bands: int
    screen: int

    @property
    def coordinates(self) -> int:
        return self.bands * ROWS


def search(percent: int) -> Search:
    """The fewest bands, and the highest screen, that find links of ``percent`` or more."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be in 50..100")
    p = percent / 100
    bands = 1 if percent == 100 else math.ceil(math.log(MISSED) / math.log(1 - p**ROWS))
    n, screen, below = bands * ROWS, 0, Fraction(0)
    p = Fraction(percent, 100)
    while screen < n and (below := below + math.comb(n, screen) * p**screen * (1 - p) ** (n - screen)) <= SCREENED:
        screen += 1
    return Search(percent, bands, screen)


BANDS = search(PERCENT).bands
COORDINATES = BANDS * ROWS

_U64 = np.uint64
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _scatter(codes: np.ndarray) -> np.ndarray:
    """The first permutation, of 64-bit codes, of which the upper half is kept."""
    x = codes ^ (codes >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return (x >> _U64(32)).astype(np.uint32)


def _permute(x: np.ndarray) -> None:
    """The second permutation, of 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


class Shingles:
    """Sets of shingle hashes. Words are hashed anew each time, which is quicker than a look-up."""

    def codes(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text the hashes of its distinct shingles, sorted."""
        out = []
        for text in texts:
            words = text.lower().split()  # of bytes: A-Z and the six white spaces only
            n = len(words)
            if not n:
                out.append(np.empty(0, dtype=np.uint64))
                continue
            h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
            width = min(n, WORDS)
            total = np.full(n - width + 1, width, dtype=np.uint64)
            for k in range(width):
                part = h[k : n - width + 1 + k] * _MULTIPLIERS[k]
                total += part ^ (part >> _U64(29))
            out.append(np.unique(total))
        return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> list[bytes]:
    """Per non-empty set the lower 16 bits of each coordinate, two bytes each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    scattered = _scatter(np.concatenate(sets))
    out = np.empty((len(sets), coordinates), dtype="<u2")
    work = np.empty_like(scattered)
    for k in range(coordinates):
        np.add(scattered, np.uint32(k), out=work)
        _permute(work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return [row.tobytes() for row in out]


def _signed(docs: DataFrame, coordinates: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sig`` of every document."""

    def run(part: pa.RecordBatch, state: Shingles) -> pa.RecordBatch:
        texts = pc.fill_null(part.column(1).cast(pa.binary()), b"").to_pylist()
        sets = state.codes(texts)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sigs: list[bytes | None] = [None] * len(sets)
        group: list[int] = []
        held = 0
        for i, s in enumerate([*sets, None]):
            if s is None or held > AT_ONCE:
                if group:
                    for at, sig in zip(group, signatures([sets[g] for g in group], coordinates)):
                        sigs[at] = sig
                group, held = [], 0
            if s is not None and len(s):
                group.append(i)
                held += len(s)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sig"],
        )

    return map_texts(
        docs, run, "doc_id long, n_shingles long, digest binary, sig binary", setup=Shingles
    )


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, codes`` (bytes of the sorted hashes) of the documents that stand for ``nodes``."""
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(part: pa.RecordBatch, state: Shingles) -> pa.RecordBatch:
        texts = pc.fill_null(part.column(1).cast(pa.binary()), b"").to_pylist()
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([s.tobytes() for s in state.codes(texts)], pa.binary())],
            names=["node", "codes"],
        )

    rows = map_texts(docs.join(wanted, "doc_id", "left_semi"), run, "node long, codes binary", setup=Shingles)
    return rows.where(F.length("codes") > 0)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("codes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("codes").alias("b"))

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [
                _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(a, b)
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)``: root is the smallest node reachable.

    Alternating contraction: neighbours are moved to the smallest one around, until all edges
    end in a root. Every round is written, so that none is computed twice.
    """
    edges = written(links.where("u <> v").distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionAll(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = mark(edges)
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _block_links(members: DataFrame, hard: DataFrame, sets: DataFrame, how: Search) -> DataFrame:
    """Links between different roots inside the hard buckets, block against block.

    ``members(bucket, band, node, root, sig)``, ``hard(bucket, n)``.
    """
    rows = members.join(hard, "bucket").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    blocks = rows.groupBy("bucket", "band", "nb", "block").agg(
        F.collect_list(F.struct("node", "root", "sig", "codes")).alias("docs")
    )
    # Each block meets each other block of its bucket once.
    sent = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "bucket", "band",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        (F.col("block") <= F.col("other")).alias("is_lo"), (F.col("block") >= F.col("other")).alias("is_hi"),
        "docs",
    )
    met = sent.groupBy("bucket", "band", "lo", "hi").agg(
        F.first(F.when(F.col("is_lo"), F.col("docs")), True).alias("left"),
        F.first(F.when(F.col("is_hi"), F.col("docs")), True).alias("right"),
    ).where("left is not null and right is not null").select("band", "lo", "hi", "left", "right")

    def side(column, i):
        docs = column[i].values
        return (
            docs.field("node").to_numpy(), docs.field("root").to_numpy(),
            np.frombuffer(b"".join(docs.field("sig").to_pylist()), "<u2").reshape(-1, how.coordinates),
            [np.frombuffer(c, np.uint64) for c in docs.field("codes").to_pylist()],
        )

    def run(batches):
        for batch in batches:
            u, v = [], []
            for i in range(batch.num_rows):
                band = batch.column(0)[i].as_py()
                node_a, root_a, sig_a, codes_a = side(batch.column(3), i)
                node_b, root_b, sig_b, codes_b = side(batch.column(4), i)
                same = batch.column(1)[i].as_py() == batch.column(2)[i].as_py()
                size_b = np.array([len(c) for c in codes_b])
                for x in range(len(node_a)):
                    agree = sig_a[x] == sig_b
                    fits = (root_b != root_a[x]) & (agree.sum(axis=1) >= how.screen)
                    small, large = np.minimum(size_b, len(codes_a[x])), np.maximum(size_b, len(codes_a[x]))
                    fits &= 100 * small >= how.percent * large
                    # A pair is looked at in the first band that both share.
                    fits &= ~agree.reshape(len(node_b), how.bands, ROWS).all(axis=2)[:, :band].any(axis=1)
                    if same:
                        fits[: x + 1] = False
                    for y in np.flatnonzero(fits):
                        if _linked(codes_a[x], codes_b[y], how.percent):
                            u.append(node_a[x])
                            v.append(node_b[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]
            )

    return met.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Links have ``percent`` hundredths of their shingles in common or more.

    ``component_id`` is the smallest doc_id that links lead to, ``kept`` whether it is the row's
    own. Documents without words (null, empty, white space) link with nothing and are kept; one
    with fewer than five words has its whole sequence as its only shingle. Texts of
    one doc_id share its component; where they are to be told apart, they need ids of their own. A row without doc_id takes part
    through an equal set that has one; else its component is null and it is kept. An empty table
    gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    how = search(percent)
    signed = written(_signed(texts, how.coordinates), "signatures")
    nodes = written(
        signed.where("digest is not null")
        .groupBy("digest", "sig")
        .agg(F.min("doc_id").alias("node"))
        .where("node is not null"),
        "nodes",
    )
    width = 2 * ROWS
    in_bands = nodes.select(
        "node",
        F.posexplode(
            F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(how.bands)])
        ).alias("band", "bucket"),
    )
    shared = in_bands.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = written(in_bands.join(shared, "bucket"), "members")
    stars = written(
        members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(),
        "stars",
    )
    sets = written(_sets(texts, members.select("node")), "sets")
    links = written(_confirmed(stars, sets, percent), "star-links")
    found = components(links)

    known = written(
        members.join(found, "node", "left").select(
            "bucket", "band", "node", F.coalesce("root", "node").alias("root")
        ),
        "members",
    )
    hard = written(
        known.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
        .where("n > 2 and x <> y")
        .select("bucket", "n"),
        "hard",
    )
    signed_nodes = nodes.select("node", "sig")
    more = written(_block_links(known.join(signed_nodes, "node"), hard, sets, how), "block-links")
    if not more.isEmpty():
        found = components(links.unionAll(more))

    by_set = nodes.join(found, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("component_id")
    )
    rows = signed.join(by_set, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return rows.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )
