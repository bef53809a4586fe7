"""Exact k-means over integer vectors, with heap-ordered bounds.

Vectors are kept in blocks of ``BLOCK`` rows, one table row a block, with the state of each
cluster next to them: a heap of (gap, vector). The gap of a vector is its distance to the second
nearest centroid less that to its own, as of its last scan. When centroids move, an own distance
grows and another shrinks by at most what the two centroids moved, so the gap of every vector of
a cluster shrinks by at most the cluster's *drift*: its own move and the largest move of another.
Drifts add up from round to round, and a gap is stored plus the drift at the time of its scan.
A vector can only have changed its cluster if its stored gap is not above the drift of now. These
lie at the top of the heap: they are popped, compared with all centroids in exact integers, and
pushed again. All others are not looked at.

A pass over the blocks returns the sums of vectors that changed their cluster, which Spark adds
up; ``k`` sums come to the driver, which holds the ``k`` centroids. Each pass writes the blocks
anew and the table before it is removed, so a lost executor repeats single blocks of one pass and
two copies of the vectors are the most on disk. No row depends on a key, so nothing can be skewed.

Vectors that are null, of another length, or hold a null or non-finite component are left out.
Rows that repeat a vec_id are vectors of their own; a null vec_id seeds like the empty string.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no
rows. Distances beyond a long are given as its largest value. The passes run when the function
is called. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, written_at

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
#: Vectors in a block: half a megabyte of 64 floats.
BLOCK = 2048
#: Gaps are rounded; a gap so close to the drift (relative to both) counts as expired.
SLACK = 1e-9
#: Scaled components below this have squared distances that an int64 holds.
SAFE = 2**27
LONGEST = 2**63 - 1

_STATE = "ids array<bigint>, x binary, cluster binary, sizes array<int>, gaps binary, members binary"
_MOVED = "moved array<struct<cluster:int,part:int,limb:int,value:bigint>>"
_STRUCT = pa.struct([("cluster", pa.int32()), ("part", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as int64, or as Python integers where squares would not fit."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def _fitting(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in one type in which their squared distances are exact."""
    if x.dtype == object or any(abs(v) >= SAFE for c in centroids for v in c):
        return x.astype(object), np.array(centroids, dtype=object)
    return x, np.array(centroids, dtype=np.int64)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [rows, centroids]."""
    out = np.empty((len(x), len(centroids)), dtype=x.dtype)
    for j, c in enumerate(centroids):
        apart = x - c
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def _roots(squares: np.ndarray) -> np.ndarray:
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(v) if v < 2**1000 else math.inf for v in squares.tolist()])


def _scan(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number among equals) and its gap."""
    squares = _squared(*_fitting(x, centroids))
    best = squares.argmin(axis=1).astype(np.int32)
    if len(centroids) == 1:
        return best, np.full(len(x), np.inf)
    rows = np.arange(len(x))
    upper = _roots(squares[rows, best])
    others = squares.copy()
    others[rows, best] = squares.max() + 1
    with np.errstate(invalid="ignore"):
        gaps = _roots(others.min(axis=1)) - upper
    # Beyond the range of doubles no gap is known: such vectors are scanned each time.
    return best, np.where(np.isnan(gaps), -np.inf, gaps)


def advance(
    x: np.ndarray,
    cluster: np.ndarray,
    heaps: list[list[tuple[float, int]]],
    centroids: list[list[int]],
    drift: list[float],
) -> np.ndarray:
    """Bring ``cluster`` and ``heaps`` of one block up to date; return the rows looked at.

    ``cluster`` is -1 for rows not scanned yet, which are in no heap.
    """
    expired = np.flatnonzero(cluster < 0).tolist()
    for heap, total in zip(heaps, drift):
        limit = total + SLACK * (1 + total)
        while heap and heap[0][0] <= limit:
            expired.append(heapq.heappop(heap)[1])
    rows = np.array(expired, dtype=np.int64)
    if len(rows):
        cluster[rows], gaps = _scan(x[rows], centroids)
        for row, j, gap in zip(expired, cluster[rows].tolist(), gaps.tolist()):
            due = gap + drift[j]
            # Without a number to compare with, the vector is looked at each time.
            heapq.heappush(heaps[j], (due if due == due else -math.inf, row))
    return rows


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in base 2^32, so that sums of any size are sums of longs."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & 0xFFFFFFFF)
        value >>= 32
        limb += 1


def _moves(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """Changes of each cluster's component sums, and of its count (part ``width``)."""
    out = []
    for j in np.union1d(before, after):
        if j < 0:
            continue
        came, went = (after == j) & (before != j), (before == j) & (after != j)
        sums = [*(x[came].sum(axis=0) - x[went].sum(axis=0)).tolist(), int(came.sum() - went.sum())]
        for part, value in enumerate(sums):
            out += [{"cluster": int(j), "part": part, "limb": n, "value": v} for n, v in _limbs(int(value))]
    return out


def _heaps(batch: pa.RecordBatch, at: int) -> list[list[tuple[float, int]]]:
    gaps = np.frombuffer(batch["gaps"][at].as_py(), dtype="<f8").tolist()
    members = np.frombuffer(batch["members"][at].as_py(), dtype="<i4").tolist()
    out, start = [], 0
    for size in batch["sizes"][at].as_py():
        out.append(list(zip(gaps[start : start + size], members[start : start + size])))
        start += size
    return out


def _blocks(rows: DataFrame, k: int, width: int, kind: str) -> DataFrame:
    """The vectors in blocks, none assigned yet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                yield _block(part.column(0), x.tobytes(), np.full(part.num_rows, -1), [[] for _ in range(k)])

    return rows.mapInArrow(run, _STATE)


def _block(ids, x: bytes, cluster: np.ndarray, heaps: list, moved: list | None = None) -> pa.RecordBatch:
    entries = [e for heap in heaps for e in heap]
    columns = {
        "ids": pa.array([ids.to_pylist() if isinstance(ids, pa.Array) else ids], pa.list_(pa.int64())),
        "x": pa.array([x], pa.binary()),
        "cluster": pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
        "sizes": pa.array([[len(h) for h in heaps]], pa.list_(pa.int32())),
        "gaps": pa.array([np.array([g for g, _ in entries], dtype="<f8").tobytes()], pa.binary()),
        "members": pa.array([np.array([m for _, m in entries], dtype="<i4").tobytes()], pa.binary()),
    }
    if moved is not None:
        columns["moved"] = pa.array([moved], pa.list_(_STRUCT))
    return pa.RecordBatch.from_pydict(columns)


def _assign(blocks: DataFrame, centroids: list[list[int]], drift: list[float], kind: str, scale: int, last: bool):
    """One pass: blocks with ``moved``, or with ``last`` a row per vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                raw = batch["x"][at].as_py()
                x = scaled(np.frombuffer(raw, dtype=kind).reshape(-1, len(centroids[0])), scale)
                cluster = np.frombuffer(batch["cluster"][at].as_py(), dtype="<i4").copy()
                before, heaps = cluster.copy(), _heaps(batch, at)
                advance(x, cluster, heaps, centroids, drift)
                ids = batch["ids"][at].as_py()
                if not last:
                    yield _block(ids, raw, cluster, heaps, _moves(x, before, cluster))
                    continue
                fit, all_centroids = _fitting(x, centroids)
                apart = fit - all_centroids[cluster]
                distance = [min(int(d), LONGEST) for d in (apart * apart).sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    schema = "vec_id bigint, cluster int, distance bigint" if last else f"{_STATE}, {_MOVED}"
    return blocks.select(*T.StructType.fromDDL(_STATE).names).mapInArrow(run, schema)


def whole_vectors(vectors: DataFrame, width: int = WIDTH, column: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows whose vector has ``width`` components, all finite."""
    kind = vectors.schema[column].dataType.elementType
    x = F.col(column) if isinstance(kind, T.FloatType) else F.col(column).cast("array<double>")
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    return rows.where((F.size("x") == width) & whole)


def seeds(rows: DataFrame, k: int = CLUSTERS, scale: int = SCALE) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of their vec_id, in that order.

    Only rows below a share of the hash range are sorted, so that what single tasks send does not
    grow with their number; the share grows until it holds enough rows.
    """
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32
    share = 4 * k / max(1, rows.count())
    while True:
        first = rows.withColumn("h", h).where(place < share).orderBy("h", "x").limit(k).collect()
        if len(first) == k or share >= 1:
            return [[int(v) for v in scaled(np.array(r["x"]), scale)] for r in first]
        share *= 8


def centroid_clusters(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    column: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per whole vector."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, width, column)
    kind = "<f4" if isinstance(rows.schema["x"].dataType.elementType, T.FloatType) else "<f8"
    centroids = seeds(rows, k, scale)
    if not centroids:
        schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    n = len(centroids)
    blocks, folder = _blocks(rows, n, width, kind), None
    totals = [[0] * (width + 1) for _ in range(n)]
    drift = [0.0] * n
    for _ in range(rounds):
        blocks, path = written_at(_assign(blocks, centroids, drift, kind, scale, last=False), "centroid-blocks")
        if folder:
            remove(spark, folder)
        folder = path
        changes = blocks.select(F.explode("moved").alias("m")).groupBy("m.cluster", "m.part", "m.limb")
        # At most n * (width + 1) sums, whatever the number of vectors.
        for r in changes.agg(F.sum("m.value").alias("value")).collect():
            totals[r["cluster"]][r["part"]] += r["value"] << (32 * r["limb"])
        moved = [[s // sums[-1] for s in sums[:-1]] if sums[-1] else c for sums, c in zip(totals, centroids)]
        steps = [
            math.sqrt(d) if (d := sum((a - b) ** 2 for a, b in zip(old, new))) < 2**1000 else math.inf
            for old, new in zip(centroids, moved)
        ]
        for j in range(n):
            drift[j] += steps[j] + max((s for i, s in enumerate(steps) if i != j), default=0.0)
        centroids = moved
    assigned, _ = written_at(_assign(blocks, centroids, drift, kind, scale, last=True), "centroid-rows")
    if folder:
        remove(spark, folder)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    named = [
        (j, min(s, LONGEST), min(sum(inertia.values()), LONGEST), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for j, s in sorted(inertia.items())
    ]
    # One row a cluster.
    small = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = assigned.join(F.broadcast(small), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
