"""Interactions of five filters, kept up to date by a stream that can take back what it counted.

Filters (a document *fails* one if its condition holds): A under 200 words; B fewer distinct words
than half of all; C more than 2 percent capitals A-Z; D a character of ``#$%&*|``; E the text is
that of a smaller doc_id. Failures are bits of a mask, A lowest.

1. Files arrive in micro-batches. Each text becomes its mask without E and a 128-bit digest, and is
   not shuffled; flags come from the labels.
2. Rows of one text are summed up in each task before the shuffle by digest, so a text that a third
   of all documents have sends a few rows a task.
3. The state holds each text's smallest doc_id so far and what was counted for it. When a smaller
   one arrives, the earlier count without E is retracted and counted again with E. Texts are keyed
   by a range of their digest; the number of ranges follows the number of rows of the first run,
   so that a key has about ``TEXTS_PER_KEY`` texts, and calls of Python are few.
4. Gains and losses of the counters (part, mask, flags) are appended to a table, summed up per key
   and micro-batch; their sum is the count over all documents, whatever the order of arrival.
5. All orders of the filters are read from the at most 32 counters of each part.

Null text counts as empty. A null doc_id is neither smaller than another nor larger, so it never
fails E. Rows that repeat a doc_id with the same text are first together. Labels that disagree on
one doc_id count where any of them does. A null source is the part ''. An empty table gives no
rows. Other columns are not looked at.

The stream runs when the function is called. Its progress, state and counters are in the shared
scratch folder: a lost executor repeats single tasks of one micro-batch, a batch is committed
whole, and all is removed when the counters have been summed up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from .common import exists, map_texts, remove, ship, written, written_at

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
REPEATED = 1 << FILTERS.index("E")
#: Flags of a document in the counters.
GOOD, TOXIC = 1, 2
#: The files of a run are dealt to about so many micro-batches.
BATCHES = 4
#: Distinct texts that a task sums up before it sends them on.
PER_TASK = 100_000
#: Texts of one key of the state: some 15 kB.
TEXTS_PER_KEY = 256
#: State on the executors' disks, with bounded memory, few files and a small copy of each batch's
#: changes in the scratch folder.
_STORE = "spark.sql.streaming.stateStore"
SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}

_SEEN = "doc_id long, part string, mask int, digest binary, spread long"
_SUMMED = "key int, digest binary, part string, flags int, mask int, doc_id long, first long, rows long"
#: Texts with their smallest doc_id, and what is counted for each: the text's place, part, flags
#: and number of rows.
_STATE = (
    "digests array<binary>, least array<long>, "
    "texts array<int>, parts array<string>, flags array<int>, counts array<long>"
)
_CHANGE = "part string, mask int, flags int, change long"


def text_mask(text: bytes) -> int:
    """The failure bits A to D of a UTF-8 text."""
    # Without arguments bytes are split at exactly the white space that words end at.
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    # Code points: all bytes but continuation bytes.
    length = len(text.translate(None, bytes(range(0x80, 0xC0))))
    fails = (n < LEAST_WORDS, 100 * len(set(words)) < 50 * n, 100 * capitals > 2 * length, symbols)
    return sum(bit << i for i, bit in enumerate(fails))


def _seen(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest, spread`` per document; ``spread`` is 0 where doc_id is set."""

    def run(part: pa.RecordBatch, counter: list[int]) -> pa.RecordBatch:
        texts = [t or b"" for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
        spread = []
        for known in part.column(0).is_valid().to_pylist():
            counter[0] += 1
            spread.append(0 if known else counter[0])
        return pa.RecordBatch.from_arrays(
            [part.column(0), pc.fill_null(part.column(2), ""), pa.array(map(text_mask, texts), pa.int32()),
             pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
             pa.array(spread, pa.int64())],
            names=["doc_id", "part", "mask", "digest", "spread"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("part")
    )
    return map_texts(rows, run, _SEEN, setup=lambda: [0])


def _label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id, spread, flags``, one row per doc_id."""
    good, toxic = F.max(F.col("quality") == 1), F.max(F.col("toxic") == 1)
    flags = F.when(good, GOOD).otherwise(0) + F.when(toxic, TOXIC).otherwise(0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    return known.groupBy("doc_id").agg(flags.alias("flags")).withColumn("spread", F.lit(0).cast("long"))


def _flagged(seen: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows with ``flags``. Rows without doc_id are spread over the join's tasks."""
    flags = flags.withColumnRenamed("doc_id", "_id")
    own = seen.withColumn("_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    return own.join(flags, ["_id", "spread"], "left").select(
        "digest", "part", F.coalesce("flags", F.lit(0)).alias("flags"), "mask", "doc_id"
    )


def _summed(keys: int):
    """Arrow-batch function: rows of one text, part and flags become the smallest doc_id, the rows
    that have it, and all rows."""

    def out(held: dict[tuple, list]) -> pa.RecordBatch:
        groups, values = list(held), list(held.values())
        columns = [[int.from_bytes(g[0][:8], "big") * keys >> 64 for g in groups]]
        columns += [[g[i] for g in groups] for i in range(4)] + [[v[i] for v in values] for i in range(3)]
        types = [pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["key", "digest", "part", "flags", "mask", "doc_id", "first", "rows"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for digest, part, flags, mask, doc in zip(*(batch.column(i).to_pylist() for i in range(5))):
                # Rows without doc_id are summed apart: they compare with nothing.
                known = held.setdefault((digest, part, flags, mask, doc is None), [doc, 0, 0])
                known[2] += 1
                if doc is not None:
                    if doc < known[0]:
                        known[:2] = doc, 0
                    known[1] += doc == known[0]
            if len(held) >= PER_TASK:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return run


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gains and losses of the counters by the new rows of the texts of one key."""
    changes: dict[tuple[str, int, int], int] = {}

    def change(part: str, mask: int, flags: int, n: int) -> None:
        changes[part, mask, flags] = changes.get((part, mask, flags), 0) + n

    texts: dict[bytes, tuple[int, dict[tuple[str, int], int]]] = {}
    if state.exists:
        digests, least, places, parts, flags, counts = state.get
        digests = [bytes(d) for d in digests]
        texts = {d: (n, {}) for d, n in zip(digests, least)}
        for place, part, flag, n in zip(places, parts, flags, counts):
            texts[digests[place]][1][part, flag] = n
    for frame in frames:
        columns = [frame[c].tolist() for c in ("digest", "part", "flags", "mask", "doc_id", "first", "rows")]
        for digest, part, flags, mask, doc, first, rows in zip(*columns):
            if not first:
                change(part, mask, flags, rows)
                continue
            doc, first, digest = int(doc), int(first), bytes(digest)
            change(part, mask | REPEATED, flags, rows)
            least, cells = texts.get(digest, (None, {}))
            if least is None or doc < least:
                # What was counted as first is so no longer.
                for (p, f), n in cells.items():
                    change(p, mask, f, -n)
                    change(p, mask | REPEATED, f, n)
                least, cells = texts[digest] = doc, {}
            if doc == least:
                change(part, mask | REPEATED, flags, -first)
                change(part, mask, flags, first)
                cells[part, flags] = cells.get((part, flags), 0) + first
    held = [(i, p, f, n) for i, (_, cells) in enumerate(texts.values()) for (p, f), n in cells.items()]
    state.update((list(texts), [n for n, _ in texts.values()], *([r[i] for r in held] for i in range(4))))
    rows = [(p, m, f, n) for (p, m, f), n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "flags", "change"])


def _pattern(path: str) -> str:
    """A pattern that matches ``path`` alone: a stream reads a single file through one only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _keys(spark: SparkSession, stored: DataFrame, folder: str) -> int:
    """The number of keys of the state: chosen by the first run in ``folder``, then the same."""
    path = f"{folder}/keys"
    if not exists(spark, path):
        # Row counts of Parquet files are in their footers.
        n = max(1, -(-stored.count() // TEXTS_PER_KEY))
        spark.createDataFrame([(n,)], "keys int").write.json(path)
    return spark.read.schema("keys int").json(path).first()["keys"]


def run_stream(spark: SparkSession, path: str, labels: str, folder: str, batches: int = BATCHES) -> None:
    """Process the files at ``path`` that the run in ``folder`` has not seen, then stop.

    Called again after a failure, or when files have been added, it goes on where it ended.
    Changes of the counters are appended to ``folder``/changes.
    """
    ship(spark)
    own = spark.newSession()
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    # A new session does not take over what the caller has set at run time.
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stored = own.read.parquet(path)
    files = -(-max(1, len(stored.inputFiles())) // batches)
    docs = (
        own.readStream.schema(stored.schema)
        .option("maxFilesPerTrigger", files)
        # By default files much older than the newest are left out.
        .option("maxFileAge", "36500d")
        .parquet(_pattern(path))
    )
    # Every micro-batch joins them, so they are summed up once.
    flags, place = written_at(_label_flags(own.read.parquet(labels)), "label-flags")
    flagged = _flagged(_seen(docs), flags)
    summed = flagged.mapInArrow(_summed(_keys(spark, stored, folder)), _SUMMED)
    changes = summed.groupBy("key").applyInPandasWithState(
        _update, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout
    )
    query = (
        changes.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start(f"{folder}/changes")
    )
    try:
        query.awaitTermination()
    finally:
        remove(spark, place)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """``part, mask, flags, n``: documents by what they fail, over all that has arrived."""
    changes = spark.read.schema(_CHANGE).parquet(f"{folder}/changes")
    return changes.groupBy("part", "mask", "flags").agg(F.sum("change").alias("n")).where("n <> 0")


def _bits(letters: str) -> int:
    return sum(1 << FILTERS.index(c) for c in letters)


def all_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, mask, flags, n``."""
    good, toxic = F.col("flags").bitwiseAND(GOOD) > 0, F.col("flags").bitwiseAND(TOXIC) > 0
    masks = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"),
    )
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [
        F.struct(
            F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"),
            F.lit(_bits(order[i])).alias("own"), F.lit(_bits(order[:i])).alias("before"),
        )
        for order in orders
        for i in range(len(order))
    ]
    rows = parts.select("part", "counts", F.explode(F.array(*steps)).alias("s")).select("part", "counts", "s.*")

    def count(where, n: str = "n") -> Column:
        return F.aggregate(
            F.filter("counts", lambda c: where(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + c[n]
        )

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    out = rows.select(
        "part", "filter_order", "step", "own",
        count(lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        count(removed).alias("removed"),
        count(lambda m: fails(m) & earlier(m)).alias("redundant"),
        count(lambda m: m == own).alias("unique_fails"),
        count(removed, "good").alias("good_lost"),
        count(removed, "toxic").alias("toxic_lost"),
    )
    per_filter = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(per_filter, ["part", "own"]).drop("own")


def interactions(spark: SparkSession, documents: str, labels: str, batches: int = BATCHES) -> DataFrame:
    """The audit of all files at ``documents``: 600 rows per part."""
    folder = scratch_path(spark, "filter-stream")
    run_stream(spark, documents, labels, folder, batches)
    counts = written(counters(spark, folder), "filter-counters")
    remove(spark, folder)
    return all_orders(counts)
