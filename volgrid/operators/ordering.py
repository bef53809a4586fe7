"""Exact ranks, shards, shuffles and batches without a global sort in one task.

Ranks are taken in the order of a uniform hash. The leading bits of the hash cut the order
into intervals that depend on the data's keys alone, so each interval can be numbered on its
own and shifted by the number of rows before it. Nothing is sampled or materialized, and a
recomputed task sees the same intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit, key_digest
from ..schemas import BUCKET_KEY, SHARD_SIZE, SHUFFLE_SEED, SPLIT_SEED
from ..session import cut_lineage

# Intervals per shuffle partition: enough for even partitions, few enough to count cheaply.
INTERVALS_PER_PARTITION = 64
CHUNK = 1024


def null_free(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """The rows with key columns that are never null, their names, and the keys back from them.

    Null is a value of its own. Joins on such columns are plain equalities, which reuse the
    partitioning of windows and aggregations by them; a null-safe comparison of the keys
    themselves would shuffle the rows again.
    """
    added: dict[str, Column] = {}
    restored: list[Column] = []
    types = dict(df.dtypes)
    for i, k in enumerate(keys):
        kind = types[k]
        plain = kind in ("tinyint", "smallint", "int", "bigint", "string")
        value = F.col(k) if plain else F.col(k).cast("string")
        filler = F.lit("") if kind == "string" or not plain else F.lit(0).cast(kind)
        added |= {f"_key_{i}": F.coalesce(value, filler), f"_none_{i}": F.col(k).isNull()}
        restored.append(F.when(~F.col(f"_none_{i}"), F.col(f"_key_{i}").cast(kind)).alias(k))
    return df.withColumns(added) if added else df, list(added), restored


def running_totals(
    df: DataFrame, index: str, values: dict[str, Column | str], group: list[str] = []
) -> DataFrame:
    """Add, per ``name: value``, the sum of ``value`` over rows of lower ``index`` in the group.

    ``index`` counts 0, 1, 2... within a group, each at most once. Totals are taken per chunk
    of indexes first, so a task holds one chunk, or one row per chunk of a group, never the
    whole group.
    """
    keyed, keys, _ = null_free(df, group)
    chunk = [*keys, "_chunk"]
    rows = keyed.withColumn("_chunk", F.coalesce(F.floor(F.col(index) / CHUNK), F.lit(-1)))
    totals = rows.groupBy(*chunk).agg(
        *[F.sum(v).alias(f"_total_{name}") for name, v in values.items()]
    )
    by_chunk = _window(keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *chunk,
        *[
            F.coalesce(F.sum(f"_total_{name}").over(by_chunk), F.lit(0)).alias(f"_base_{name}")
            for name in values
        ],
    )
    within = Window.partitionBy(*chunk).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[
            F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_local_{name}")
            for name, v in values.items()
        ],
    )
    # The rows stay where their window has put them; only the totals move.
    return local.join(bases, chunk).select(
        *df.columns, *[(F.col(f"_base_{n}") + F.col(f"_local_{n}")).alias(n) for n in values]
    )


def _window(group: list[str]) -> WindowSpec:
    # Without a group there is one row per interval (64 per partition) or per 1,024 indexes.
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


def hash_rank(
    df: DataFrame, unit: Column, tie_break: list[str], name: str = "rank", group: list[str] = []
) -> DataFrame:
    """Add the 0-based rank by (``unit``, ``tie_break``), per group; ``unit`` is in [0, 1).

    Null is a group of its own. Meant for groups of many rows: with groups of fewer rows than
    there are intervals, the counts are about as many as the rows.

    ``tie_break`` has to identify a row within its group. A group of any size is spread over
    all partitions, and only the counts of the intervals are brought together. The number of
    intervals follows the shuffle setting and does not change the ranks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    intervals = INTERVALS_PER_PARTITION * partitions
    keyed, keys, _ = null_free(df, group)
    part = [*keys, "_interval"]
    rows = keyed.withColumn("_unit", unit).withColumn(
        "_interval", F.coalesce(F.floor(F.col("_unit") * intervals), F.lit(0)).cast("int")
    )
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows"))
    before = _window(keys).orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(*part).orderBy("_unit", *tie_break)
    numbered = rows.withColumn("_local", F.row_number().over(within) - 1)
    # The numbered rows keep their partitioning in this join; only the counts move.
    return numbered.join(starts, part).select(
        *df.columns, (F.col("_start") + F.col("_local")).alias(name)
    )


def assign_shards(
    index: DataFrame,
    shard_size: int = SHARD_SIZE,
    keys: list[str] = BUCKET_KEY,
    seed: int = SPLIT_SEED,
    group: list[str] = [],
) -> DataFrame:
    """Add ``shard_id`` and ``pos``: shards of exactly ``shard_size``, the last one shorter.

    With ``group=["split"]`` every split has shards of its own.
    """
    ranked = hash_rank(index, hash_unit(keys, seed), keys, "_rank", group)
    return ranked.select(
        *index.columns,
        F.floor(F.col("_rank") / shard_size).alias("shard_id"),
        (F.col("_rank") % shard_size).alias("pos"),
    )


def shard_table(samples: DataFrame) -> DataFrame:
    """One row per shard with its size."""
    return samples.groupBy("shard_id").agg(F.count(F.lit(1)).alias("samples"))


def exact_shards(index: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """The shard table of ``assign_shards(index, shard_size)``, from the row count alone.

    Calling this counts the rows of ``index``; they are not ranked.
    """
    rows = index.count()
    left = F.least(F.lit(shard_size), F.lit(rows) - F.col("id") * shard_size)
    shards = index.sparkSession.range(-(-rows // shard_size))
    return shards.select(F.col("id").alias("shard_id"), left.cast("long").alias("samples"))


def shuffle_shards(shards: DataFrame, seed: int = SHUFFLE_SEED, epoch: int = 0) -> DataFrame:
    """Add ``shard_pos``: one seeded permutation of the shards, shared by all consumers."""
    unit = hash_unit([F.lit(epoch), F.col("shard_id")], seed)
    return hash_rank(shards, unit, ["shard_id"], "shard_pos")


def shuffle_samples(
    samples: DataFrame, keys: list[str] = BUCKET_KEY, seed: int = SHUFFLE_SEED, epoch: int = 0
) -> DataFrame:
    """Add ``sample_pos``: a seeded permutation within each shard (at most one shard a task)."""
    digest = key_digest([F.lit(epoch), *keys], seed)
    within = Window.partitionBy("shard_id").orderBy(digest, *keys)
    return samples.withColumn("sample_pos", F.row_number().over(within).cast("long") - 1)


def slice_consumers(shuffled: DataFrame, consumers: int) -> DataFrame:
    """Add ``consumer``: disjoint contiguous runs of ``ceil(shards / consumers)`` shards."""
    shards = shuffled.agg(F.count(F.lit(1))).scalar()
    per_consumer = F.ceil(shards / consumers)
    return shuffled.withColumn("consumer", F.floor(F.col("shard_pos") / per_consumer))


def assign_batches(
    samples: DataFrame,
    batch_size: int = 64,
    consumers: int = 4,
    keys: list[str] = BUCKET_KEY,
    seed: int = SHUFFLE_SEED,
    epoch: int = 0,
    shards: DataFrame | None = None,
) -> DataFrame:
    """Add ``consumer`` and ``batch``: each consumer reads its shards in shuffled order.

    A sample's place in its consumer's stream is the size of the shards read before its own
    plus its place in the shard, so samples are never sorted across shards. ``shards`` is the
    shard table (one row per shard), if it is known (see ``exact_shards``); else calling this
    counts the samples of each shard and writes the table, as its order and totals read it
    several times.
    """
    sizes = cut_lineage(shard_table(samples)) if shards is None else shards
    ordered = slice_consumers(shuffle_shards(sizes, seed, epoch), consumers)
    starts = running_totals(ordered, "shard_pos", {"_before": "samples"})
    # Samples read by earlier consumers come off again: what is left counts from 0.
    firsts = starts.groupBy("consumer").agg(F.min("_before").alias("_first"))
    offsets = starts.join(firsts, "consumer").select(
        "shard_id", "consumer", (F.col("_before") - F.col("_first")).alias("_offset")
    )
    placed = shuffle_samples(samples, keys, seed, epoch).join(offsets, "shard_id")
    return placed.select(
        *samples.columns,
        "consumer",
        F.floor((F.col("_offset") + F.col("sample_pos")) / batch_size).alias("batch"),
    )
