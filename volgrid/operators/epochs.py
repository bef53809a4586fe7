"""Order of samples in any epoch, as columns of the place a sample is stored at.

Samples are stored as ``shard_id, pos``: shards of ``shard_size``, the last one shorter. From these
and the number of samples follow the shard's place in an epoch, the sample's place in its shard,
the consumer that reads it and the batch: nothing is ranked, counted or shuffled, and each epoch is
a new order of the same files. Samples without a place (null, or beyond the number of samples) get
nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.permutation import permute, round_keys, unpermute
from ..functions.scalars import as_column
from ..schemas import SHARD_SIZE, SHUFFLE_SEED


def _whole(value: Column, by: Column | int) -> Column:
    return F.call_function("div", value, (by if isinstance(by, Column) else F.lit(by)).cast("long"))


def _epoch(epoch: int | str | Column) -> Column:
    return F.lit(epoch) if isinstance(epoch, int) else as_column(epoch)


def epoch_place(
    samples: DataFrame,
    rows: int,
    epoch: int | str | Column = 0,
    shard_size: int = SHARD_SIZE,
    seed: int = SHUFFLE_SEED,
    name: str = "place",
) -> DataFrame:
    """Add the sample's place among all ``rows`` in an epoch that mixes samples across shards.

    ``epoch`` may be a column.
    """
    index = F.col("shard_id") * F.lit(shard_size).cast("long") + F.col("pos")
    return samples.withColumn(name, permute(index, rows, round_keys(seed, _epoch(epoch))))


def _shard_rows(shard: Column, rows: int, shard_size: int) -> Column:
    return F.least(F.lit(shard_size).cast("long"), F.lit(rows).cast("long") - shard * shard_size)


def epoch_order(
    samples: DataFrame,
    rows: int,
    epoch: int | str | Column = 0,
    shard_size: int = SHARD_SIZE,
    batch_size: int = 64,
    consumers: int = 4,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """Add ``shard_pos, sample_pos, consumer, batch``: shards are read whole, in a new order.

    Consumers take runs of ``ceil(shards / consumers)`` shards, and batches count from 0 in each.
    """
    shards = max(1, -(-rows // shard_size))
    run = -(-shards // consumers)
    keys = round_keys(seed, _epoch(epoch))
    placed = samples.select(
        "*",
        permute(F.col("shard_id"), shards, keys).alias("shard_pos"),
        # Where the only shorter shard is read: samples after it move up.
        permute(F.lit(shards - 1), shards, keys).alias("_short"),
        permute(
            F.col("pos"), _shard_rows(F.col("shard_id"), rows, shard_size),
            round_keys(seed, _epoch(epoch), F.col("shard_id")),
        ).alias("sample_pos"),
    ).withColumn("consumer", _whole(F.col("shard_pos"), run))
    first = F.col("consumer") * run
    missing = shards * shard_size - rows
    moved = F.when((F.col("_short") >= first) & (F.col("_short") < F.col("shard_pos")), missing).otherwise(0)
    offset = (F.col("shard_pos") - first) * shard_size + F.col("sample_pos") - moved
    return placed.withColumn("batch", _whole(offset, batch_size)).drop("_short")


def reading_list(
    spark: SparkSession,
    rows: int,
    epoch: int = 0,
    shard_size: int = SHARD_SIZE,
    consumers: int = 4,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """``consumer, shard_pos, sample_pos, shard_id, pos``: what to read next, without the samples.

    The same order as ``epoch_order``, computed backwards from the places.
    """
    shards = -(-rows // shard_size)
    run = max(1, -(-shards // consumers))
    order = spark.range(shards).select(
        F.col("id").alias("shard_pos"), unpermute(F.col("id"), shards, round_keys(seed, epoch)).alias("shard_id")
    )
    size = _shard_rows(F.col("shard_id"), rows, shard_size)
    places = order.select("*", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("sample_pos"))
    keys = round_keys(seed, epoch, F.col("shard_id"))
    return places.select(
        _whole(F.col("shard_pos"), run).alias("consumer"), "shard_pos", "sample_pos", "shard_id",
        unpermute(F.col("sample_pos"), size, keys).alias("pos"),
    )
