"""Shards that all follow the mixture of sources: proportional stratified interleaving.

Rows of a source are put into a seeded random order. A row of rank ``r`` among ``n`` rows gets
the fractional rank ``(2r + 1) / 2n``; ordered by it, the sources interleave in proportion, and
every cut of that order holds them as the whole does. Shards are cuts of equal row counts.

Both orders are numbered without a window over a whole source or table. A hash of the row cuts
a source's order into ranges of about ``PER_RANGE`` rows; ranges are counted with partial
aggregation, numbered in parallel and shifted by the counts before them. The interleaved order
is cut into ranges of the fractional rank, whose counts follow from the sources' sizes alone.
Only keys and sizes are shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stratum, written

SHARDS = 16
SEED = 17
#: Rows that one window numbers, on average.
PER_RANGE = 50_000


def size_in_bytes(text: Column) -> Column:
    """UTF-8 bytes (none for null) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _ranges(n: int) -> int:
    """Ranges that an order of ``n`` rows is cut into: grows with the table."""
    return max(1, -(-n // PER_RANGE))


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source"
) -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Law ``rows``: the shards' row counts differ by one at most. ``slot`` numbers a shard's rows
    from 0 without gaps. Null sources are a source of their own; null text has size 1 and the
    checksum of no bytes; rows that agree in everything are placed one by one, in either order.
    An empty table gives no rows. Columns of the input other than these are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col(source).alias("source"),
            size_in_bytes(F.col("text")).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            stratum(source).alias("_s"),
            shuffled.alias("_h"),
        ),
        "shard-rows",
    )
    total = rows.count()
    cuts = _ranges(total)
    keyed = rows.withColumn("_b", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * cuts / F.lit(1 << 32))
    keyed = keyed.withColumn("_b", F.floor("_b"))
    counted = keyed.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    by_source = Window.partitionBy("_s")
    before = counted.select(
        "_s", "_b",
        (F.sum("_n").over(by_source.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_source).alias("_of"),
    )
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["_s", "_b"])
    ranked = ranked.withColumn("_r", F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")

    # Ranges of the fractional rank f = (2r + 1) / 2n: range j holds j <= f * cuts < j + 1.
    ranked = ranked.withColumn(
        "_j", F.expr(f"((2 * _r + 1) * {cuts}L) div (2 * _of)")
    )
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_of"))
    # Rows of a source with f * cuts < j: all r < of * j / cuts - 1/2.
    starts = (
        sizes.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
        .groupBy("_j")
        .agg(F.sum(F.expr(f"(2 * _of * _j + {cuts}L - 1) div (2 * {cuts}L)")).alias("_start"))
        .select(F.col("_j").cast("long").alias("_j"), "_start")
    )
    # The exact fraction first, so that equal fractions of different sources tie by source.
    fraction = (F.col("_r") * 2 + 1).cast("decimal(20,0)") / F.col("_of").cast("decimal(18,0)")
    mixed = Window.partitionBy("_j").orderBy(fraction, "_s", "_r")
    placed = ranked.withColumn("_in", F.row_number().over(mixed) - 1).join(starts, "_j")
    position = (F.col("_in") + F.col("_start")).cast("long")
    first = f"((shard * {total}L + {shards - 1}) div {shards})"
    return (
        placed.withColumn("_g", position)
        .withColumn("shard", F.expr(f"cast((_g * {shards}L) div {max(total, 1)}L as int)"))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"_g - {first}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
