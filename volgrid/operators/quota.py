"""A split with exactly the wanted number of rows per stock.

``split.assign_split`` draws every row for itself: shares hold on average, and a stock with ten
rows may have none in ``eval``. Here the rows of each stock are taken in the order of their hash,
and the first of them are train, the next validation, the rest eval, in numbers that add up: the
whole parts of the shares, and the rows left over by the largest remainders.

No stock is ranked as a whole. Rows are counted per (stock, hash range), which says in which range
each of the two cuts falls; only rows of those ranges are put in order, to find the row at the
cut. All others follow from their hash and the two cuts of their stock. A stock with a third of
all rows is counted and compared in all tasks, and two ranges of it are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest_unit, key_digest
from ..schemas import BUCKET_KEY, EVAL_FRACTION, SPLIT_SEED, VALIDATION_FRACTION
from ..session import cut_lineage
from .split import SPLITS

#: Hash ranges per group: two of them hold the rows that are put in order.
RANGES = 4096
#: Shares are taken in whole millionths, so that quotas are the same in every engine.
PARTS = 1_000_000


def shares(eval_fraction: float = EVAL_FRACTION, validation_fraction: float = VALIDATION_FRACTION) -> list[int]:
    """Millionths of train, validation and eval."""
    held = [round(validation_fraction * PARTS), round(eval_fraction * PARTS)]
    return [PARTS - sum(held), *held]


def quotas(n: Column, parts: list[int]) -> list[Column]:
    """Rows of each split out of ``n``: largest remainder, ties to the earlier split."""
    products = [n * F.lit(p).cast("long") for p in parts]
    whole = [F.call_function("div", p, F.lit(PARTS).cast("long")) for p in products]
    rest = [p % PARTS for p in products]
    left = n
    for w in whole:
        left = left - w
    out = []
    for i, mine in enumerate(rest):
        ahead = F.lit(0)
        for j, other in enumerate(rest):
            if j != i:
                ahead = ahead + F.when((other >= mine) if j < i else (other > mine), 1).otherwise(0)
        out.append(whole[i] + F.when(ahead < left, 1).otherwise(0))
    return out


def assign_split_exact(
    labels: DataFrame,
    keys: list[str] = BUCKET_KEY,
    group: str = "stock_id",
    eval_fraction: float = EVAL_FRACTION,
    validation_fraction: float = VALIDATION_FRACTION,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Add ``split``; every group has exactly its quota of each.

    ``keys`` identify a row: rows that repeat a key are counted and go to one split together, which
    is then over its quota. A null group is a group of its own. The counts and cuts (at most
    ``RANGES`` and one row a group) are written when this is called.
    """
    digest = key_digest(keys, seed)
    rows = labels.withColumn("_digest", digest).withColumns(
        {
            # Never null, so that joins on it are plain ones.
            "_group": F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))),
            "_range": F.floor(digest_unit(F.col("_digest")) * RANGES).cast("int"),
        }
    )
    # Hex digits of one case and length sort like the numbers they are.
    counts = cut_lineage(rows.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy("_group").agg(F.sum("_n").alias("_total"))
    train, validation, _ = quotas(F.col("_total"), shares(eval_fraction, validation_fraction))
    # At most RANGES rows a group.
    upto = Window.partitionBy("_group").orderBy("_range")
    placed = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .join(totals.select("_group", train.alias("_first"), (train + validation).alias("_second")), "_group")
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )

    def holds(cut: str) -> Column:
        return (F.col("_before") < F.col(cut)) & (F.col(cut) <= F.col("_upto"))

    wanted = [F.when(holds(c), F.col(c) - F.col("_before")).alias(f"{c}_in") for c in ("_first", "_second")]
    edges = placed.where(holds("_first") | holds("_second")).select("_group", "_range", *wanted)
    ordered = Window.partitionBy("_group", "_range").orderBy("_digest")
    near = rows.select("_group", "_range", "_digest").join(edges, ["_group", "_range"])
    numbered = near.withColumn("_at", F.row_number().over(ordered))
    # A cut is the digest of the last row below it; a group without rows below has none.
    cuts = cut_lineage(
        numbered.where("_at = _first_in OR _at = _second_in").groupBy("_group").agg(
            F.max(F.when(F.col("_at") == F.col("_first_in"), F.col("_digest"))).alias("_first"),
            F.max(F.when(F.col("_at") == F.col("_second_in"), F.col("_digest"))).alias("_second"),
        )
    )
    split = (
        F.when(F.col("_digest") <= F.col("_first"), SPLITS[0])
        .when(F.col("_digest") <= F.col("_second"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    joined = rows.join(cuts, "_group", "left")
    return joined.select(*labels.columns, split.alias("split"))
