"""Shapes of physical plans, and work spread when one key holds a third of all rows."""

import re

import pytest
from pyspark.sql import functions as F
from volgrid.functions.hashing import hash_unit
from volgrid.operators import assemble, features, latency, ordering, stats
from volgrid.schemas import BUCKET_KEY, FEATURES, SECOND, SLOT_KEY
from volgrid.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, operator):
    return len(re.findall(rf"[-:+ ]{operator} ", plan(df)))


@pytest.fixture(scope="module")
def stored_market(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("market"))
    frames = []
    for name, df in zip(("index", "book", "trade"), fixtures.market(spark, sf_dir), strict=True):
        df.write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    return frames


def test_features_take_two_shuffles_and_no_join(stored_market):
    frame = features.bucket_features(*stored_market)
    assert count(frame, "Exchange") == 2
    assert "Join" not in plan(frame) and "CartesianProduct" not in plan(frame)
    assert "SortAggregate" not in plan(frame)


def test_unique_slots_take_one_shuffle(stored_market):
    assert count(features.bucket_features(*stored_market, unique_slots=True), "Exchange") == 1


def test_tensors_reuse_the_placement(stored_market):
    frame = features.bucket_features(*stored_market)
    assert count(assemble.bucket_tensor(frame), "Exchange") == 2
    assert count(assemble.bucket_summary(frame), "Exchange") == 2
    assert count(features.bucket_rv(*stored_market), "Exchange") == 2


def test_matrices_are_in_no_join(spark, stored_market):
    index, book, trade = stored_market
    samples = assemble.build_samples(index.withColumn("target", F.lit(0.1)), book, trade, shard_size=64)
    text = plan(samples)
    joins = [i for i, line in enumerate(text.splitlines()) if "Join" in line]
    collect = [i for i, line in enumerate(text.splitlines()) if "collect_list" in line]
    # Every join lies below the aggregation that builds the matrices.
    assert joins and min(joins) > max(collect)


def test_unused_features_leave_the_plan(stored_market):
    frame = features.bucket_features(*stored_market).select(*SLOT_KEY, "mid_last")
    text = plan(frame)
    assert "order_count" not in text and "bid_size1" not in text.split("ReadSchema")[1]
    assert count(frame, "Window") == 1


def test_statistics_are_one_partial_aggregate(spark):
    df = spark.range(10).select(*[F.rand(i).alias(c) for i, c in enumerate(FEATURES)])
    one = stats.fit_norm(df)
    assert count(one, "Exchange") == 1 and "Exchange SinglePartition" in plan(one)
    applied = stats.apply_norm(df, one)
    assert "CartesianProduct" not in plan(applied)


def test_numbered_rows_are_shuffled_once(spark):
    keys = spark.range(1000).select((F.col("id") % 7).alias("stock_id"), F.col("id").alias("time_id"))
    ranked = ordering.hash_rank(keys, hash_unit(BUCKET_KEY, 1), BUCKET_KEY)
    # Spark draws the left side of a join behind a colon.
    left = [line for line in plan(ranked).splitlines() if ":" in line.split("Exchange")[0]]
    assert len([line for line in left if "Exchange" in line]) == 1


def per_partition(df):
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_copies_of_a_hot_slot_are_combined_before_the_shuffle(spark):
    hot = spark.range(200_000).select(
        F.lit(1).alias("stock_id"), F.lit(1).alias("time_id"), (F.col("id") % 600).cast("int").alias(SECOND),
        F.lit(1.0).alias("bid_price1"), F.lit(1.1).alias("ask_price1"),
        F.lit(5).cast("long").alias("bid_size1"), F.lit(6).cast("long").alias("ask_size1"),
    )
    other = hot.withColumns({"stock_id": F.col(SECOND) % 50 + 2, "time_id": F.lit(2)}).distinct()
    book = hot.unionByName(other)
    trade = book.select(*SLOT_KEY, F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("order_count"))
    index = book.select(*BUCKET_KEY).distinct()
    frame = features.bucket_features(index, book, trade)
    sizes = frame.groupBy(*BUCKET_KEY).count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [600]
    text = plan(frame)
    assert text.index("partial_max") > text.index("Exchange hashpartitioning(stock_id")


def test_rank_spreads_a_hot_stock(spark):
    keys = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("stock_id"), F.col("id").alias("time_id")
    )
    ranked = ordering.hash_rank(keys, hash_unit(BUCKET_KEY, 1), BUCKET_KEY, group=["stock_id"])
    rows = per_partition(ranked)
    assert sum(rows) == 60_000
    # Adaptive execution may merge small partitions, but none holds much more than its share.
    assert max(rows) <= 60_000 / len(rows) * 1.3


def test_percentiles_shuffle_counts_only(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("mode"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1)).alias("latency_ms"),
    )
    result = latency.percentiles(df, ["mode"])
    text = plan(result)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert {r["mode"]: r.p99_ms for r in result.collect()}["hot"] == 5.0
