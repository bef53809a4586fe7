from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from volgrid.functions.hashing import hash_unit
from volgrid.operators import ordering, split

KEYS = ["stock_id", "time_id"]


@pytest.fixture(scope="module")
def keys(spark):
    """Unique pairs; stock 0 holds a third of them."""
    stock = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(10_000).select(stock.cast("int").alias("stock_id"), F.col("id").alias("time_id"))


def test_rank_is_the_sorted_position(keys):
    unit = hash_unit(KEYS, 1)
    got = ordering.hash_rank(keys, unit, KEYS).withColumn("u", unit).orderBy("u", *KEYS).collect()
    assert [r["rank"] for r in got] == list(range(10_000))


def test_rank_per_group(keys):
    unit = hash_unit(KEYS, 1)
    ranked = ordering.hash_rank(keys, unit, KEYS, group=["stock_id"]).withColumn("u", unit)
    per_group = defaultdict(list)
    for r in ranked.orderBy("u", *KEYS).collect():
        per_group[r.stock_id].append(r["rank"])
    assert all(ranks == list(range(len(ranks))) for ranks in per_group.values())
    assert len(per_group[0]) > 3_000


def test_rank_does_not_depend_on_partitioning(keys):
    def ranks(df):
        return set(map(tuple, ordering.hash_rank(df, hash_unit(KEYS, 1), KEYS).collect()))

    assert ranks(keys.repartition(3)) == ranks(keys.repartition(11, "stock_id"))


def test_shard_sizes(keys):
    shards = ordering.assign_shards(keys, 2048)
    sizes = Counter(r.shard_id for r in shards.collect())
    assert sorted(sizes.values()) == [10_000 - 4 * 2048] + [2048] * 4
    assert sizes[4] == 10_000 - 4 * 2048


def test_shards_per_split(keys):
    shards = ordering.assign_shards(split.assign_split(keys), 512, group=["split"]).collect()
    for name in split.SPLITS:
        sizes = Counter(r.shard_id for r in shards if r.split == name)
        assert all(sizes[i] == 512 for i in range(len(sizes) - 1))
        places = {(r.shard_id, r.pos) for r in shards if r.split == name}
        assert len(places) == sum(sizes.values())


def test_running_totals_across_chunks(spark):
    n = 5 * ordering.CHUNK + 17
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("i"), "id")
    got = ordering.running_totals(df, "i", {"before": "id"}, ["g"]).orderBy("g", "i").collect()
    for group in (0, 1):
        total = 0
        for r in (r for r in got if r.g == group):
            assert r.before == total
            total += r.id


def test_shuffles_are_permutations_that_vary_by_seed_and_epoch(keys):
    shards = ordering.shard_table(ordering.assign_shards(keys, 64))
    orders = [
        [r.shard_id for r in ordering.shuffle_shards(shards, s, e).orderBy("shard_pos").collect()]
        for s, e in ((23, 0), (23, 0), (24, 0), (23, 1))
    ]
    assert orders[0] == orders[1] and orders[0] != orders[2] and orders[0] != orders[3]
    assert all(sorted(o) == list(range(157)) for o in orders)


def test_consumer_slices_cover_all_shards_once(keys):
    shuffled = ordering.shuffle_shards(ordering.shard_table(ordering.assign_shards(keys, 64)))
    for consumers in (1, 4, 6, 200):
        rows = ordering.slice_consumers(shuffled, consumers).collect()
        per = -(-157 // consumers)
        assert all(r.consumer == r.shard_pos // per for r in rows)
        assert sorted(r.shard_id for r in rows) == list(range(157))


def test_batches_follow_each_consumers_stream(keys):
    samples = ordering.assign_shards(keys, 64)
    batched = ordering.assign_batches(samples, batch_size=100, consumers=4)
    order = ordering.slice_consumers(ordering.shuffle_shards(ordering.shard_table(samples)), 4)
    position = {r.shard_id: r.shard_pos for r in order.collect()}
    within = {
        (r.stock_id, r.time_id): r.sample_pos for r in ordering.shuffle_samples(samples).collect()
    }
    streams = defaultdict(list)
    for r in batched.collect():
        place = (position[r.shard_id], within[(r.stock_id, r.time_id)])
        streams[r.consumer].append((place, r.batch))
    assert sum(map(len, streams.values())) == 10_000
    for stream in streams.values():
        assert [b for _, b in sorted(stream)] == [i // 100 for i in range(len(stream))]


def test_split_is_disjoint_complete_and_stable(keys):
    first = split.assign_split(keys)
    again = split.assign_split(keys.repartition(7))
    assert first.exceptAll(again).isEmpty()
    assert first.count() == 10_000
    shares = {r.split: r["count"] / 10_000 for r in first.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.7, abs=0.02)
    assert shares["validation"] == pytest.approx(0.1, abs=0.02)
    assert shares["eval"] == pytest.approx(0.2, abs=0.02)
    routed = [split.route_split(first, s) for s in split.SPLITS]
    assert routed[0].unionByName(routed[1]).unionByName(routed[2]).distinct().count() == 10_000
    with pytest.raises(ValueError):
        split.route_split(first, "test")


def test_hash_methods_are_uniform(keys):
    for method in ("md5", "xxhash64"):
        row = keys.select(hash_unit(KEYS, 42, method).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
        assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1
        assert row[2] == pytest.approx(0.5, abs=0.02)
    with pytest.raises(ValueError):
        hash_unit(KEYS, 42, "crc")


def test_derived_paths(keys):
    row = split.derive_paths(keys.limit(1), "raw/book/", "raw/trade").first()
    assert row.book_path == f"raw/book/stock_id={row.stock_id}"
    assert row.trade_path == f"raw/trade/stock_id={row.stock_id}"


def test_a_null_group_has_ranks_and_totals(spark):
    df = spark.range(90).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    ranks = ordering.hash_rank(df, hash_unit([F.col("k")], 1), ["k"], group=["g"]).collect()
    for g in (None, 1, 2):
        assert sorted(r["rank"] for r in ranks if r["g"] == g) == list(range(30))
    steps = spark.range(2000).select(F.lit(None).cast("int").alias("g"), F.col("id").alias("i"), F.lit(1).alias("v"))
    totals = ordering.running_totals(steps, "i", {"before": "v"}, ["g"]).collect()
    assert sorted(r["before"] for r in totals) == list(range(2000))
