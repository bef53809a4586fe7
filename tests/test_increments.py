"""Moments that merge, statistics of a stream, and builds that grow."""

from __future__ import annotations

import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from volgrid.operators import assemble, stats
from volgrid.operators import moments as mom
from volgrid.plans import increments, jobs
from volgrid.schemas import BUCKET_KEY, FEATURES
from volgrid.sources import fixtures, tables
from volgrid.streaming import moments as streams

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n=600):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        # Large against its spread; often missing; never seen; ordinary.
        a = 1e9 + float(rng.normal())
        b = [None, float("nan"), float(rng.normal())][i % 3]
        rows.append((i % 5, a, b, None, int(rng.integers(9))))
    return spark.createDataFrame(rows, "part int, a double, b double, c double, d int").repartition(4)


def check_norm(got, wanted):
    a, b = got.first(), wanted.first()
    assert a["count_seconds"] == b["count_seconds"] and a["source"] == b["source"]
    assert a["mean"] == pytest.approx(b["mean"], rel=1e-12, abs=1e-12)
    assert a["std"] == pytest.approx(b["std"], rel=1e-7)


def test_merged_parts_are_the_whole(spark):
    rows = table(spark)
    parts = mom.column_moments(rows, COLUMNS, ["part"])
    assert parts.count() == 20
    check_norm(mom.norm_of(mom.merge_moments(parts.drop("part")), COLUMNS), stats.fit_norm(rows, COLUMNS))
    check_norm(mom.norm_of(mom.column_moments(rows, COLUMNS), COLUMNS), stats.fit_norm(rows, COLUMNS))
    # Parts merge in steps, too, and per group.
    pairs = parts.withColumn("pair", F.floor(F.col("part") / 2))
    steps = mom.merge_moments(mom.merge_moments(pairs.drop("part"), ["pair"]).drop("pair"))
    check_norm(mom.norm_of(steps, COLUMNS), stats.fit_norm(rows, COLUMNS))


def test_moments_of_nothing(spark):
    rows = table(spark).limit(0)
    nothing = mom.merge_moments(mom.column_moments(rows, COLUMNS, ["part"]).drop("part"))
    assert nothing.count() == 0
    check_norm(mom.norm_of(nothing, COLUMNS), stats.fit_norm(rows, COLUMNS))
    # Columns in another order, and one that has no row.
    some = mom.norm_of(mom.column_moments(table(spark), ["b", "a"]), ["a", "x", "b"]).first()
    assert some["mean"][1] == 0 and some["std"][1] == 1 and some["mean"][0] == pytest.approx(1e9)


def test_merge_of_two():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50) + 1e8, rng.normal(size=7)

    def part(v):
        return len(v) + 1, len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())

    rows, n, mean, m2 = streams.merged(part(x), part(y))
    both = np.concatenate([x, y])
    assert (rows, n) == (59, 57) and mean == pytest.approx(both.mean()) and m2 == pytest.approx(both.var() * 57)
    assert streams.merged((3, 0, 0.0, 0.0), part(y))[1:] == part(y)[1:]
    assert streams.merged(part(y), (3, 0, 0.0, 0.0))[0] == 11


def test_stream_over_triggers_and_restarts(spark, tmp_path):
    rows = table(spark)
    rows.write.partitionBy("part").parquet(f"{tmp_path}/all")
    schema = rows.drop("part").schema
    os.mkdir(f"{tmp_path}/in")
    for part in range(5):
        for i, name in enumerate(sorted(os.listdir(f"{tmp_path}/all/part={part}"))):
            if name.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/all/part={part}/{name}", f"{tmp_path}/in/{part}-{i}.parquet")
        if part == 1:
            # A file much older than those seen before counts as well.
            old = next(n for n in os.listdir(f"{tmp_path}/in") if n.startswith("1-"))
            os.utime(f"{tmp_path}/in/{old}", (1e9, 1e9))
        # Each run starts from the checkpoint of the one before, one file a trigger.
        stream = streams.read_row_stream(spark, f"{tmp_path}/in", schema, 1)
        streams.moment_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress", COLUMNS, available_now=True).awaitTermination()
        seen = rows.where(F.col("part") <= part)
        check_norm(mom.norm_of(streams.latest_moments(spark, f"{tmp_path}/out"), COLUMNS), stats.fit_norm(seen, COLUMNS))
    versions = spark.read.parquet(f"{tmp_path}/out").groupBy("feature").agg(F.max("version").alias("v")).collect()
    assert len(versions) == 4 and all(r["v"] > 5 for r in versions)


# --- builds that grow ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def raw(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    labels = fixtures.labels(spark, sf_dir, 8)
    labels.write.parquet(f"{root}/labels")
    tables.write_by_stock(fixtures.book(spark, sf_dir, 8), f"{root}/book")
    tables.write_by_stock(fixtures.trade(spark, sf_dir, 8), f"{root}/trade")
    return spark.read.parquet(f"{root}/labels"), tables.read_book(spark, f"{root}/book"), tables.read_trade(spark, f"{root}/trade")


@pytest.fixture(scope="module")
def whole(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    jobs.build_job(spark, *raw, out, shard_size=16)
    return out


def contents(samples):
    return {(r["stock_id"], r["time_id"]): (r["split"], r["y_log"], r["x"]) for r in samples.collect()}


def test_builds_together_are_one_build(spark, raw, whole, tmp_path):
    labels, book, trade = raw
    out = str(tmp_path / "grown")
    assert increments.append_build(spark, labels.where("time_id < 12"), book, trade, out, 16) == 0
    first = {f: os.stat(f).st_mtime_ns for f in files(out)}
    # All labels: those that are built already are left out.
    assert increments.append_build(spark, labels, book, trade, out, 16) == 1
    assert increments.append_build(spark, labels, book, trade, out, 16) is None
    assert {f: os.stat(f).st_mtime_ns for f in files(out) if f in first} == first
    samples = increments.read_samples(spark, out)
    assert contents(samples) == contents(tables.read_samples(spark, f"{whole}/samples"))
    check_norm_near(increments.read_norm(spark, out), jobs.read_norm(spark, whole))
    # Shards go on where the build before ended: each is full, but for the last of a build.
    sizes = {(r["split"], r["shard_id"]): r["n"] for r in samples.groupBy("split", "shard_id").agg(F.count("*").alias("n")).collect()}
    total = increments.builds(spark, out)[-1].shards
    for name in ("train", "validation", "eval"):
        assert sorted(i for s, i in sizes if s == name) == list(range(total[name]))
    assert max(sizes.values()) == 16 and sum(n < 16 for n in sizes.values()) <= 6
    manifest = tables.read_manifest(spark, f"{out}/manifest/build=1/train").first()
    assert manifest.num_shards == total["train"] and manifest.feature_cols == FEATURES
    assert manifest.norm.mean == pytest.approx(jobs.read_norm(spark, whole).first()["mean"], rel=1e-6, abs=1e-9)


def files(out):
    return [os.path.join(d, f) for d, _, names in os.walk(out) for f in names]


def check_norm_near(got, wanted):
    a, b = got.first(), wanted.first()
    assert a["count_seconds"] == b["count_seconds"]
    assert a["mean"] == pytest.approx(b["mean"], rel=1e-6, abs=1e-9) and a["std"] == pytest.approx(b["std"], rel=1e-6)


def test_append_reads_no_earlier_samples(spark, raw, tmp_path):
    """The second build works, and has the same statistics, with the first one's samples gone."""
    labels, book, trade = raw
    out = str(tmp_path / "grown")
    increments.append_build(spark, labels.where("time_id < 12"), book, trade, out, 16)
    for f in files(f"{out}/samples/build=0"):
        if f.endswith(".parquet"):
            os.truncate(f, 0)
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    assert increments.append_build(spark, labels, book, trade, out, 16) == 1
    train = labels.withColumn("split", F.lit(None))
    assert increments.read_norm(spark, out).first()["count_seconds"] > 0 and train.count() > 0
    plan = increments._near(book, labels.where("time_id >= 12"))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(time_id,12)" in scan and "stock_id" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_a_build_that_did_not_finish_is_made_again(spark, raw, tmp_path, monkeypatch):
    labels, book, trade = raw
    out = str(tmp_path / "grown")
    increments.append_build(spark, labels.where("time_id < 12"), book, trade, out, 16)
    before = increments.read_norm(spark, out).first()

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(increments, "column_moments", fail)
    with pytest.raises(RuntimeError):
        increments.append_build(spark, labels, book, trade, out, 16)
    monkeypatch.undo()
    # Readers do not see what it has left.
    assert increments.read_norm(spark, out).first() == before
    assert contents(increments.read_samples(spark, out)).keys() == {tuple(r) for r in labels.where("time_id < 12").select(*BUCKET_KEY).collect()}
    assert increments.append_build(spark, labels.where("time_id < 15"), book, trade, out, 16) == 1
    assert len(contents(increments.read_samples(spark, out))) == labels.where("time_id < 15").count()


def test_settings_have_to_stay(spark, raw, tmp_path):
    labels, book, trade = raw
    out = str(tmp_path / "grown")
    increments.append_build(spark, labels.where("time_id < 5"), book, trade, out, 16, columns=["size", "log_return"])
    with pytest.raises(ValueError):
        increments.append_build(spark, labels, book, trade, out, 32, columns=["size", "log_return"])
    with pytest.raises(ValueError):
        increments.append_build(spark, labels, book, trade, out, 16)
    assert increments.append_build(spark, labels.where("time_id < 7"), book, trade, out, 16, columns=["size", "log_return"]) == 1
    assert len(increments.read_norm(spark, out).first()["mean"]) == 2


def test_changed_shards_are_found(spark, raw, tmp_path):
    labels, book, trade = raw
    out = str(tmp_path / "grown")
    increments.append_build(spark, labels.where("time_id < 12"), book, trade, out, 16)
    assert increments.changed_shards(spark, out).isEmpty()
    shard = increments.read_samples(spark, out, "train").where("shard_id = 1")
    kept = increments.read_samples(spark, out, "train").where("shard_id <> 1")
    other = shard.withColumn("y_log", F.when(F.col("pos") == 3, F.col("y_log") + 1).otherwise(F.col("y_log")).cast("float"))
    kept.unionByName(other).drop("split").write.parquet(f"{tmp_path}/new")
    shutil.move(f"{out}/samples/build=0/split=train", f"{tmp_path}/old")
    shutil.move(f"{tmp_path}/new", f"{out}/samples/build=0/split=train")
    assert [tuple(r) for r in increments.changed_shards(spark, out).collect()] == [("train", 1)]


def test_nothing_to_build(spark, raw, tmp_path):
    labels, book, trade = raw
    out = str(tmp_path / "none")
    assert increments.append_build(spark, labels.limit(0), book, trade, out) is None
    assert increments.builds(spark, out) == [] and increments.read_samples(spark, out).count() == 0
    assert increments.read_norm(spark, out).first()["std"] == [1.0] * len(FEATURES)
    assert math.isclose(sum(increments.read_norm(spark, out).first()["mean"]), 0)
    assert assemble.SPLITS == ["train", "validation", "eval"]
