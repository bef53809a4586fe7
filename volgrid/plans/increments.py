"""Builds that grow: new buckets are added, and what is stored already is not read again.

A build folder holds, per build number:

- ``index``: the buckets of this build with their split,
- ``samples``: their matrices; shard numbers go on where the builds before it ended,
- ``shards``: size and digest of each shard,
- ``moments``: the moments of each train shard, one row per feature,
- ``commits``: one row, written last. A build without it does not exist: it is written anew.

Statistics over all builds are merged from ``moments``: as many rows as there are shards and
features. Labels of buckets that are built already are left out, so the same table may be given
again with new rows in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble
from ..operators.moments import MOMENTS, column_moments, merge_moments, norm_of
from ..operators.split import SPLITS, assign_split
from ..schemas import BUCKET_KEY, FEATURES, SAMPLE, SECOND, SHARD_SIZE
from ..session import cut_lineage
from ..sources import tables

INDEX = "stock_id int, time_id int, target double, split string"
SHARDS = "split string, shard_id long, samples long, digest long"
COMMIT = "build int, buckets long, shard_size long, features array<string>, shards map<string, long>"


@dataclass
class Build:
    """A committed build: shards of all builds up to it, per split."""

    number: int
    shard_size: int
    features: list[str]
    shards: dict[str, int]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def builds(spark: SparkSession, out: str) -> list[Build]:
    """The committed builds in order: one short row each."""
    if not _exists(spark, f"{out}/commits"):
        return []
    rows = spark.read.schema(COMMIT).json(f"{out}/commits").orderBy("build").collect()
    return [Build(r["build"], r["shard_size"], r["features"], r["shards"]) for r in rows]


def _of_builds(spark: SparkSession, out: str, name: str, schema, numbers: list[int]) -> DataFrame:
    """A table of the build folder: the folders of committed builds alone."""
    if not numbers:
        return spark.createDataFrame([], schema)
    paths = [f"{out}/{name}/build={n}" for n in numbers]
    names = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(*paths).select(*names)


def _numbers(spark: SparkSession, out: str) -> list[int]:
    return [b.number for b in builds(spark, out)]


def read_samples(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    """The samples of all committed builds, or of one split."""
    samples = _of_builds(spark, out, "samples", SAMPLE, _numbers(spark, out))
    return samples if split is None else samples.where(F.col("split") == split)


def read_norm(spark: SparkSession, out: str) -> DataFrame:
    """The train statistics over all committed builds, from the stored moments."""
    done = builds(spark, out)
    columns = done[-1].features if done else FEATURES
    parts = _of_builds(spark, out, "moments", MOMENTS, [b.number for b in done])
    return norm_of(merge_moments(parts), columns)


def _near(source: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of a source in the buckets of the index.

    The range of the keys is given as constants, which files and folders are skipped by; the join
    leaves the rows within it that belong to no bucket of the index.
    """
    ends = index.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in BUCKET_KEY for f in (F.min, F.max)]).first()
    for k in BUCKET_KEY:
        source = source.where(F.col(k).between(ends[f"min_{k}"], ends[f"max_{k}"]))
    return source.join(index.select(*BUCKET_KEY), BUCKET_KEY, "left_semi")


def shard_digests(samples: DataFrame) -> DataFrame:
    """Size and content of each shard; the digest does not depend on the order of the rows."""
    content = F.xxhash64(*BUCKET_KEY, "pos", "y_log", F.to_json(F.struct("x")))
    return samples.groupBy("split", "shard_id").agg(
        F.count(F.lit(1)).alias("samples"), F.bit_xor(content).alias("digest")
    )


def append_build(
    spark: SparkSession,
    labels: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    out: str,
    shard_size: int = SHARD_SIZE,
    unique_slots: bool = True,
    columns: list[str] = FEATURES,
) -> int | None:
    """Build the buckets of ``labels`` that no committed build has; the number of the new build.

    None, and nothing written, if there are none. ``labels`` may come with ``split``; shard size
    and features have to be those of the builds before.
    """
    done = builds(spark, out)
    if done and (done[-1].shard_size, done[-1].features) != (shard_size, list(columns)):
        raise ValueError("shard size and features must stay the same from build to build")
    number = done[-1].number + 1 if done else 0
    before = dict(done[-1].shards) if done else dict.fromkeys(SPLITS, 0)
    here = f"build={number}"

    known = _of_builds(spark, out, "index", INDEX, [b.number for b in done])
    fresh = labels.join(known.select(*BUCKET_KEY), BUCKET_KEY, "left_anti") if done else labels
    split = fresh if "split" in labels.columns else assign_split(fresh)
    split.select(*BUCKET_KEY, F.col("target").cast("double").alias("target"), "split").write.mode("overwrite").parquet(
        f"{out}/index/{here}"
    )
    index = _of_builds(spark, out, "index", INDEX, [number])
    buckets = index.count()
    if not buckets:
        return None

    made = assemble.build_samples(
        index, _near(book, index), _near(trade, index), columns, shard_size, unique_slots=unique_slots
    )
    offset = F.create_map(*[v for s in SPLITS for v in (F.lit(s), F.lit(before[s]).cast("long"))])
    moved = made.withColumn("shard_id", F.col("shard_id") + offset[F.col("split")])
    placed = moved.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "pos")
    placed.write.mode("overwrite").partitionBy("split").parquet(f"{out}/samples/{here}")

    samples = _of_builds(spark, out, "samples", SAMPLE, [number])
    shards = cut_lineage(shard_digests(samples))
    shards.write.mode("overwrite").parquet(f"{out}/shards/{here}")
    train = samples.where(F.col("split") == "train").select("shard_id", F.posexplode("x").alias(SECOND, "_v"))
    values = train.select("shard_id", *[F.col("_v")[i].alias(c) for i, c in enumerate(columns)])
    column_moments(values, columns, ["shard_id"]).write.mode("overwrite").parquet(f"{out}/moments/{here}")

    # One number a split.
    added = {r["split"]: r["n"] for r in shards.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {s: before[s] + added.get(s, 0) for s in SPLITS}
    commit = spark.createDataFrame([(number, buckets, shard_size, list(columns), total)], COMMIT)
    commit.write.mode("overwrite").json(f"{out}/commits/{here}")

    norm = cut_lineage(read_norm(spark, out))
    for name in SPLITS:
        numbered = spark.range(total[name]).withColumnRenamed("id", "shard_id")
        row = tables.manifest(numbered, norm, columns, shard_size, name == "train")
        row.write.mode("overwrite").json(f"{out}/manifest/{here}/{name}")
    return number


def changed_shards(spark: SparkSession, out: str) -> DataFrame:
    """``split, shard_id`` of shards whose samples are not those that were committed."""
    numbers = _numbers(spark, out)
    stored = _of_builds(spark, out, "shards", SHARDS, numbers)
    now = shard_digests(_of_builds(spark, out, "samples", SAMPLE, numbers))
    key = ["split", "shard_id"]
    both = stored.alias("a").join(now.alias("b"), key, "full")
    same = (F.col("a.samples") == F.col("b.samples")) & (F.col("a.digest") == F.col("b.digest"))
    return both.where(~F.coalesce(same, F.lit(False))).select(*key)
