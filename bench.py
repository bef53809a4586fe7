"""Times the headline work at ``$BENCH_SF_DIR`` and prints one JSON line.

Each entry runs once to warm up (classes, code generation) and is then timed ``REPEATS`` times;
the shortest time counts. Results go to the ``noop`` sink, which computes every column of every
row. ``samples_per_sec`` sets building and scoring against the published serving throughput;
the published model runs on a GPU, ours here is a small linear one, so the figures compare the
data path and not the model.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volgrid.functions.hashing import hash_unit
from volgrid.operators import assemble, epochs, features, latency, metrics, model, ordering, quota, split, stats
from volgrid.plans import queries as registered
from volgrid.schemas import FEATURES, SHUFFLE_SEED
from volgrid.session import build_session, scratch_path
from volgrid.sources import fixtures, layout, requests, tables

STOCKS = 64
REPEATS = 2
WIDTH = len(FEATURES)
LOAD_SAMPLES = 12_800  # 400 requests of 32 samples, as in the published load


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def linear_model() -> Callable[[], model.Predictor]:
    def load() -> model.Predictor:
        weights = np.linspace(-0.1, 0.1, 14, dtype=np.float32)
        return lambda x: np.nan_to_num(x).mean(axis=1) @ weights

    return load


def prepare(spark: SparkSession, sf_dir: str) -> dict:
    """Stored market tables, samples and requests, so that entries time one stage each."""
    root = scratch_path(spark, "bench")
    index, book, trade = fixtures.market(spark, sf_dir, STOCKS)
    frames = {"index": index.withColumn("target", F.lit(0.01)), "book": book, "trade": trade}
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}")
    stored = {name: spark.read.parquet(f"{root}/{name}") for name in frames}
    tables.write_samples(
        assemble.build_samples(stored["index"], stored["book"], stored["trade"], shard_size=256),
        f"{root}/samples",
    )
    stored["samples"] = tables.read_samples(spark, f"{root}/samples")
    load = requests.synthetic_samples(spark.range(LOAD_SAMPLES), WIDTH)
    load.write.parquet(f"{root}/load")
    stored["load"] = spark.read.parquet(f"{root}/load")
    by_request = stored["load"].groupBy((F.col("id") % (LOAD_SAMPLES // 32)).alias("request"))
    body = F.to_json(F.struct(F.collect_list("x").alias("x"))).alias("body")
    by_request.agg(body).write.parquet(f"{root}/requests")
    stored["requests"] = spark.read.parquet(f"{root}/requests")
    name = root.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored["layout"] = f"bench_index_{name}", f"bench_slots_{name}"
    layout.write_index(stored["index"], stored["layout"][0], f"{root}/layout-index", buckets)
    layout.write_slots(stored["book"], stored["trade"], stored["layout"][1], f"{root}/layout-slots", buckets)
    ordering.assign_shards(fixtures.order_keys(spark, sf_dir).drop("target"), 64).write.parquet(f"{root}/sharded")
    stored["sharded"] = spark.read.parquet(f"{root}/sharded")
    return stored


def entries(
    spark: SparkSession, sf_dir: str, t: dict
) -> dict[str, Callable[[], DataFrame]]:
    market = (t["index"], t["book"], t["trade"])
    zeros, ones = [0.0] * WIDTH, [1.0] * WIDTH
    orders = fixtures.order_keys(spark, sf_dir)
    predictions = fixtures.predictions(spark, sf_dir)
    keys = fixtures.PREDICTION_KEY

    def steps() -> DataFrame:
        ranked = ordering.hash_rank(
            predictions, hash_unit(keys, SHUFFLE_SEED), [*keys, "y", "pred"], "rank", ["epoch"]
        )
        numbered = ranked.withColumn("step", F.col("rank") + 1)
        return metrics.batch_losses(numbered, ["epoch", "step"])

    def fitted() -> DataFrame:
        return model.score_linear(
            predictions, ["pred_log"], model.fit_log_mse(predictions, ["pred_log"])
        )

    def answered() -> DataFrame:
        parsed = requests.parse_json_requests(t["requests"])
        answers = model.score_requests(parsed, linear_model(), zeros, ones, ["request"])
        return requests.encode_json_responses(answers)

    return {
        "market_from_events": lambda: features.bucket_rv(*fixtures.market(spark, sf_dir, STOCKS)),
        "bucket_rv": lambda: features.bucket_rv(*market),
        "bucket_features": lambda: features.bucket_features(*market),
        "bucket_features_unique": lambda: features.bucket_features(*market, unique_slots=True),
        "build_samples": lambda: assemble.build_samples(*market, unique_slots=True),
        "build_samples_copies": lambda: assemble.build_samples(*market),
        "norm_stats": lambda: stats.fit_norm(assemble.tensor_rows(t["samples"])),
        "features_layout": lambda: layout.bucket_features(spark, *t["layout"]),
        "hash_split": lambda: split.assign_split(orders),
        "split_exact": lambda: quota.assign_split_exact(orders),
        "epoch_order": lambda: epochs.epoch_order(t["sharded"], t["sharded"].count(), 1, 64),
        "shard_assign": lambda: ordering.assign_shards(orders),
        "batch_assign": lambda: ordering.assign_batches(
            ordering.assign_shards(orders).drop("target", "pos"),
            shards=ordering.exact_shards(orders),
        ),
        "eval_report": lambda: metrics.eval_report(predictions, ["l_returnflag"]),
        "mspe_gradient": lambda: metrics.mspe_gradient(predictions),
        "running_metric": lambda: metrics.running_metric(steps()),
        "latency_by_mode": lambda: latency.latency_summary(
            fixtures.timings(spark, sf_dir), 32, ["mode"]
        ),
        "fit_and_score_linear": fitted,
        "score_samples": lambda: model.sane_predictions(
            model.score_samples(t["load"], linear_model(), zeros, ones, ["id"]), "log"
        ),
        "score_json": answered,
        "synthetic_samples": lambda: registered.QUERIES["synthetic_samples"](spark, sf_dir),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "volgrid-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored = prepare(spark, sf_dir)
    seconds = {}
    for name, build in entries(spark, sf_dir, stored).items():
        times = []
        for _ in range(1 + REPEATS):
            start = time.perf_counter()
            sink(build())
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    built = stored["index"].count()
    rates = {
        "build_samples": round(built / seconds["build_samples"], 1),
        "score_samples": round(LOAD_SAMPLES / seconds["score_samples"], 1),
        "score_json": round(LOAD_SAMPLES / seconds["score_json"], 1),
    }
    report = {
        "metric": "total of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "samples_per_sec": rates,
        "published_samples_per_sec": {"score_samples": 948.31, "score_json": 85.71},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
