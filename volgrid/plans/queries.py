"""Registered queries: every operator run over the given tables.

Each takes ``(spark, sf_dir)``. Doubles are rounded where two engines may add in a different
order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hashing import hash_unit
from ..operators import assemble, features, grid, latency, metrics, model, ordering, quality
from ..operators import split as splits
from ..operators import stats
from ..schemas import (
    BOOK_VALUES,
    BUCKET_KEY,
    FEATURES,
    SAMPLE,
    SHUFFLE_SEED,
    SLOT_KEY,
    SPLIT_SEED,
    TRADE_VALUES,
)
from ..session import scratch_path
from ..sources import fixtures, requests, tables
from ..streaming import scoring
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARD = 64  # samples per shard where the table has one row per bucket
BATCH = 64
CONSUMERS = 4


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, names: list[str] | None = None) -> DataFrame:
    """Doubles (or the named columns) rounded; adding 0.0 turns -0.0 into 0.0."""
    chosen = names or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in chosen})


# --- sources and sinks -------------------------------------------------------------------


@query
def scan_labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labels-csv")
    fixtures.labels(spark, sf_dir).write.option("header", True).csv(path)
    return rounded(tables.read_labels_csv(spark, path))


def _stored(spark: SparkSession, name: str, table: DataFrame) -> str:
    path = scratch_path(spark, name)
    tables.write_by_stock(table, path)
    return path


@query
def scan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, "book", fixtures.book(spark, sf_dir))
    return rounded(tables.read_book(spark, path).select(*SLOT_KEY, *BOOK_VALUES))


@query
def scan_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, "trade", fixtures.trade(spark, sf_dir))
    return tables.read_trade(spark, path).select(*SLOT_KEY, *TRADE_VALUES)


@query
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, "book", fixtures.book(spark, sf_dir))
    book = tables.read_book(spark, path).select(*SLOT_KEY, *BOOK_VALUES)
    return rounded(tables.bucket_lookup(book, stock_id=0, time_id=5))


@query
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    tables.write_index(splits.assign_split(fixtures.labels(spark, sf_dir)), path)
    return rounded(tables.read_index(spark, path))


def _built(spark: SparkSession, sf_dir: str) -> str:
    """Samples, statistics and manifests of the derived market."""
    out = scratch_path(spark, "built")
    labels = fixtures.labels(spark, sf_dir)
    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    jobs.build_job(spark, labels, book, trade, out, shard_size=SHARD)
    return out


@query
def shards_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in stored order, with their size instead of their 8,400 values."""
    samples = tables.read_samples(spark, f"{_built(spark, sf_dir)}/samples")
    return samples.select(
        *BUCKET_KEY,
        "split",
        "shard_id",
        "pos",
        F.round(F.col("y_log").cast("double"), 4).alias("y_log"),
        F.size("x").alias("seconds"),
        F.size(F.flatten("x")).alias("cells"),
    )


@query
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of every split, its statistics as one row per feature."""
    built = _built(spark, sf_dir)
    rows = []
    for name in splits.SPLITS:
        one = tables.read_manifest(spark, f"{built}/manifest/{name}")
        zipped = F.arrays_zip("feature_cols", "norm.mean", "norm.std")
        rows.append(
            one.select(
                F.lit(name).alias("split"),
                "num_shards",
                "shard_size",
                "norm.count_seconds",
                "norm.source",
                F.inline(zipped).alias("feature", "mean", "std"),
            )
        )
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), 3)


def _mean_model() -> model.Predictor:
    """Test model: mean of a sample's values, missing ones as 0."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        def predict(x: np.ndarray) -> np.ndarray:
            return np.nan_to_num(x.astype(np.float64)).mean(axis=(1, 2))

        return predict

    return load


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.bucket_tensor(features.bucket_features(*fixtures.market(spark, sf_dir)))


@query
def score_json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per bucket: its sample as JSON text, answered as JSON text."""
    name = F.concat_ws("-", *BUCKET_KEY).alias("request_id")
    body = F.to_json(F.struct(F.array("x").alias("x"))).alias("body")
    sent = _tensors(spark, sf_dir).select(name, body)
    parsed = requests.parse_json_requests(sent)
    width = len(FEATURES)
    answers = model.score_requests(
        parsed, _mean_model(), [0.0] * width, [1.0] * width, ["request_id"]
    )
    replies = requests.encode_json_responses(answers)
    y = F.from_json("response", "y array<double>")["y"][0]
    return rounded(replies.select("request_id", F.ln(y + scalars.EPS).alias("y_log")), 6)


@query
def synthetic_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark input for every bucket of the market: whether its values are standard normal,
    within five deviations of mean and spread, and the same when made again."""
    buckets = fixtures.buckets(spark, sf_dir)
    samples = requests.synthetic_samples(buckets, len(FEATURES))
    again = requests.synthetic_samples(buckets.repartition(7, *BUCKET_KEY), len(FEATURES))
    cells = F.flatten("x")
    n = F.size(cells)
    total = F.aggregate(cells, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(cells, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    moments = samples.select(
        *BUCKET_KEY,
        n.cast("long").alias("cells"),
        (F.abs(total / n) < 5 / F.sqrt(n)).alias("centred"),
        (F.abs(squares / n - 1) < 5 * F.sqrt(2 / n)).alias("scaled"),
        F.xxhash64("x").alias("_made"),
    )
    repeated = again.select(*BUCKET_KEY, F.xxhash64("x").alias("_again"))
    same = (F.col("_made") == F.col("_again")).alias("repeatable")
    return moments.join(repeated, BUCKET_KEY).select(*BUCKET_KEY, "cells", "centred", "scaled", same)


# --- split -------------------------------------------------------------------------------


@query
def derive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fixtures.order_keys(spark, sf_dir).select("stock_id", "time_id")
    return splits.derive_paths(keys, "raw/book_train.parquet", "raw/trade_train.parquet")


@query
def hash_unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fixtures.order_keys(spark, sf_dir).select("stock_id", "time_id")
    return rounded(keys.withColumn("unit", hash_unit(BUCKET_KEY, SPLIT_SEED)), 9)


QUERIES["hash_unit"] = QUERIES.pop("hash_unit_keys")


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_split(fixtures.order_keys(spark, sf_dir).drop("target"))


@query
def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = splits.assign_split(fixtures.order_keys(spark, sf_dir))
    return splits.route_split(index, "validation")


@query
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_balance(splits.assign_split(fixtures.order_keys(spark, sf_dir)))


# --- grid and features ---------------------------------------------------------------------


@query
def book_trade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = grid.merge_book_trade(fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir))
    return rounded(merged)


@query
def book_trade_merge_book_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    return rounded(grid.merge_book_trade(book, trade, keep_trade_only=False))


@query
def densify_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.densify(*fixtures.market(spark, sf_dir)))


@query
def asof_book_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.asof_book(*fixtures.market(spark, sf_dir)))


@query
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill over the dense rows themselves."""
    dense = grid.densify(*fixtures.market(spark, sf_dir))
    filled = [grid.ffill(c).alias(c) for c in (*BOOK_VALUES, *TRADE_VALUES)]
    return rounded(dense.select(*SLOT_KEY, *filled))


def _feature_columns(*names: str) -> Query:
    """The frame pruned to some features: unused fills and sums leave the plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = features.bucket_features(*fixtures.market(spark, sf_dir)).select(*SLOT_KEY, *names)
        flag = "last_trade_gap_geq_cap"
        if flag in names:
            frame = frame.withColumn(flag, F.col(flag).cast("int"))
        return rounded(frame)

    return run


@query
def wap_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = grid.densify(*fixtures.market(spark, sf_dir))
    return rounded(dense.select(*SLOT_KEY, features.wap().alias("wap")))


QUERIES["wap_last"] = _feature_columns("wap_last")
QUERIES["trade_fill"] = _feature_columns("size", "order_count")
QUERIES["staleness"] = _feature_columns(
    "seconds_since_last_wap", "seconds_since_last_trade", "last_trade_gap_geq_cap"
)
QUERIES["log_return"] = _feature_columns("log_return")
QUERIES["rolling_rv"] = _feature_columns("rv_30s", "rv_120s")
QUERIES["spread_mid"] = _feature_columns("spread_last", "mid_last", "rel_spread_last")
QUERIES["book_imbalance"] = _feature_columns("ofi_last")
QUERIES["order_intensity"] = _feature_columns("order_intensity_60s")
QUERIES["bucket_features"] = _feature_columns(*FEATURES)


@query
def bucket_rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.bucket_rv(*fixtures.market(spark, sf_dir)), 8)


@query
def label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fixtures.labels(spark, sf_dir)
    book, trade = fixtures.book(spark, sf_dir), fixtures.trade(spark, sf_dir)
    attached = assemble.attach_labels(labels, book, trade)
    return rounded(attached.select(*SLOT_KEY, "target", "wap_last", "rv_30s"))


@query
def bucket_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tensors(spark, sf_dir)


@query
def bucket_tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices unpacked again: shows that rows and columns are where they should be."""
    rows = assemble.tensor_rows(_tensors(spark, sf_dir))
    return rounded(rows, 4, FEATURES)


@query
def log_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fixtures.labels(spark, sf_dir)
    logged = labels.withColumn("y_log", scalars.log_label("target"))
    return rounded(logged.withColumn("y", scalars.exp_label("y_log")), 8)


@query
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shape_report(_tensors(spark, sf_dir), len(FEATURES))


@query
def duplicate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes that share a slot, before the latest one is kept."""
    raw = fixtures.raw_slots(spark, sf_dir)
    return quality.duplicate_keys(raw)


@query
def pred_truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecasts = fixtures.forecasts(spark, sf_dir).select(*BUCKET_KEY, "pred")
    return rounded(metrics.join_truth(forecasts, fixtures.labels(spark, sf_dir)), 8)


# --- statistics ------------------------------------------------------------------------------


def _split_features(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Features of one split's buckets; the split is decided per bucket, not per second."""
    index, book, trade = fixtures.market(spark, sf_dir)
    chosen = splits.route_split(splits.assign_split(index), split)
    return features.bucket_features(chosen, book, trade)


@query
def norm_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.norm_moments(_split_features(spark, sf_dir, "train")), 5)


@query
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = stats.fit_norm(_split_features(spark, sf_dir, "train"))
    names = F.array(*map(F.lit, FEATURES)).alias("feature")
    rows = norm.select("count_seconds", F.inline(F.arrays_zip(names, "mean", "std")))
    return rounded(rows)


def _normalized(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Fitted and applied on stored features, so that each split's are computed once."""

    def stored(name: str) -> DataFrame:
        path = scratch_path(spark, "features")
        _split_features(spark, sf_dir, name).write.parquet(path)
        return spark.read.parquet(path)

    train = stored("train")
    wanted = train if split == "train" else stored(split)
    scaled = stats.apply_norm(wanted, stats.fit_norm(train))
    return rounded(scaled.select(*SLOT_KEY, *FEATURES), 5)


@query
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir, "train")


@query
def normalize_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir, "eval")


@query
def normalize_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation split by the train statistics, one row per value."""
    scaled = _normalized(spark, sf_dir, "validation")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in FEATURES])
    return scaled.select(*SLOT_KEY, F.inline(values))


def _rough_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values with special numbers mixed in by event id."""
    kind = F.col("event_id") % 7
    value = F.col("value")
    rough = (
        F.when(kind == 0, F.lit(float("nan")))
        .when(kind == 1, F.lit(float("inf")))
        .when(kind == 2, F.lit(float("-inf")))
        .when(kind == 3, F.lit(None).cast("double"))
        .when(kind == 4, (value - 40) / 4)
        .when(kind == 5, (value - 40) * 40)
        .otherwise(value - 40)
    )
    return fixtures.table(spark, sf_dir, "events").select("event_id", rough.alias("raw"))


@query
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _rough_values(spark, sf_dir)
    return rounded(
        values.select(
            "event_id",
            scalars.sanitize("raw", normalized=True).alias("normalized"),
            scalars.sanitize("raw", normalized=False).alias("raw_scale"),
        )
    )


@query
def safe_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _rough_values(spark, sf_dir)
    return rounded(
        values.select(
            "event_id",
            scalars.safe_log_prediction("raw").alias("y_log"),
            F.ln(scalars.safe_exp("raw") + 2e-8).alias("log_y"),
        )
    )


@query
def nonfinite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.nonfinite_report(_rough_values(spark, sf_dir), ["raw"])


# --- metrics -----------------------------------------------------------------------------


@query
def mspe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mspe(fixtures.predictions(spark, sf_dir)), 7)


@query
def log_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.log_mse(fixtures.predictions(spark, sf_dir)), 7)


@query
def rmspe_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = metrics.batch_losses(
        fixtures.predictions(spark, sf_dir).withColumn("batch", F.col("l_orderkey") % 1000),
        ["batch"],
    )
    return rounded(metrics.rmspe_from_batches(batches), 7)


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.eval_report(fixtures.predictions(spark, sf_dir)), 4)


@query
def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.eval_report(fixtures.predictions(spark, sf_dir), ["l_returnflag"]), 4)


@query
def mspe_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.mspe_gradient(fixtures.predictions(spark, sf_dir))
    return rounded(rows.select(*fixtures.PREDICTION_KEY, "gradient"), 10)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per prediction: epochs are months, steps follow the seeded hash of the key."""
    rows = fixtures.predictions(spark, sf_dir)
    keys = fixtures.PREDICTION_KEY
    ties = [*keys, "y", "pred"]
    ranked = ordering.hash_rank(rows, hash_unit(keys, SHUFFLE_SEED), ties, "rank", ["epoch"])
    return metrics.batch_losses(ranked.withColumn("step", F.col("rank") + 1), ["epoch", "step"])


@query
def running_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.running_metric(_steps(spark, sf_dir)), 7)


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.predictions(spark, sf_dir)
    return metrics.epoch_metric(metrics.batch_losses(rows, ["epoch", "l_returnflag"]))


@query
def epoch_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_epochs(spark, sf_dir), 7)


@query
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_so_far(_epochs(spark, sf_dir)), 7)


@query
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_epoch(_epochs(spark, sf_dir)), 7)


# --- shards, shuffles, batches ---------------------------------------------------------------


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.assign_shards(fixtures.order_keys(spark, sf_dir))


@query
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = _sharded(spark, sf_dir).withColumn("y_log", scalars.log_label("target"))
    return rounded(sharded.drop("target"))


@query
def shard_assign_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = splits.assign_split(fixtures.order_keys(spark, sf_dir))
    return ordering.assign_shards(index.drop("target"), group=["split"])


def _small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.assign_shards(fixtures.order_keys(spark, sf_dir), shard_size=SHARD)


@query
def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffle_shards(ordering.shard_table(_small_shards(spark, sf_dir)))


@query
def sample_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffle_samples(_sharded(spark, sf_dir).drop("target", "pos"))


@query
def consumer_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = ordering.shard_table(_small_shards(spark, sf_dir))
    return ordering.slice_consumers(ordering.shuffle_shards(shards), CONSUMERS)


@query
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _small_shards(spark, sf_dir).drop("target", "pos")
    shards = ordering.exact_shards(fixtures.order_keys(spark, sf_dir), SHARD)
    return ordering.assign_batches(samples, BATCH, CONSUMERS, shards=shards)


# --- latency -------------------------------------------------------------------------------


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latency.latency_summary(fixtures.timings(spark, sf_dir), 32))


@query
def latency_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = latency.latency_report(fixtures.timings(spark, sf_dir), 32, {"batch_size": 32})
    return rounded(report.withColumn("batch_size", F.col("config.batch_size")).drop("config"))


# --- fitting and scoring -------------------------------------------------------------------


def _fit_row(spark: SparkSession, fitted: dict[str, float | list[float]]) -> DataFrame:
    row = (fitted["weights"][0], fitted["intercept"])
    return rounded(spark.createDataFrame([row], "slope double, intercept double"))


@query
def fit_log_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.fit_log_mse(fixtures.predictions(spark, sf_dir), ["pred_log"])
    return _fit_row(spark, model.coefficients(fitted))


@query
def fit_mspe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = model.fit_mspe(fixtures.predictions(spark, sf_dir), ["pred"])
    return _fit_row(spark, model.coefficients(fitted))


@query
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all predictions, then score them with the fitted columns."""
    rows = fixtures.predictions(spark, sf_dir)
    scored = model.score_linear(rows, ["pred_log"], model.fit_log_mse(rows, ["pred_log"]))
    return rounded(scored.select(*fixtures.PREDICTION_KEY, "y_log_pred"))


@query
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices through a Python model in Arrow batches, then output sanitation."""
    frame = features.bucket_features(*fixtures.market(spark, sf_dir))
    norm = stats.fit_norm(frame).first()
    scored = model.score_samples(
        assemble.bucket_tensor(frame), _mean_model(), norm["mean"], norm["std"], BUCKET_KEY
    )
    return rounded(model.sane_predictions(scored), 3)


@query
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a file stream: samples arrive as files, predictions are appended."""
    built = _built(spark, sf_dir)
    norm = jobs.read_norm(spark, built).first()
    out = scratch_path(spark, "scored")
    samples = scoring.read_sample_stream(spark, f"{built}/samples", SAMPLE)
    keep = [*BUCKET_KEY, "split"]
    scoring.score_sample_stream(
        samples,
        _mean_model(),
        norm["mean"],
        norm["std"],
        keep,
        f"{out}/table",
        f"{out}/progress",
        available_now=True,
    ).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/table"), 3)


@query
def score_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored samples scored by a model of one's own and reported on, through the jobs."""
    built = _built(spark, sf_dir)
    out = scratch_path(spark, "predictions")
    jobs.score_job(
        spark, f"{built}/samples", f"{built}/manifest/train", _mean_model(), out, "log", sanitize=True
    )
    return rounded(jobs.report_job(spark, out), 3)


@query
def eval_report_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report on predictions of which a third are missing: means over the others, and how many."""
    rows = fixtures.predictions(spark, sf_dir)
    kept = F.when(F.col("l_partkey") % 3 != 0, F.col("pred_log"))
    report = metrics.eval_report(
        rows.withColumn("pred_log", kept), ["l_returnflag"], missing="skip"
    )
    return rounded(report, 4)


@query
def train_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, features, statistics, fits, choice and report, for both losses."""
    built = _built(spark, sf_dir)
    reports = []
    for loss in jobs.LOSSES:
        trained, report = jobs.train_eval_job(spark, built, loss)
        reports.append(
            report.withColumns({"loss": F.lit(loss), "reg": F.lit(float(trained.reg))})
        )
    return rounded(reports[0].unionByName(reports[1]), 6)
