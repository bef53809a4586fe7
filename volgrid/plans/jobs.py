"""The stages as Spark jobs: index, build, fit and evaluate, score, serve, latency.

``python -m volgrid.plans.jobs <stage> --help`` lists a stage's arguments. Each stage reads and
writes tables, so a stage can be run again without the ones before it.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import exp_label, log_label
from ..operators import assemble, boosting, latency, metrics, model, quality, regpath, split, stats
from ..schemas import BUCKET_KEY, EPS, EVAL_FRACTION, FEATURES, SHARD_SIZE, SPLIT_SEED, VALIDATION_FRACTION
from ..session import build_session, scratch_path
from ..sources import tables
from ..streaming import scoring
from . import increments

LOSSES = ("log_mse", "rmspe")
REGS = (0.0, 0.001, 0.01, 0.1)


def index_job(
    spark: SparkSession,
    labels_path: str,
    out: str,
    eval_fraction: float = EVAL_FRACTION,
    validation_fraction: float = VALIDATION_FRACTION,
    seed: int = SPLIT_SEED,
) -> None:
    """Label CSV to an index table, one folder per split."""
    labels = tables.read_labels_csv(spark, labels_path)
    index = split.assign_split(
        labels, eval_fraction=eval_fraction, validation_fraction=validation_fraction, seed=seed
    )
    tables.write_index(index, out)


def build_job(
    spark: SparkSession,
    labels: DataFrame,
    book: DataFrame,
    trade: DataFrame,
    out: str,
    shard_size: int = SHARD_SIZE,
    unique_slots: bool = True,
    columns: list[str] = FEATURES,
) -> None:
    """Samples of all splits, and a manifest per split with the train statistics.

    The sample table is written once and the statistics are taken from it, so features are
    computed a single time.
    """
    samples = assemble.build_samples(
        labels, book, trade, columns, shard_size=shard_size, unique_slots=unique_slots
    )
    tables.write_samples(samples, f"{out}/samples")
    train = tables.read_samples(spark, f"{out}/samples", "train")
    norm = stats.fit_norm(assemble.tensor_rows(train, columns), columns)
    tables.write_json(norm, f"{out}/norm")
    saved = read_norm(spark, out)
    stored = tables.read_samples(spark, f"{out}/samples")
    for name in split.SPLITS:
        shards = stored.where(F.col("split") == name).select("shard_id").distinct()
        tables.write_json(
            tables.manifest(shards, saved, columns, shard_size, name == "train"),
            f"{out}/manifest/{name}",
        )


def read_norm(spark: SparkSession, out: str) -> DataFrame:
    schema = "mean array<double>, std array<double>, count_seconds bigint, source string"
    return spark.read.schema(schema).json(f"{out}/norm")


def built_features(spark: SparkSession, out: str) -> list[str]:
    """The feature list that a build was made with, in its order."""
    return tables.read_manifest(spark, f"{out}/manifest/train").first()["feature_cols"]


def model_features(columns: list[str]) -> list[str]:
    """Inputs of the linear models: the features, and the log volatility where it is known."""
    return [*columns, "log_rv"] if "log_return" in columns else list(columns)


def model_rows(samples: DataFrame, norm: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Fitting rows: normalized, sanitized summary of each sample with its label.

    ``columns`` are the features of the samples and of ``norm``, in their order.
    """
    summary = assemble.summarize_samples(samples, columns)
    normal = stats.apply_norm(summary, norm, columns)
    clean = stats.sanitize_columns(normal, columns)
    if "log_return" in columns:
        clean = clean.withColumn("log_rv", log_label("rv"))
    checked = quality.require_finite(clean, ["y_log"])
    return checked.select("stock_id", "time_id", "split", "y_log", *model_features(columns))


@dataclass
class Trained:
    """A chosen linear model and the validation metric of every candidate."""

    features: list[str]
    loss: str
    reg: float
    fitted: regpath.Linear
    epochs: DataFrame | None = None

    def predict_log(self, rows: DataFrame, name: str = "y_log_pred") -> DataFrame:
        """Add the log prediction. The percentage-error fit predicts the real scale."""
        scored = model.score_linear(rows, self.features, self.fitted, name)
        if self.loss == "rmspe":
            return scored.withColumn(name, log_label(F.greatest(F.col(name), F.lit(0.0))))
        return scored


def _train_sums(train: DataFrame, features: list[str], loss: str) -> regpath.Sums:
    """Everything that a linear model under this loss needs of the rows."""
    if loss == "log_mse":
        return regpath.total(regpath.fold_sums(train, features, "y_log", folds=1))
    if loss != "rmspe":
        raise ValueError(f"unknown loss: {loss}")
    y = exp_label("y_log")
    # A row's weight turns the squared error into the squared percentage error.
    weighted = train.withColumn("_y", y).withColumn("_weight", 1 / ((y + F.lit(EPS)) * (y + F.lit(EPS))))
    return regpath.total(regpath.fold_sums(weighted, features, "_y", folds=1, weight="_weight"))


def fit_job(
    spark: SparkSession,
    rows: DataFrame,
    loss: str = "log_mse",
    regs: tuple[float, ...] = REGS,
    features: list[str] | None = None,
) -> Trained:
    """One candidate per regularization on train; the best by validation RMSPE.

    Train is read once, for the sums that all candidates are solved from, and validation once, for
    the errors of all of them.
    """
    names = features or [c for c in rows.columns if c not in (*BUCKET_KEY, "split", "y_log")]
    sums = _train_sums(rows.where(F.col("split") == "train"), names, loss)
    candidates = [Trained(names, loss, float(reg), sums.solve(reg)) for reg in regs]
    validation = rows.where(F.col("split") == "validation")
    for i, candidate in enumerate(candidates):
        validation = candidate.predict_log(validation, f"_pred_{i}")
    each = [F.struct(F.lit(i).alias("epoch"), F.col(f"_pred_{i}").alias("y_log_pred")) for i in range(len(regs))]
    stacked = validation.select("y_log", F.inline(F.array(*each)))
    # One row a candidate.
    found = metrics.eval_report(stacked, ["epoch"], pred_log="y_log_pred").collect()
    errors = {r["epoch"]: float(r["rmspe"]) for r in found}
    scores = [(i, c.reg, errors.get(i)) for i, c in enumerate(candidates)]
    epochs = spark.createDataFrame(scores, "epoch int, reg double, metric double")
    best = candidates[metrics.best_epoch(epochs).first()["epoch"]]
    best.epochs = metrics.best_so_far(epochs)
    return best


def evaluate_job(rows: DataFrame, trained: Trained, by: list[str] | None = None) -> DataFrame:
    """Report on the eval split."""
    held_out = rows.where(F.col("split") == "eval")
    return metrics.eval_report(trained.predict_log(held_out), by, pred_log="y_log_pred")


def train_eval_job(
    spark: SparkSession,
    out: str,
    loss: str = "log_mse",
    regs: tuple[float, ...] = REGS,
    features: list[str] | None = None,
) -> tuple[Trained, DataFrame]:
    """Fit, choose and evaluate on a built sample table, with the features it was built with.

    ``features`` picks some of the model's inputs (see ``model_features``).
    """
    samples = tables.read_samples(spark, f"{out}/samples")
    # The summary has one short row per sample. It is read several times, so it is written as a
    # table instead of being derived from the matrices each time.
    summary = scratch_path(spark, "summary")
    model_rows(samples, read_norm(spark, out), built_features(spark, out)).write.parquet(summary)
    rows = spark.read.parquet(summary)
    trained = fit_job(spark, rows, loss, regs, features)
    return trained, evaluate_job(rows, trained)


def boost_eval_job(spark: SparkSession, out: str, rounds: int = 20, depth: int = 3) -> tuple[boosting.Boosted, DataFrame]:
    """Boosted trees under the percentage error, fitted on train, and their report on eval.

    Same rows as the linear models; trees do not mind the scale or the order of features.
    """
    columns = built_features(spark, out)
    samples = tables.read_samples(spark, f"{out}/samples")
    path = scratch_path(spark, "summary")
    model_rows(samples, read_norm(spark, out), columns).write.parquet(path)
    rows = spark.read.parquet(path)
    train = rows.where(F.col("split") == "train").withColumn("y", exp_label("y_log"))
    fitted = boosting.fit_boosted(train, model_features(columns), "y", rounds=rounds, depth=depth)
    held_out = fitted.predict(rows.where(F.col("split") == "eval"), "y_pred")
    scored = held_out.withColumn("y_log_pred", log_label(F.greatest(F.col("y_pred"), F.lit(0.0))))
    return fitted, metrics.eval_report(scored, pred_log="y_log_pred")


def score_job(
    spark: SparkSession,
    samples_path: str,
    manifest_path: str,
    load: Callable[[], model.Predictor],
    out: str,
    output: str = "real",
    sanitize: bool = False,
) -> None:
    """Predictions of every stored sample, with the statistics of a manifest.

    With ``sanitize``, inputs are made finite and clamped, and a label or prediction that is not
    finite fails the job: predictions for ``report_job``.
    """
    norm = tables.manifest_stats(tables.read_manifest(spark, manifest_path)).first()
    samples = tables.read_samples(spark, samples_path)
    keep = [*BUCKET_KEY, "split", "y_log"]
    if sanitize:
        samples = quality.require_finite(samples, ["y_log"])
    scored = model.score_samples(samples, load, norm["mean"], norm["std"], keep, sanitize=sanitize)
    model.sane_predictions(scored, output).write.parquet(out)


def report_job(
    spark: SparkSession,
    predictions_path: str,
    split_name: str = "eval",
    by: list[str] | None = None,
    missing: str = "error",
) -> DataFrame:
    """Report on stored predictions of any model (``split, y_log, y_log_pred``)."""
    scored = spark.read.parquet(predictions_path).where(F.col("split") == split_name)
    return metrics.eval_report(scored, by, pred_log="y_log_pred", missing=missing)


def epochs_job(
    spark: SparkSession, predictions_path: str, split_name: str = "validation", missing: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """Metric of every epoch of a model of one's own, and the best one.

    Predictions are stored with an ``epoch``, as by ``score`` into one folder ``epoch=...`` each.
    """
    report = report_job(spark, predictions_path, split_name, ["epoch"], missing)
    epochs = metrics.best_so_far(report.select("epoch", F.col("rmspe").alias("metric"), "rmse", "count"))
    return epochs, metrics.best_epoch(epochs)


def serve_job(
    spark: SparkSession,
    requests_path: str,
    manifest_path: str,
    load: Callable[[], model.Predictor],
    out: str,
    progress: str,
    until_done: bool = False,
) -> None:
    """Answer JSON requests as their files arrive; ``until_done`` stops after those present."""
    norm = tables.manifest_stats(tables.read_manifest(spark, manifest_path)).first()
    arriving = scoring.read_request_stream(spark, requests_path)
    scoring.score_request_stream(
        arriving, load, norm["mean"], norm["std"], out, progress, until_done
    ).awaitTermination()


def _named(reference: str) -> Callable[[], model.Predictor]:
    """``package.module:function``, importable by driver and executors."""
    module, _, name = reference.partition(":")
    return getattr(importlib.import_module(module), name)


def latency_job(
    spark: SparkSession, timings_path: str, out: str, batch_size: int, config: dict[str, str | int]
) -> None:
    timings = spark.read.parquet(timings_path)
    tables.write_json(latency.latency_report(timings, batch_size, config), out)


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="volgrid.plans.jobs")
    stages = parser.add_subparsers(dest="stage", required=True)

    index = stages.add_parser("index", help="split a label table")
    index.add_argument("--labels", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--eval-fraction", type=float, default=EVAL_FRACTION)
    index.add_argument("--validation-fraction", type=float, default=VALIDATION_FRACTION)
    index.add_argument("--seed", type=int, default=SPLIT_SEED)

    build = stages.add_parser("build", help="build samples, statistics and manifests")
    build.add_argument("--index", required=True)
    build.add_argument("--append", action="store_true", help="add the buckets that earlier builds lack")
    build.add_argument("--book", required=True)
    build.add_argument("--trade", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--shard-size", type=int, default=SHARD_SIZE)
    build.add_argument(
        "--unique-slots",
        action=argparse.BooleanOptionalAction,
        default=True,
        help="no: book or trade hold copies of rows, which are combined before a second shuffle",
    )
    build.add_argument("--features", nargs="+", choices=FEATURES, default=FEATURES, metavar="NAME")

    fit = stages.add_parser("evaluate", help="fit, choose by validation and evaluate, or report on predictions")
    what = fit.add_mutually_exclusive_group(required=True)
    what.add_argument("--built")
    what.add_argument("--predictions", help="output of score, of a model of any kind")
    fit.add_argument("--loss", choices=LOSSES, default="log_mse")
    fit.add_argument("--out", required=True)
    choose = stages.add_parser("epochs", help="metric per epoch of stored predictions, and the best epoch")
    choose.add_argument("--predictions", required=True, help="with a column or folders epoch=...")
    choose.add_argument("--out", required=True)
    for stage, default in ((fit, "eval"), (choose, "validation")):
        stage.add_argument("--split", choices=split.SPLITS, default=default, help="of the predictions")
        stage.add_argument("--missing", choices=["error", "skip"], default="error", help="missing predictions")
    fit.add_argument("--model", choices=["linear", "boosted"], default="linear")
    fit.add_argument("--by", nargs="*", metavar="COLUMN", help="report on predictions per group")

    score = stages.add_parser("score", help="score stored samples")
    score.add_argument("--samples", required=True)
    score.add_argument("--output", choices=["real", "log"], default="real")
    score.add_argument("--sanitize", action="store_true", help="clean inputs, fail on non-finite values")
    serve = stages.add_parser("serve", help="answer JSON requests as a stream")
    serve.add_argument("--requests", required=True)
    serve.add_argument("--progress", required=True, help="checkpoint folder of the stream")
    serve.add_argument("--until-done", action="store_true")
    for stage in (score, serve):
        stage.add_argument("--manifest", required=True)
        stage.add_argument("--predictor", required=True, help="package.module:function")
        stage.add_argument("--out", required=True)

    timing = stages.add_parser("latency", help="summarize request timings")
    timing.add_argument("--timings", required=True)
    timing.add_argument("--out", required=True)
    timing.add_argument("--batch-size", type=int, default=32)
    timing.add_argument(
        "--config", nargs="*", default=[], metavar="NAME=VALUE", help="further load settings to echo"
    )
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = build_session(f"volgrid-{args.stage}")
    if args.stage == "index":
        index_job(
            spark, args.labels, args.out, args.eval_fraction, args.validation_fraction, args.seed
        )
    elif args.stage == "build":
        make = increments.append_build if args.append else build_job
        make(
            spark,
            tables.read_index(spark, args.index),
            tables.read_book(spark, args.book),
            tables.read_trade(spark, args.trade),
            args.out,
            args.shard_size,
            args.unique_slots,
            args.features,
        )
    elif args.stage == "evaluate" and args.predictions:
        report = report_job(spark, args.predictions, args.split, args.by, args.missing)
        tables.write_json(report, f"{args.out}/report")
    elif args.stage == "epochs":
        epochs, best = epochs_job(spark, args.predictions, args.split, args.missing)
        tables.write_json(epochs, f"{args.out}/epochs")
        tables.write_json(best, f"{args.out}/best")
    elif args.stage == "evaluate" and args.model == "boosted":
        _, report = boost_eval_job(spark, args.built)
        tables.write_json(report, f"{args.out}/report")
    elif args.stage == "evaluate":
        trained, report = train_eval_job(spark, args.built, args.loss)
        tables.write_json(report, f"{args.out}/report")
        tables.write_json(trained.epochs, f"{args.out}/epochs")
    elif args.stage == "score":
        load = _named(args.predictor)
        score_job(spark, args.samples, args.manifest, load, args.out, args.output, args.sanitize)
    elif args.stage == "serve":
        serve_job(
            spark,
            args.requests,
            args.manifest,
            _named(args.predictor),
            args.out,
            args.progress,
            args.until_done,
        )
    else:
        config = {"batch_size": args.batch_size, **dict(c.split("=", 1) for c in args.config)}
        latency_job(spark, args.timings, args.out, args.batch_size, config)


if __name__ == "__main__":
    main()
