"""Fitting a log-volatility regressor and scoring samples with any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import INPUT_BOUND_NORMALIZED, exp_label, safe_exp
from ..schemas import BUCKET_SECONDS, EPS, STD_EPS
from ..session import bound_arrow_batches

Predictor = Callable[[np.ndarray], np.ndarray]
# Samples handed to the model at once; 600 x 14 floats each, so about 9 MB.
MODEL_BATCH = 256


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def fit_log_mse(
    df: DataFrame, features: list[str], y_log: str = "y_log", reg: float = 0.0
) -> LinearRegressionModel:
    """Least squares on the log label. Only the coefficients come to the driver."""
    regression = LinearRegression(
        featuresCol="_features", labelCol=y_log, regParam=reg, solver="normal"
    )
    return regression.fit(_assembled(df, features))


def fit_mspe(
    df: DataFrame, features: list[str], y_log: str = "y_log", reg: float = 0.0, eps: float = EPS
) -> LinearRegressionModel:
    """Least squares of the percentage error on the real scale.

    Weighting a row by ``1 / (y + eps)^2`` turns the squared error into the squared
    percentage error.
    """
    weighted = df.withColumn("_y", exp_label(y_log, eps)).withColumn(
        "_weight", 1 / ((F.col("_y") + F.lit(eps)) * (F.col("_y") + F.lit(eps)))
    )
    regression = LinearRegression(
        featuresCol="_features",
        labelCol="_y",
        weightCol="_weight",
        regParam=reg,
        solver="normal",
    )
    return regression.fit(_assembled(weighted, features))


def coefficients(model: LinearRegressionModel) -> dict[str, float | list[float]]:
    return {"weights": [float(w) for w in model.coefficients], "intercept": float(model.intercept)}


def linear(features: list[str], weights: list[float], intercept: float) -> Column:
    """A linear model as a column: scoring needs no Python and no extra stage."""
    total = F.lit(float(intercept))
    for name, weight in zip(features, weights, strict=True):
        total = total + F.col(name) * F.lit(float(weight))
    return total


def score_linear(
    df: DataFrame, features: list[str], model: LinearRegressionModel, name: str = "y_log_pred"
) -> DataFrame:
    fitted = coefficients(model)
    return df.withColumn(name, linear(features, fitted["weights"], fitted["intercept"]))


def _batch_scorer(
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    seconds: int,
    keep: list[str],
    clean: float | None = None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow-batch function: flat value buffers become [B, seconds, F] arrays, no per-row work.

    Everything it needs is in its closure, so executors do not import this package.
    """
    std_eps, limit = STD_EPS, MODEL_BATCH

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        center = np.asarray(mean, dtype=np.float32)
        scale = np.asarray(std, dtype=np.float32) + np.float32(std_eps)
        width = len(center)
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                piece = batch.slice(start, limit)
                x = piece.column(piece.schema.get_field_index("x"))
                rows = x.flatten()
                values = rows.flatten()
                lengths = np.asarray(x.value_lengths().fill_null(0))
                widths = np.asarray(rows.value_lengths().fill_null(0))
                if (lengths != seconds).any() or (widths != width).any():
                    raise ValueError(f"samples must have shape [{seconds}, {width}]")
                flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
                block = (flat.reshape(len(x), seconds, width) - center) / scale
                if clean is not None:
                    block = np.clip(np.nan_to_num(block, nan=0.0, posinf=0.0, neginf=0.0), -clean, clean)
                y_log = np.asarray(predict(block), dtype=np.float32).reshape(-1)
                if len(y_log) != len(x):
                    raise ValueError("the model must return one value per sample")
                if clean is not None and not np.isfinite(y_log).all():
                    raise ValueError("the model returned a prediction that is not finite")
                columns = [piece.column(piece.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(y_log, pa.float32())], [*keep, "y_log_pred"]
                )
        # The worker lives on for the tasks after this one.
        pa.default_memory_pool().release_unused()

    return score


def score_samples(
    samples: DataFrame,
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    keep: list[str],
    seconds: int = BUCKET_SECONDS,
    sanitize: bool = False,
) -> DataFrame:
    """Add ``y_log_pred`` from any model over ``x``; works on batch and streaming frames.

    ``load`` runs once per task on the executor and returns a function from a normalized
    float32 array [B, seconds, F] to B log predictions. Missing values reach it as NaN, or, with
    ``sanitize``, as 0: values that are not finite become 0, the others are clamped, and a
    prediction that is not finite fails the job. That is for evaluation, where nothing may be
    papered over. Only ``keep`` and ``x`` are sent to Python, in batches of no more samples than the
    model gets at once: a worker holds a few of them, of some 9 MB instead of Spark's 64 MB.
    """
    bound_arrow_batches(samples.sparkSession, MODEL_BATCH)
    narrow = samples.select(*keep, F.col("x").cast("array<array<float>>").alias("x"))
    fields = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, y_log_pred float" if keep else "y_log_pred float"
    clean = INPUT_BOUND_NORMALIZED if sanitize else None
    return narrow.mapInArrow(_batch_scorer(load, mean, std, seconds, keep, clean), schema)


def sane_predictions(scored: DataFrame, output: str = "real") -> DataFrame:
    """``y_pred`` on the real scale, or the raw log prediction with ``output="log"``."""
    if output == "log":
        return scored
    if output != "real":
        raise ValueError(f"unknown output scale: {output}")
    return scored.withColumn("y_pred", safe_exp("y_log_pred"))


def _request_scorer(
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    seconds: int,
    keep: list[str],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    std_eps, limit = STD_EPS, MODEL_BATCH

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        center = np.asarray(mean, dtype=np.float32)
        scale = np.asarray(std, dtype=np.float32) + np.float32(std_eps)
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            sizes = np.asarray(x.value_lengths().fill_null(0))
            flat = x.flatten().flatten().flatten().to_numpy(zero_copy_only=False)
            block = flat.astype(np.float32, copy=False).reshape(-1, seconds, len(center))
            parts = []
            for i in range(0, len(block), limit):
                piece = (block[i : i + limit] - center) / scale
                part = np.asarray(predict(piece), dtype=np.float64).reshape(-1)
                if len(part) != len(piece):
                    raise ValueError("the model must return one value per sample")
                parts.append(part)
            y_log = np.concatenate(parts) if parts else np.zeros(0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            answers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y_log, pa.float64()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, answers], [*keep, "y_log"])

    return score


def score_requests(
    requests: DataFrame,
    load: Callable[[], Predictor],
    mean: list[float],
    std: list[float],
    keep: list[str],
    seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Answer requests that hold a [B, seconds, F] tensor ``x`` each.

    Adds ``y``, one real-scale prediction per sample in order, and ``error``, set where the
    tensor is missing or has the wrong shape. A request is answered where it is: its samples
    are neither spread nor grouped again, so there is no shuffle.
    """
    width = len(mean)
    good = F.coalesce(
        F.forall(
            "x",
            lambda sample: (F.size(sample) == seconds)
            & F.forall(sample, lambda row: F.coalesce(F.size(row) == width, F.lit(False))),
        ),
        F.lit(False),
    )
    good = good & (F.size("x") > 0)
    empty = F.array().cast("array<array<array<float>>>")
    checked = requests.select(
        *keep,
        F.when(~good, F.lit(f"x must have shape [B, {seconds}, {width}]")).alias("error"),
        F.when(good, F.col("x")).otherwise(empty).alias("x"),
    )
    kept = [*keep, "error"]
    fields = ", ".join(f"`{c}` {checked.schema[c].dataType.simpleString()}" for c in kept)
    scored = checked.mapInArrow(
        _request_scorer(load, mean, std, seconds, kept), f"{fields}, y_log array<double>"
    )
    answers = F.when(F.col("error").isNull(), F.transform("y_log", lambda v: safe_exp(v)))
    return scored.select(*keep, answers.alias("y"), "error")
