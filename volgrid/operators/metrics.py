"""Losses and evaluation reports over prediction rows, and choices between epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import losses
from ..functions.scalars import as_column, nan_to_null
from ..schemas import BUCKET_KEY, LOG_INTERVAL
from ..session import cut_lineage
from .ordering import running_totals
from .quality import require_finite


def observed(df: DataFrame, pred_log: str, y_log: str, missing: str) -> DataFrame:
    """Prediction rows as metrics take them.

    ``missing="error"`` fails the job on a null, NaN or infinite prediction or label, so that no
    report hides one. ``missing="skip"`` nulls both sides of such a pair: it counts nowhere.
    """
    if missing == "error":
        return require_finite(df, [pred_log, y_log])
    if missing != "skip":
        raise ValueError(f"unknown treatment of missing values: {missing}")
    good = F.lit(True)
    for c in (pred_log, y_log):
        v = as_column(c).cast("double")
        good = good & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.withColumns({c: F.when(good, F.col(c)) for c in (pred_log, y_log)})


def _metrics(
    df: DataFrame, by: list[str], values: list[Column], pred_log: str, y_log: str, missing: str
) -> DataFrame:
    """The aggregates ``values`` per group of ``by``, of rows as metrics take them.

    With ``missing="error"`` the rows that are not finite are counted in the same aggregation, and
    a group that has any fails the job: rows themselves need no test.
    """
    if missing != "error":
        return observed(df, pred_log, y_log, missing).groupBy(*by).agg(*values)
    p, y = (as_column(c).cast("double") for c in (pred_log, y_log))
    # A number less itself is 0 only if it is finite.
    finite = F.count_if((p - p) + (y - y) == 0)
    found = df.groupBy(*by).agg(*values, (F.count(F.lit(1)) - finite).alias("_bad"))
    names = [c for c in found.columns if c not in (*by, "_bad")]
    message = F.concat(F.lit(f"non-finite value in {pred_log} or {y_log}: rows "), F.col("_bad").cast("string"))
    checked = [F.when(F.col("_bad") > 0, F.raise_error(message)).otherwise(F.col(c)).alias(c) for c in names]
    return found.select(*by, *checked)


def _pairs(pred_log: str, y_log: str) -> Column:
    """Aggregate: number of pairs with both sides."""
    return F.count(as_column(pred_log) + as_column(y_log))


def join_truth(
    predictions: DataFrame, labels: DataFrame, keys: list[str] = BUCKET_KEY
) -> DataFrame:
    """Pair each prediction with its label on the key."""
    return predictions.join(labels, keys)


def mspe(
    df: DataFrame, pred_log: str = "pred_log", y_log: str = "y_log", missing: str = "error"
) -> DataFrame:
    return _metrics(df, [], [losses.mspe_from_log(pred_log, y_log).alias("mspe")], pred_log, y_log, missing)


def log_mse(
    df: DataFrame, pred_log: str = "pred_log", y_log: str = "y_log", missing: str = "error"
) -> DataFrame:
    return _metrics(df, [], [losses.log_mse(pred_log, y_log).alias("log_mse")], pred_log, y_log, missing)


def batch_losses(
    df: DataFrame,
    batch: list[str],
    pred_log: str = "pred_log",
    y_log: str = "y_log",
    missing: str = "error",
) -> DataFrame:
    """Loss and size of each batch; the size counts pairs that the loss is a mean of."""
    values = [losses.mspe_from_log(pred_log, y_log).alias("loss"), _pairs(pred_log, y_log).alias("n")]
    return _metrics(df, batch, values, pred_log, y_log, missing)


def _weighted_root(batches: DataFrame, by: list[str], name: str) -> DataFrame:
    """Root of the weighted mean loss: 0.0 without batches, null if none has a loss."""
    loss = nan_to_null(F.col("loss"))
    counted = F.when(loss.isNotNull(), F.col("n"))
    root = losses.root_mean(F.sum(loss * counted), F.coalesce(F.sum(counted), F.lit(0)))
    lost = (F.count(F.lit(1)) > 0) & (F.coalesce(F.sum(counted), F.lit(0)) == 0)
    return batches.groupBy(*by).agg(F.when(~lost, root).alias(name))


def rmspe_from_batches(batches: DataFrame) -> DataFrame:
    """Root of the size-weighted mean of batch losses; 0.0 if there are no batches."""
    return _weighted_root(batches, [], "rmspe")


def epoch_metric(steps: DataFrame) -> DataFrame:
    """The same per epoch; null for an epoch without any loss."""
    return _weighted_root(steps, ["epoch"], "metric")


def eval_report(
    df: DataFrame,
    by: list[str] | None = None,
    pred_log: str = "pred_log",
    y_log: str = "y_log",
    missing: str = "error",
) -> DataFrame:
    """RMSE and RMSPE on the real scale, and the row count; per group if ``by`` is given.

    With ``missing="skip"`` the errors are means over the pairs that have both sides, ``count``
    counts these, and ``missing`` the others.
    """
    n = _pairs(pred_log, y_log)
    skipped = [(F.count(F.lit(1)) - n).alias("missing")] if missing == "skip" else []
    values = [
        losses.root_mean(F.sum(losses.squared_error(pred_log, y_log)), n).alias("rmse"),
        losses.root_mean(F.sum(losses.squared_percentage_error(pred_log, y_log)), n).alias("rmspe"),
        n.alias("count"),
        *skipped,
    ]
    return _metrics(df, by or [], values, pred_log, y_log, missing)


def mspe_gradient(
    df: DataFrame,
    pred_log: str = "pred_log",
    y_log: str = "y_log",
    name: str = "gradient",
    missing: str = "error",
) -> DataFrame:
    """Add the gradient of the batch loss by each row's log prediction; null for skipped pairs."""
    rows = observed(df, pred_log, y_log, missing)
    n = rows.agg(_pairs(pred_log, y_log)).scalar()
    return rows.withColumn(name, losses.mspe_gradient(pred_log, y_log, n))


def running_metric(steps: DataFrame, interval: int = LOG_INTERVAL) -> DataFrame:
    """Root of the weighted mean loss so far, at every ``interval``-th step of an epoch.

    ``steps`` has ``epoch, step, loss, n`` with steps 1, 2, 3... Steps are summed per block of
    one interval first, in parallel; the running part sees one row per block and reads the
    written blocks.
    """
    blocks = cut_lineage(
        steps.withColumn("_block", F.floor((F.col("step") - 1) / interval))
        .groupBy("epoch", "_block")
        .agg(
            F.sum(F.col("loss") * F.col("n")).alias("_loss"),
            F.sum("n").alias("_n"),
            F.count(F.lit(1)).alias("_steps"),
        )
    )
    totals = running_totals(blocks, "_block", {"_loss_before": "_loss", "_n_before": "_n"}, ["epoch"])
    n = F.col("_n_before") + F.col("_n")
    loss = F.col("_loss_before") + F.col("_loss")
    return totals.where(F.col("_steps") == interval).select(
        "epoch",
        ((F.col("_block") + 1) * interval).alias("step"),
        n.alias("n"),
        losses.root_mean(loss, n).alias("metric"),
    )


def best_so_far(epochs: DataFrame, metric: str = "metric", run: list[str] = []) -> DataFrame:
    """Add ``is_best``: strictly below every earlier epoch, so the first of a tie wins.

    A null or NaN metric is never best. One row per epoch of a run; a training run has few.
    """
    by_run = Window.partitionBy(*run) if run else Window.partitionBy(F.lit(0))
    earlier = by_run.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    value = nan_to_null(F.col(metric))
    below = F.coalesce(value < F.min(value).over(earlier), F.lit(True))
    return epochs.withColumn("is_best", value.isNotNull() & below)


def best_epoch(epochs: DataFrame, metric: str = "metric", tie: str = "epoch") -> DataFrame:
    """The row with the lowest metric, the earliest on a tie; null and NaN come last."""
    return epochs.orderBy(F.asc_nulls_last(nan_to_null(F.col(metric))), tie).limit(1)
