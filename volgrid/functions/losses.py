"""Row terms and aggregates of the losses, from log-scale predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EPS
from .scalars import as_column, exp_label


def square(c: Column) -> Column:
    return c * c


def percentage_error(pred_log: Column | str, y_log: Column | str, eps: float = EPS) -> Column:
    """``(p - y) / (y + eps)`` on the real scale."""
    p, y = exp_label(pred_log, eps), exp_label(y_log, eps)
    return (p - y) / (y + F.lit(eps))


def squared_percentage_error(pred_log: Column | str, y_log: Column | str, eps: float = EPS) -> Column:
    return square(percentage_error(pred_log, y_log, eps))


def squared_error(pred_log: Column | str, y_log: Column | str, eps: float = EPS) -> Column:
    return square(exp_label(pred_log, eps) - exp_label(y_log, eps))


def mspe_from_log(pred_log: Column | str, y_log: Column | str, eps: float = EPS) -> Column:
    """Aggregate: mean squared percentage error."""
    return F.avg(squared_percentage_error(pred_log, y_log, eps))


def log_mse(pred_log: Column | str, y_log: Column | str) -> Column:
    """Aggregate: mean squared error on the log scale."""
    return F.avg(square(as_column(pred_log) - as_column(y_log)))


def mspe_gradient(pred_log: Column | str, y_log: Column | str, n: Column | str, eps: float = EPS) -> Column:
    """d MSPE / d pred_log for one row of ``n``; ``dp/d pred_log`` is taken as ``p``."""
    p, y = exp_label(pred_log, eps), exp_label(y_log, eps)
    return F.lit(2.0) * (p - y) / (square(y + F.lit(eps)) * as_column(n)) * p


def root_mean(sum_column: Column, count_column: Column) -> Column:
    """``sqrt(sum / max(count, 1))``, 0.0 on empty input."""
    total = F.coalesce(sum_column, F.lit(0.0))
    return F.sqrt(total / F.greatest(count_column, F.lit(1)))
