"""Scalar column expressions: null handling, log labels, input and output sanitation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EPS

INPUT_BOUND_NORMALIZED = 10.0
INPUT_BOUND_RAW = 1000.0
LOG_INFINITY = 50.0
LOG_CLIP = 20.0


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN means "not observed", as null does; aggregates skip nulls but propagate NaN."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def round_half_up(c: Column | str, digits: int) -> Column:
    """``F.round`` of a double, to the same bits: by decimals only near a tie or beyond 2 ** 31 units.

    Elsewhere the next integer is certain, and its quotient by a power of ten is the double next to
    the decimal. Decimals take some 300 ns a value.
    """
    c = as_column(c)
    units = c * F.lit(10.0**digits)
    near_tie = F.abs(units - F.floor(units) - 0.5) <= 0.001
    certain = (F.abs(units) < F.lit(2.0**31)) & ~near_tie
    return F.when(certain, F.floor(units + 0.5) / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def is_finite(c: Column | str) -> Column:
    """True for a finite number; false for null, NaN and both infinities."""
    c = as_column(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def log_label(target: Column | str, eps: float = EPS) -> Column:
    return F.ln(as_column(target) + F.lit(eps))


def exp_label(y_log: Column | str, eps: float = EPS) -> Column:
    return F.exp(as_column(y_log)) - F.lit(eps)


def sanitize(c: Column | str, normalized: bool = True) -> Column:
    """Model input guard: anything not finite becomes 0, the rest is clamped."""
    c = as_column(c).cast("double")
    bound = INPUT_BOUND_NORMALIZED if normalized else INPUT_BOUND_RAW
    clamped = F.greatest(F.lit(-bound), F.least(F.lit(bound), c))
    return F.when(is_finite(c), clamped).otherwise(F.lit(0.0))


def safe_log_prediction(y_log: Column | str) -> Column:
    """Model output guard on the log scale: NaN or missing to 0, infinities to +-50."""
    c = as_column(y_log).cast("double")
    return (
        F.when(c.isNull() | F.isnan(c), 0.0)
        .when(c == float("inf"), LOG_INFINITY)
        .when(c == float("-inf"), -LOG_INFINITY)
        .otherwise(c)
    )


def safe_exp(y_log: Column | str, eps: float = EPS) -> Column:
    """Real-scale prediction: guard, clip to +-20, back-transform."""
    clipped = F.greatest(F.lit(-LOG_CLIP), F.least(F.lit(LOG_CLIP), safe_log_prediction(y_log)))
    return F.exp(clipped) - F.lit(eps)
