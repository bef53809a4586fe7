"""Choice of a linear model from sums: every regularisation and every fold out of one scan.

The products of all pairs of features and label are summed up per fold of the key's hash, once.
A model that leaves a fold out is solved from the other folds' sums, and its error on that fold is
a quadratic form of that fold's sums, so neither further candidates nor the choice read a row
again. What comes to the driver are ``folds`` rows of about ``features^2 / 2`` sums.

The penalty is that of ``pyspark.ml.regression.LinearRegression``: on coefficients of features and
label scaled to unit deviation, ``regParam`` divided by the deviation of the label. Features
without spread get the weight 0. A row with a null or NaN in a feature, label or weight counts
nowhere. Sums are taken about ``origin`` (by default 0): give a typical row where the features'
mean is large against their spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..functions.scalars import as_column
from ..schemas import BUCKET_KEY, SPLIT_SEED

#: Below this share of the summed squares a feature counts as constant.
CONSTANT = 1e-14


@dataclass
class Linear:
    """Weights and intercept, named as in ``LinearRegressionModel``."""

    coefficients: list[float]
    intercept: float


@dataclass
class Sums:
    """Weighted products of (features, label, 1), and the number of rows."""

    products: np.ndarray
    rows: int
    origin: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.products + other.products, self.rows + other.rows, self.origin)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.products - other.products, self.rows - other.rows, self.origin)

    def solve(self, reg: float) -> Linear:
        """Least squares with the penalty ``reg``."""
        total = self.products[-1, -1]
        if total <= 0:
            return Linear([0.0] * (len(self.origin) - 1), 0.0)
        mean = self.products[-1, :-1] / total
        covariance = self.products[:-1, :-1] / total - np.outer(mean, mean)
        squares = np.diag(self.products)[:-1] / total
        spread = np.sqrt(np.where(np.diag(covariance) > CONSTANT * squares, np.diag(covariance), 0.0))
        weights = np.zeros(len(mean) - 1)
        used = np.flatnonzero(spread[:-1])
        if len(used) and spread[-1]:
            scaled = covariance[np.ix_(used, used)] / np.outer(spread[used], spread[used])
            target = covariance[used, -1] / (spread[used] * spread[-1])
            ridge = scaled + reg / spread[-1] * np.eye(len(used))
            # Without a penalty equal features share one solution: the shortest.
            beta = np.linalg.solve(ridge, target) if reg else np.linalg.lstsq(ridge, target, rcond=1e-12)[0]
            weights[used] = beta * spread[-1] / spread[used]
        centre = mean + self.origin
        return Linear([float(w) for w in weights], float(centre[-1] - weights @ centre[:-1]))

    def mean_squared_error(self, model: Linear) -> float | None:
        """Weighted mean squared error of a model on these rows; None without rows."""
        total = self.products[-1, -1]
        if total <= 0:
            return None
        weights = np.array(model.coefficients)
        shift = model.intercept + weights @ self.origin[:-1] - self.origin[-1]
        form = np.concatenate([-weights, [1.0], [-shift]])
        return max(0.0, float(form @ self.products @ form / total))


def fold_sums(
    rows: DataFrame,
    features: list[str],
    label: str,
    keys: list[str] = BUCKET_KEY,
    folds: int = 5,
    seed: int = SPLIT_SEED,
    weight: Column | str | None = None,
    origin: list[float] | None = None,
) -> list[Sums]:
    """The sums of every fold, from one aggregation; ``folds`` rows come to the driver."""
    names = [*features, label]
    start = np.zeros(len(names)) if origin is None else np.asarray(origin, dtype=float)
    values = [as_column(c).cast("double") - F.lit(float(o)) for c, o in zip(names, start, strict=True)]
    w = F.lit(1.0) if weight is None else as_column(weight).cast("double")
    columns = [f"_v{i}" for i in range(len(names))] + ["_one"]
    fold = F.least(F.floor(hash_unit(keys, seed) * folds), F.lit(folds - 1)).cast("int")
    chosen = rows.select(
        fold.alias("_fold"), w.alias("_w"), *[v.alias(c) for v, c in zip(values, columns)], F.lit(1.0).alias("_one")
    )
    whole = F.lit(True)
    for c in ("_w", *columns[:-1]):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col("_w") * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]
    found = chosen.where(whole).groupBy("_fold").agg(F.count(F.lit(1)).alias("_n"), F.array(*sums).alias("_sums"))
    out = [Sums(np.zeros((len(columns), len(columns))), 0, start) for _ in range(folds)]
    for r in found.collect():
        products = np.zeros((len(columns), len(columns)))
        for (i, j), value in zip(pairs, r["_sums"]):
            products[i, j] = products[j, i] = value
        out[r["_fold"]] = Sums(products, r["_n"], start)
    return out


def total(sums: list[Sums]) -> Sums:
    out = sums[0]
    for s in sums[1:]:
        out = out + s
    return out


def reg_path(sums: list[Sums], regs: list[float]) -> list[tuple[float, int, Linear, int, float | None]]:
    """``reg, fold, model, rows, error``: each fold held out under each penalty."""
    everything = total(sums)
    out = []
    for reg in regs:
        for fold, held in enumerate(sums):
            fitted = (everything - held).solve(reg)
            out.append((float(reg), fold, fitted, held.rows, held.mean_squared_error(fitted)))
    return out


def choose(sums: list[Sums], regs: list[float]) -> tuple[float, Linear]:
    """The penalty with the least mean error over all held-out rows (the first among equals), and
    the model of all rows with it. Without any rows the first penalty."""
    errors = {}
    for reg, fold, _, rows, error in reg_path(sums, regs):
        if error is not None:
            kept = sums[fold].products[-1, -1]
            errors[reg] = errors.get(reg, 0.0) + error * kept
    best = min(errors, key=errors.get) if errors else float(regs[0])
    return best, total(sums).solve(best)
