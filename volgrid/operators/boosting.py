"""Boosted trees for the percentage error: histograms by Spark, splits from their sums.

A tree is fitted to the gradient of the weighted squared error of what the trees before it leave;
a row's weight ``1 / (y + eps)^2`` makes that the squared percentage error. Features become small
numbers once: the place among at most ``bins`` cuts, 0 for a missing value. Each level of a tree is
one pass: sums of gradient and weight per (node, feature, place), partially aggregated, so at most
``2^depth * features * (bins + 1)`` sums come to the driver, whatever the number of rows. The best
cut of a node follows from its sums. Rows are never collected; their running prediction is kept in a
table that is written once per tree.

Rows without a finite label or weight are left out of the fit. Equal gains take the first feature
and the lowest cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exp_label, is_finite, nan_to_null
from ..schemas import EPS
from ..session import cut_lineage

#: Gains that differ by less (relative to the larger) are equal: sums vary in their last digits.
SAME = 1e-9


@dataclass
class Node:
    """A leaf with its value, or a cut: values up to ``edge``, and missing ones, go left."""

    value: float = 0.0
    feature: int | None = None
    place: int = 0
    edge: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    """Sum of a start value and of trees, each times ``rate``."""

    features: list[str]
    edges: list[list[float]]
    start: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def column(self) -> Column:
        """The prediction from the features' values: no Python and no extra stage."""

        def value(node: Node) -> Column:
            if node.feature is None:
                return F.lit(float(node.value))
            x = nan_to_null(F.col(self.features[node.feature]).cast("double"))
            left = F.coalesce(x <= F.lit(float(node.edge)), F.lit(True))
            return F.when(left, value(node.left)).otherwise(value(node.right))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + F.lit(float(self.rate)) * value(tree)
        return total

    def predict(self, rows: DataFrame, name: str = "y_pred") -> DataFrame:
        return rows.withColumn(name, self.column())


def find_edges(rows: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Cuts at approximate quantiles: at most ``bins - 1`` numbers a feature, from one pass."""
    shares = [i / bins for i in range(1, bins)]
    values = [nan_to_null(F.col(c).cast("double")) for c in features]
    found = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"_{i}") for i, v in enumerate(values)]).first()
    return [sorted({float(v) for v in found[i] or []}) for i in range(len(features))]


def _place(value: Column, edges: list[float]) -> Column:
    """0 for a missing value, else 1 and the number of edges below it."""
    if not edges:
        return F.when(value.isNotNull(), 1).otherwise(0)
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))
    return F.when(value.isNotNull(), below + 1).otherwise(0)


def _at(tree: Node, leaf) -> Column:
    """A tree over places, with ``leaf(node)`` at its ends."""
    if tree.feature is None:
        return leaf(tree)
    left = F.col("_places")[tree.feature] <= tree.place
    return F.when(left, _at(tree.left, leaf)).otherwise(_at(tree.right, leaf))


def _best(sums: np.ndarray, edges: list[list[float]], penalty: float, least: int) -> tuple[int, int] | None:
    """Feature and place of the cut with the largest gain, from [feature, place, (g, w, n)]."""
    whole = sums[0].sum(axis=0)
    floor = 1e-300

    def score(g, w):
        return g * g / np.maximum(w + penalty, floor)

    best, found = 0.0, None
    before = score(whole[0], whole[1])
    for f, cuts in enumerate(edges):
        left = sums[f].cumsum(axis=0)
        for place in range(1, len(cuts) + 1):
            g, w, n = left[place]
            if n < least or whole[2] - n < least:
                continue
            gain = score(g, w) + score(whole[0] - g, whole[1] - w) - before
            if gain > best + SAME * (abs(best) + abs(before)):
                best, found = gain, (f, place)
    return found


def fit_boosted(
    rows: DataFrame,
    features: list[str],
    label: str = "y",
    weight: Column | None = None,
    rounds: int = 20,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    penalty: float = 0.0,
    least: int = 20,
    edges: list[list[float]] | None = None,
) -> Boosted:
    """Fit trees to a label on the real scale; without ``weight`` to its percentage error.

    ``edges`` gives the cuts of each feature instead of quantiles. ``penalty`` is added to the weight
    of a node, ``least`` is the smallest number of rows of a leaf.
    """
    y = F.col(label).cast("double")
    w = 1 / ((y + F.lit(EPS)) * (y + F.lit(EPS))) if weight is None else weight.cast("double")
    chosen = rows.withColumns({"_y": y, "_w": w}).where(is_finite("_y") & is_finite("_w"))
    cuts = find_edges(chosen, features, bins) if edges is None else edges
    total = chosen.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy")).first()
    start = total["wy"] / total["w"] if total["w"] else 0.0
    model = Boosted(list(features), cuts, float(start), rate)
    if not total["w"]:
        return model
    places = [_place(nan_to_null(F.col(c).cast("double")), e).cast("smallint") for c, e in zip(features, cuts)]
    table = chosen.select(F.array(*places).alias("_places"), "_y", "_w", F.lit(model.start).alias("_pred"))
    width = max(len(e) for e in cuts) + 2
    for _ in range(rounds):
        table = cut_lineage(table)
        model.trees.append(_fit_tree(table, cuts, width, depth, penalty, least))
        added = _at(model.trees[-1], lambda n: F.lit(float(n.value)))
        table = table.withColumn("_pred", F.col("_pred") + F.lit(rate) * added)
    return model


def _fit_tree(
    table: DataFrame, edges: list[list[float]], width: int, depth: int, penalty: float, least: int
) -> Node:
    root = Node()
    open_nodes = [root]
    residual = F.col("_w") * (F.col("_y") - F.col("_pred"))
    for level in range(depth + 1):
        numbers = {id(n): i for i, n in enumerate(open_nodes)}
        at = _at(root, lambda n: F.lit(numbers.get(id(n), -1)))
        each = table.select(at.alias("node"), residual.alias("g"), "_w", F.posexplode("_places").alias("f", "p"))
        sums = each.where("node >= 0").groupBy("node", "f", "p").agg(
            F.sum("g").alias("g"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")
        )
        # Nodes of the level, features and places: bounded by the settings.
        grid = np.zeros((len(open_nodes), len(edges), width, 3))
        for r in sums.collect():
            grid[r["node"], r["f"], r["p"]] = r["g"], r["w"], r["n"]
        following = []
        for node, cell in zip(open_nodes, grid):
            g, w, _ = cell[0].sum(axis=0)
            node.value = float(g / (w + penalty)) if w + penalty > 0 else 0.0
            found = _best(cell, edges, penalty, least) if level < depth else None
            if found:
                node.feature, node.place = found
                node.edge = edges[node.feature][node.place - 1]
                node.left, node.right = Node(), Node()
                following += [node.left, node.right]
        open_nodes = following
        if not open_nodes:
            break
    return root


def real_label(rows: DataFrame, y_log: str = "y_log", name: str = "y") -> DataFrame:
    """Add the label on the real scale."""
    return rows.withColumn(name, exp_label(y_log))
