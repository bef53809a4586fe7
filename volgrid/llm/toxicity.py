"""Toxic documents by a chain of linear classifiers.

Categories are predicted one after the other. Each is a logistic regression over word features
whose inputs are joined by the probabilities of all categories before it. While fitting, these
probabilities are *out of fold*: documents are dealt to folds by a hash of their text, and each
gets its probability from a model that has not seen its fold, so that later models learn from
inputs as good as those they will get.

Features of a text are its words and their beginnings of 4 and 6 letters (``idio*``) among a
vocabulary, each as the root of its count, damped by the text's length. The vocabulary are those
that separate a category best, counted over the sample by Spark. The sample is bounded: an expected
``TRAIN_DOCS`` labelled documents, drawn by a hash of the doc_id. Each combination of labels has its
share of them, so that rare ones are kept whole, and documents weigh as many as they stand for. The
last category's threshold maximises its F1 over out-of-fold predictions; where these do not separate
the labels better than chance does, nothing is toxic.
Every document is scored on its whole text. Labels that disagree on one doc_id: a category holds if
any of them says so. Other columns of the tables are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_short, map_texts, small_batches, small_slices, written

#: Bounds of the fit: expected labelled documents, and words per category.
TRAIN_DOCS = 20_000
VOCABULARY = 300
#: Letters of the word beginnings that are features too.
BEGINNINGS = (4, 6)
#: A word counts if it is in so many documents of the sample, or in the root of the number of the
#: rarer label, if that is less.
MIN_DOCS = 4
#: ... and its likelihood ratio is so many times the logarithm of the number of words tried.
MIN_RATIO = 1.3
#: A threshold counts if it finds so many standard errors more than chance does.
MIN_LIFT = 3.0
FOLDS = 3
REGULARISATION = 0.01
ITERATIONS = 200
#: Above this many labels they are joined by shuffle instead of being broadcast.
BROADCAST_LABELS = 1_000_000
#: Distinct stretches of text kept per task.
KEPT = 150_000
#: Characters stripped from around a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Step:
    """One classifier: weights of the words, then of the categories before; the intercept."""

    category: str
    words: np.ndarray
    before: np.ndarray
    intercept: float


@dataclass(frozen=True)
class Chain:
    vocabulary: dict[str, int]
    steps: list[Step]
    threshold: float


class Features:
    """Word features of texts; each distinct stretch between white space is looked up once."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.none = len(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: By row: the features of a stretch, filled up with "none". Row 0 has no feature.
        self.rows: dict[tuple[int, ...], int] = {(self.none,) * 3: 0}

    def at(self, stretch: str) -> int:
        word = stretch.lower().strip(EDGES)
        names = [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]
        found = [self.vocabulary[x] for x in names if x in self.vocabulary]
        row = tuple(found + [self.none] * (3 - len(found)))
        return self.rows.setdefault(row, len(self.rows))

    def of(self, texts: list[str]) -> np.ndarray:
        parts = [t.split() for t in texts]
        flat = list(chain.from_iterable(parts))
        codes = list(map(self.known.get, flat))
        if None in codes:
            if len(self.known) > KEPT:
                self.known = {}
                codes = [None] * len(flat)
            found = {s: self.at(s) for s in {s for s, c in zip(flat, codes) if c is None}}
            codes = [found[s] if c is None else c for s, c in zip(flat, codes)]
            keep_short(self.known, found)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), lengths)
        row = np.array(codes, dtype=np.int64)
        hit = row > 0
        table = np.array(list(self.rows), dtype=np.int64)
        width = self.none + 1
        places = (text[hit][:, None] * width + table[row[hit]]).ravel()
        counts = np.bincount(places, minlength=len(texts) * width).reshape(len(texts), width)[:, :-1]
        # One insult in a long text still counts.
        return np.sqrt(counts) / (1 + np.log10(1 + np.maximum(lengths, 1)))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(chain_: Chain, features: np.ndarray) -> np.ndarray:
    """Per text the probability of each category, in the order of the chain."""
    out = np.zeros((len(features), len(chain_.steps)))
    for k, step in enumerate(chain_.steps):
        out[:, k] = _sigmoid(features @ step.words + out[:, :k] @ step.before + step.intercept)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, categories: list[str], n: int = TRAIN_DOCS) -> DataFrame:
    """``text, fold, weight`` and the categories (0/1) of a bounded sample of labelled documents."""
    usable = labels.where(F.col("doc_id").isNotNull())
    for c in categories:
        usable = usable.where(F.col(c).isNotNull())
    # Labels that disagree on a doc_id: a category holds if any of them says so.
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max((F.col(c) != 0).cast("double")).alias(c) for c in categories]
    )
    counted = usable.groupBy(*categories).count().orderBy("count", *categories).collect()  # 2 to the categories
    total, left = sum(r["count"] for r in counted), float(n)
    rate = F.lit(1.0)
    for at, r in enumerate(counted):
        share = min(r["count"], left / (len(counted) - at))  # the rest is for the more frequent ones
        left -= share
        same = F.lit(True)
        for c in categories:
            same &= F.col(c) == r[c]
        rate = F.when(same, F.lit(share / r["count"])).otherwise(rate)
    usable = usable.withColumn("weight", 1 / rate)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 / F.col("weight")
    usable = usable.where(drawn)
    if min(total, 2 * n) <= BROADCAST_LABELS:  # the drawn ones are n on average
        usable = F.broadcast(usable)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    return rows.join(usable, "doc_id").select("text", fold.alias("fold"), "weight", *categories)


def _longer(n: int):
    return lambda w: F.length(w) > n


def _beginning(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def association(both: Column, with_word: Column, positive: float, total: float) -> Column:
    """Likelihood ratio of word and label being independent (G squared), from document counts.

    Unlike an estimate over its error it does not shrink where a word never occurs without the
    label, and a common word that differs a little is below a rarer one that tells.
    """
    cells = [both, with_word - both, positive - both, total - positive - with_word + both]
    margins = [with_word, total - with_word, F.lit(positive), F.lit(total - positive)]
    terms = [_x_log_x(c) for c in cells] + [-_x_log_x(m) for m in margins] + [_x_log_x(F.lit(total))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return 2 * out


def choose_words(sample: DataFrame, categories: list[str], n: int = VOCABULARY) -> list[str]:
    """The words that are associated with a category most, ``n`` at most for each.

    Words that as many tries would bring about by chance do not count: those below ``MIN_RATIO``
    times the logarithm of the number tried. The bound is low, as the penalty of the fit takes care of
    single ones that pass it by chance.
    """
    plain = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES))))
    starts = [
        F.array_distinct(F.transform(F.filter("plain", _longer(n)), _beginning(n)))
        for n in BEGINNINGS
    ]
    words = (
        sample.withColumn("plain", plain)
        .withColumn("word", F.explode(F.concat("plain", *starts)))
        .where("word <> ''")
    )
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = words.groupBy("word").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in categories])
    rarer = {c: min(float(totals[c] or 0), totals["n"] - float(totals[c] or 0)) for c in categories}
    least = {c: max(2, min(MIN_DOCS, math.isqrt(int(rarer[c])))) for c in categories}
    counts = written(counts.where(F.col("_n") >= min(least.values())), "words")
    tried = max(2, counts.count())
    chosen: dict[str, None] = {}
    for c in categories:
        found = association(F.col(c), F.col("_n").cast("double"), float(totals[c] or 0), float(totals["n"]))
        scored = counts.where(F.col("_n") >= least[c]).select("word", found.alias("g"))
        best = scored.where(F.col("g") >= MIN_RATIO * math.log(tried)).orderBy(F.desc("g"), "word").limit(n)
        chosen.update((r["word"], None) for r in best.collect())  # n words
    return list(chosen)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = REGULARISATION) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with a squared penalty on weights of inputs
    scaled to unit deviation, by limited-memory BFGS. Inputs without spread get the weight 0; rows
    that all have one label give a constant."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 6.0 if len(y) and y[0] else -6.0
    share = weight / weight.sum()
    mean = share @ x
    spread = np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0) / (1 - (share * share).sum()))
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)

    def value(beta: np.ndarray) -> tuple[float, np.ndarray]:
        margin = x @ (beta[:-1] * scale).astype(x.dtype) + beta[-1]
        loss = share @ (np.logaddexp(0, margin) - y * margin) + penalty / 2 * (beta[:-1] @ beta[:-1])
        error = share * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)
        slope = (error.astype(x.dtype) @ x).astype(float) * scale + penalty * beta[:-1]
        return float(loss), np.append(slope, error.sum())

    beta = np.zeros(x.shape[1] + 1)
    odds = share @ y
    beta[-1] = math.log(odds / (1 - odds))
    loss, slope = value(beta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ITERATIONS):
        direction = slope.copy()
        used = []
        for s, d, r in reversed(steps):
            a = r * (s @ direction)
            used.append(a)
            direction -= a * d
        if steps:
            s, d, _ = steps[-1]
            direction *= (s @ d) / (d @ d)
        for (s, d, r), a in zip(steps, reversed(used)):
            direction += (a - r * (d @ direction)) * s
        length, fall = 1.0 if steps else 1 / max(1.0, float(np.abs(slope).sum())), slope @ direction
        while True:
            trial = beta - length * direction
            trial_loss, trial_slope = value(trial)
            if trial_loss <= loss - 1e-4 * length * fall or length < 1e-10:
                break
            length /= 2
        s, d = trial - beta, trial_slope - slope
        gained = loss - trial_loss
        beta, loss, slope = trial, trial_loss, trial_slope
        if s @ d > 1e-12:
            steps = [*steps[-9:], (s, d, 1 / (s @ d))]
        if gained <= 1e-9 * max(abs(loss), 1e-9) or np.abs(slope).max() < 1e-7:
            break
    return beta[:-1] * scale, float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], n: int = TRAIN_DOCS) -> Chain | None:
    """The chain for ``categories`` in their order; None without any usable label.

    The features of the bounded sample (at most ``VOCABULARY`` numbers a category and document)
    come to the driver, where the regressions are fitted.
    """
    said = list(categories)
    # Columns of our own, so that a category may have any name.
    categories = [f"_category_{i}" for i in range(len(said))]
    labels = labels.select("doc_id", *[F.col(c).alias(own) for c, own in zip(said, categories)])
    sample = written(training_sample(docs, labels, categories, n), "toxic-sample")
    if sample.isEmpty():
        return None
    vocabulary = {w: i for i, w in enumerate(choose_words(sample, categories))}
    names = ["fold", "weight", *categories]

    def featurise(part: pa.RecordBatch, features: Features) -> pa.RecordBatch:
        values = features.of(part.column(0).to_pylist()).astype("<f4")
        return pa.RecordBatch.from_arrays(
            [pa.array([row.tobytes() for row in values], pa.binary()), *[part.column(1 + i) for i in range(len(names))]],
            names=["features", *names],
        )

    schema = "features binary, fold int, weight double, " + ", ".join(f"`{c}` double" for c in categories)
    rows = map_texts(sample.select("text", *names), featurise, schema, setup=lambda: Features(vocabulary))
    found = rows.toArrow().sort_by([(c, "ascending") for c in ("features", *names)])  # the bounded sample
    width = len(vocabulary)
    x = np.zeros((found.num_rows, width + len(categories)), dtype=np.float32)
    x[:, :width] = np.frombuffer(b"".join(found["features"].to_pylist()), dtype="<f4").reshape(found.num_rows, width)
    fold, weight, *labelled = (found[c].to_numpy().astype(float) for c in names)
    steps: list[Step] = []
    for k, (name, y) in enumerate(zip(said, labelled)):
        inputs = x[:, : width + k]
        weights, intercept = logistic(inputs, y, weight)
        steps.append(Step(name, weights[:width], weights[width:], intercept))
        # Out of fold: each fold is predicted by a model of the others.
        for f in range(FOLDS):
            held = fold == f
            w, b = logistic(inputs[~held], y[~held], weight[~held])
            x[held, width + k] = _sigmoid(inputs[held] @ w + b)
    last = x[:, width + len(categories) - 1].astype(float)
    return Chain(vocabulary, steps, best_threshold(last, labelled[-1], weight))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The bound on the probability with the best F1, halfway between two probabilities.

    Only bounds that find clearly more than chance does; 1 if there is none.
    """
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    w = np.ones(len(p)) if weight is None else weight[order]
    true = np.cumsum(w * y)
    f1 = 2 * true / (np.cumsum(w) + max((w * y).sum(), 1))
    taken, n, share = np.arange(1, len(p) + 1), len(p), y.mean()
    error = np.sqrt(taken * share * (1 - share) * (n - taken) / max(n - 1, 1))
    f1[np.cumsum(y) - taken * share < MIN_LIFT * error] = -1
    f1[-1] = -1  # all of them
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal probabilities
    at = int(f1.argmax())
    if f1[at] <= 0:
        return 1.0
    return float((p[at] + p[at + 1]) / 2)


def _about_threshold(p: np.ndarray, threshold: float) -> np.ndarray:
    """Probabilities with their odds divided by those of the threshold, which so becomes one half."""
    if threshold >= 1:
        return np.zeros_like(p)
    odds = np.clip(p, 1e-12, 1 - 1e-12)
    odds = odds / (1 - odds) * (1 - threshold) / max(threshold, 1e-12)
    return odds / (1 + odds)


def score(docs: DataFrame, model: Chain | None) -> DataFrame:
    """``doc_id, probability, toxic`` of every row: the last category of the chain.

    ``probability`` is taken about the threshold: toxic documents have more than one half. Null text has no words. Without a model (no labels) nothing is toxic.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("probability"), F.lit(False).alias("toxic"))

    def run(part: pa.RecordBatch, features: Features) -> pa.RecordBatch:
        p = probabilities(model, features.of([t or "" for t in part.column(1).to_pylist()]))[:, -1]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(_about_threshold(p, model.threshold)), pa.array(p > model.threshold)], names=["doc_id", "probability", "toxic"]
        )

    return map_texts(
        rows, run, "doc_id long, probability double, toxic boolean", setup=lambda: Features(model.vocabulary)
    )


def keep(docs: DataFrame, model: Chain | None) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns and without a join.

    The verdict is found where the text is, so that no text is shuffled.
    """
    if model is None:
        return docs

    def verdicts(batches):
        features = Features(model.vocabulary)
        for batch in batches:
            for part in small_slices(batch, "text"):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                p = probabilities(model, features.of(texts))[:, -1]
                yield part.filter(pa.array(p <= model.threshold))
        del features
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(verdicts, docs.schema)
