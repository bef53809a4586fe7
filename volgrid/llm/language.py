"""Language of a text: known words first, shorter and shorter character n-grams otherwise.

The model holds, per language, log frequencies of words and of the n-grams of 4 to 1 letters
that they are made of. A word scores by its own frequencies if it is known, else by the mean
over its known n-grams of the longest length that has any. Scores are normalised over the
languages and summed over the text.

The model is fitted on a bounded sample: an expected ``TRAIN_DOCS`` labelled documents per
language, chosen by a hash of the doc_id, and the most frequent words of each language among them:
``VOCABULARY`` in equal shares, at least ``LEAST_WORDS``.
Every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_short, map_texts, written

#: Bounds of the fit: expected documents per language, and word counts kept.
TRAIN_DOCS = 4_000
VOCABULARY = 120_000
#: Words that each language has at least.
LEAST_WORDS = 100
LONGEST = 4
#: Above this many labels their table is joined by shuffle.
BROADCAST_LANGUAGES = 10_000
#: Added to every count.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Distinct segments of text kept per task.
KEPT = 400_000

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    rows: dict[str, int]  #: words, and n-grams with a mark in front, to rows of ``scores``
    scores: np.ndarray  #: log shares over the languages


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def word_counts(docs: DataFrame, per_language: int = TRAIN_DOCS, vocabulary: int = VOCABULARY) -> DataFrame:
    """``lang, word, n``: the most frequent words of a sample of ``docs(doc_id, text, lang)``."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = written(labelled.groupBy("lang").agg(F.count("*").alias("_of")), "languages")
    languages = sizes.count()
    if languages <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.join(sizes, "lang").where(drawn < F.lit(per_language) / F.col("_of"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Each language has its own share, however few of its documents are labelled. A language's
    # counts are those of its sample, so they fit a task.
    share = max(LEAST_WORDS, vocabulary // max(1, languages))
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("_rank") <= share).drop("_rank")


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """The model of ``(lang, word, n)`` rows."""
    languages = sorted({lang for lang, _, _ in counts})
    at = {lang: i for i, lang in enumerate(languages)}
    tables: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(LONGEST + 1)]
    for lang, word, n in counts:
        tables[0][word][at[lang]] += n
        padded = f"_{word}_"
        for width in range(1, LONGEST + 1):
            for i in range(len(padded) - width + 1):
                tables[width][padded[i : i + width]][at[lang]] += n
    rows: dict[str, int] = {}
    parts = []
    for width, table in enumerate(tables):
        if not table:
            continue
        start = len(rows)
        rows.update((f"{width}{key}" if width else key, start + i) for i, key in enumerate(table))
        logs = np.log(np.stack(list(table.values())) + SMOOTHING)
        logs -= np.log(np.exp(logs).sum(axis=0))  # frequencies within each language
        logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))  # shares over the languages
        parts.append(logs)
    scores = np.concatenate(parts) if parts else np.zeros((0, 0))
    return Model(languages, rows, scores)


class Scorer:
    """Scores of texts; each distinct stretch between white space is looked up once."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, len(self.model.languages) + 1))

    def word(self, word: str) -> np.ndarray | None:
        rows, scores = self.model.rows, self.model.scores
        if word in rows:
            return scores[rows[word]]
        padded = f"_{word}_"
        for width in range(LONGEST, 0, -1):
            found = [rows[k] for i in range(len(padded) - width + 1) if (k := f"{width}{padded[i : i + width]}") in rows]
            if found:
                return scores[found].mean(axis=0)
        return None

    def segment(self, text: str) -> np.ndarray:
        """Sum over the words of a stretch; the last entry tells whether it has a letter."""
        out = np.zeros(len(self.model.languages) + 1)
        for word in _WORD.findall(text):
            out[-1] = 1
            score = self.word(word)
            if score is not None:
                out[:-1] += score
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        parts = [t.lower().split() for t in texts]
        if len(self.vectors) > KEPT:
            self.forget()
        flat = list(chain.from_iterable(parts))
        codes = list(map(self.known.get, flat))
        if None in codes:
            missing = list({s for s, c in zip(flat, codes) if c is None})
            start = len(self.vectors)
            self.vectors = np.concatenate([self.vectors, np.stack([self.segment(m) for m in missing])])
            found = {m: start + i for i, m in enumerate(missing)}
            codes = [found[s] if c is None else c for s, c in zip(flat, codes)]
            keep_short(self.known, found)
        out = np.zeros((len(texts), self.vectors.shape[1]))
        filled = [i for i, p in enumerate(parts) if p]
        if filled:
            at = np.array(codes, dtype=np.int64)
            starts = np.cumsum([0] + [len(parts[i]) for i in filled[:-1]])
            out[filled] = np.add.reduceat(self.vectors[at], starts, axis=0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``: the likeliest language of each text and its share.

    ``und`` with score 0 for null text, text without letters, and a model without languages. On
    a tie the first language in alphabetical order.
    """

    def run(part: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        total = scorer.texts([t or "" for t in part.column(1).to_pylist()])
        lettered = (total[:, -1] > 0) & (total.shape[1] > 1)
        names, values = [], []
        for row, seen in zip(total[:, :-1], lettered):
            if not seen:
                names.append(UNKNOWN)
                values.append(0.0)
                continue
            best = int(row.argmax())
            names.append(scorer.model.languages[best])
            values.append(float(1 / np.exp(row - row[best]).sum()))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, run, "doc_id long, lang_pred string, score double", setup=lambda: Scorer(model))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``.

    Learns from the rows that are not held out and have text and ``lang``; ``lang`` is no input
    of a prediction. Rows that repeat a doc_id share its fold.
    """
    counts = [(r["lang"], r["word"], r["n"]) for r in word_counts(docs).collect()]  # bounded
    return predict(docs, fit(counts)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
