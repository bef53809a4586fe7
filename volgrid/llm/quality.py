"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document, next to the measurements it uses; a failure sets the
rule's bit. Policies are versioned masks over these bits, applied without looking at a text
again, and ablations (what each rule alone would drop or keep) are bitwise aggregates over the
ledger. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements of a document."""

    name: str
    fails: str


#: In the order of their bits. New rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * word_chars"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("short_words", "word_chars < n_words + n_words div 5"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that each applies.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines"),
    3: (*BASE, "symbols", "repeated_lines", "long_words", "short_words"),
}
CURRENT = 3


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << i for i, rule in enumerate(rules) if rule.name in names)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, bound to the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(words: Column) -> Column:
    """A hash of each window of eight words."""
    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        ),
    )


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, by sorting; nothing is compared twice."""

    def of_sorted(entries: Column) -> Column:
        twice = F.filter(
            entries,
            lambda e, k: (F.get(entries, k - 1)["h"] == e["h"]).eqNullSafe(True)
            | (F.get(entries, k + 1)["h"] == e["h"]).eqNullSafe(True),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return _let(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    s,
                    lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))),
                ),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    entries = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(entries, of_sorted)


def repeat_words(words: Column) -> Column:
    """Words of a document in eight-word windows that it has twice or more."""
    return F.when(
        F.size(words) > WINDOW,
        _let(
            _windows(words),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)),
        ),
    ).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each row of ``docs(doc_id, text)``; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    packed = F.translate("_t", _SPACES, "")
    lines = F.filter(F.split("_t", "\n"), lambda line: F.length(F.translate(line, _SPACES, "")) > 0)
    counted = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = F.array_remove(F.split("_t", SPACE), "")
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    return rows.select(
        "doc_id",
        of_words.alias("_w"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        counted.alias("_l"),
    ).select(
        "doc_id",
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that each document fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def apply_policy(entries: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``base_failed`` and ``kept`` by the policy of that version."""
    return entries.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(mask(BASE, rules))) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version], rules))) == 0,
            "policy": F.lit(version),
        }
    )


def ablation(entries: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it drops.

    One pass over the ledger: documents are counted by their bits, of which there are few.
    """
    applied = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version], rules)))
    counts = entries.groupBy(applied.alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules if r.name in POLICIES[version]]
    per_rule = counts.select(
        "n", "bits",
        F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(mask((x,), rules)).cast("long").alias("bit")) for x in names])).alias("_r"),
    ).select("n", "bits", "_r.rule", "_r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return per_rule.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )
