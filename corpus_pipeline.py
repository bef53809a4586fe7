"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next one's ``docs``. All stages but the last return the columns
of ``documents``; rows that a stage rejects are gone for the stages after it. The last returns
the pieces of the remaining documents with their place in a sequence.

Rows without doc_id or text are kept by the stages that have nothing against them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volgrid.llm import decontam, neardup, packing, pii, toxicity
from volgrid.llm.common import table, written
from volgrid.llm.queries import CATEGORIES, toxicity_labels

#: SQL cannot fit classifiers nor run tokenizers; the tests hold the stages against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_key``, the hash of doc_id (null or not) and text: decisions are by text."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_key").alias("doc_id"), "text")


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among ``keys``."""
    return keyed.join(keys.select("_key").distinct(), "_key", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers does not reject."""
    model = toxicity.fit(docs, toxicity_labels(spark, sf_dir), CATEGORIES)
    return toxicity.keep(docs, model)


#: Near copies have at least so many hundredths of their shingles in common.
NEAR_PERCENT = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies: that with the smallest doc_id (none comes last)."""
    keyed = _keyed(docs)
    found = neardup.near_duplicates(_texts(keyed), NEAR_PERCENT).withColumnRenamed("doc_id", "_key")
    found = written(found, "near-duplicates")
    rows = found.groupBy("_key").agg(
        F.first("component_id").alias("component_id"), F.max("n_shingles").alias("words"), F.count("*").alias("n")
    )
    ids = keyed.select("_key", "doc_id").dropDuplicates(["_key"])
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_key")
    first = rows.join(ids, "_key").groupBy("component_id").agg(F.min(place).alias("first"))
    gone = rows.join(first.select(F.col("first._key").alias("_key")), "_key", "left_anti")
    kept = _without(keyed, written(gone.select("_key"), "near-copies"))
    # Rows that repeat a doc_id word for word are copies too.
    repeated = written(rows.where("n > 1 and words > 0").select("_key"), "repeated")
    once = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return _without(kept, repeated).unionByName(once).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    keyed = _keyed(docs)
    found = decontam.contaminated(_texts(keyed), table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.withColumnRenamed("doc_id", "_key")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted again."""
    model = pii.fit(pii.training_rows(docs))
    out = pii.mask(docs, model)
    if "n_chars" in out.columns:
        changed = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
