"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    chunks,
    decontam,
    filters,
    language,
    neardup,
    packing,
    pieces,
    pii,
    quality,
    sharding,
    tokencount,
    toxicity,
)
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(pii.training_rows(docs)))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as categories: low quality comes first, as junk words mislead."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ["low_quality", "toxic"]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, toxicity_labels(spark, sf_dir), CATEGORIES))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.interactions(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(table(spark, sf_dir, "documents"), path)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_minhash": op9_minhash,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_centroids": op13_centroids,
}
# The others need checksums, tokenizers, fitted models or repeated marking, which SQL lacks.
SQL: dict[str, str] = {}
WORDS_SQL = r"""regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"""
SQL["op7_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS_SQL.format("t")} AS ws FROM d),
windows AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 7)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)),
bits AS (
  SELECT * EXCLUDE (lines), (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines FROM m),
ledger AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < n_words + n_words // 5 THEN 32 ELSE 0 END)::BIGINT AS failed FROM bits)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, 3::INTEGER AS policy FROM ledger"""

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op9_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes AS p ON x = p.doc_id JOIN sizes AS q ON y = q.doc_id
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT x, y FROM links
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
roots AS (SELECT x AS doc_id, least(x, min(y)) AS root FROM reach GROUP BY x)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  coalesce(root, documents.doc_id) AS component_id, coalesce(root, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""


_APART = "list_sum(list_transform(x, lambda v, i: (v - c[i]) * (v - c[i])))"


def _centroid_sql(rounds: int = centroids.ROUNDS, k: int = centroids.CLUSTERS, width: int = centroids.WIDTH) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT rid, vec_id, x, cluster, {_APART} AS d FROM v CROSS JOIN c{r}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT cluster, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS mean
  FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {width + 1})) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS (
  SELECT cluster, coalesce(l, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(mean::BIGINT ORDER BY i) AS l FROM m{r} GROUP BY cluster) USING (cluster))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width}),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, x AS c
  FROM v ORDER BY cluster LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


SQL["op13_centroids"] = _centroid_sql()

SQL["op11_filter_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS bad
  FROM labels GROUP BY doc_id),
w AS (
  SELECT *, {WORDS_SQL.format("t")} AS ws,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY t) AS least
  FROM d),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [
    len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * capitals > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order,
    s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before
  FROM orders, letters AS s),
cases AS (
  SELECT part, filter_order, step, own, n, good, bad, fails[own] AS now,
    len(list_filter(before, lambda x: fails[x])) > 0 AS earlier,
    len(list_filter(fails, lambda x: x)) AS failed
  FROM m, steps),
sums AS (
  SELECT part, filter_order, step::INTEGER AS step, own,
    coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (now AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (now AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (now AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (now AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM cases GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""
