"""The pipeline against its parts, and the registered text queries."""

from __future__ import annotations

import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from volgrid.llm import neardup, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with one planted case for each stage, a label table and a benchmark."""
    rng = random.Random(47)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    test = prose(30)
    rows, labels = [], []
    for i in range(200):
        text = prose(60)
        if i % 4 == 0:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["moron", "scum", "idiot"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        if i < 150:
            labels.append((i, 1, int(i % 4 == 0)))
    copied = rows[1][1]
    rows += [
        (300, copied, "en", "s", 1), (301, copied + " end", "en", "s", 1), (1, copied, "en", "s", 1),
        (302, f"{prose(20)} {test} {prose(20)}", "en", "s", 1),
        (303, f"{prose(20)} jane@mail.example.com {prose(20)}", "en", "s", 1),
        (304, None, None, None, None), (305, "", "en", "s", 0), (None, "no id", None, None, None),
    ]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, test)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.dtypes == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        ids[name] = [r["doc_id"] for r in (docs if name != "best_fit_packing" else out).collect()]
    clean = {i for i in range(200) if i % 4} | {302, 303, 304, 305, None}
    assert set(ids["toxicity"]) >= clean and len(set(ids["toxicity"]) - clean - {300, 301}) <= 2
    assert ids["minhash_near_dedup"].count(1) == 1
    assert not {300, 301} & set(ids["minhash_near_dedup"]) and set(ids["minhash_near_dedup"]) >= clean
    assert set(ids["benchmark_decontamination"]) == set(ids["minhash_near_dedup"]) - {302}
    assert ids["pii"] == ids["benchmark_decontamination"]
    text = {r["doc_id"]: r for r in docs.collect()}
    assert "[EMAIL]" in text[303]["text"] and not pii.base_spans(text[303]["text"])["email"]
    assert text[303]["n_chars"] == len(text[303]["text"]) and text[304]["text"] is None
    assert sorted(ids["best_fit_packing"], key=str) == sorted(ids["pii"], key=str)


def plain_run(rows, tests):
    """The five stages over ``(doc_id, text)`` in plain Python, for documents whose toxic ones say so."""
    insults = {"moron", "scum", "idiot"}
    rows = [r for r in rows if not insults & set((r[1] or "").split())]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    def similar(a, b):
        return a and b and 100 * len(a & b) >= 80 * len(a | b)

    # Groups of near copies; the smallest doc_id of each stays, and rows that repeat one go.
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = {r: shingles(r[1]) for r in order}
    kept, group = [], {}
    for r in order:
        if r in group:
            continue
        kept.append(r)
        reach = [r]
        while reach:
            x = reach.pop()
            group[x] = r
            reach += [y for y in order if y not in group and y not in reach and similar(sets[x], sets[y])]

    def words(text):
        return [w for w in (v.strip(string.punctuation) for v in (text or "").lower().split()) if w]

    def contaminated(text):
        doc = words(text)
        for test in tests:
            w = words(test)
            best = max((sum(a == b for a, b in zip(w, doc[k:])) for k in range(max(1, len(doc) - len(w) + 1))), default=0)
            if 2 * best >= len(w):
                return True
        return False

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in kept:
        if contaminated(text):
            continue
        ids = library.encode(email.sub("[EMAIL]", text or ""), add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            out.append((doc, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    return out


def test_whole_run_against_plain_python(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    tests = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(plain_run(rows, tests), key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(sequences) <= sum(r["length"] for r in got) // 4096 + 2


def test_stages_take_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names["pipeline"] is corpus_pipeline.run


def test_near_copies_from_80_percent_go(spark):
    # One word exchanged in the middle of n distinct ones: n - 9 of n + 1 shingles in common.
    texts, ids = [], 0
    for n in (45, 48, 50, 55, 70):
        base = [f"n{n}w{i}" for i in range(n)]
        for i in range(20):
            own = [f"{w}x{i}" for w in base]
            texts += [(ids, " ".join(own)), (ids + 1, " ".join([*own[: n // 2], "other", *own[n // 2 + 1 :]]))]
            ids += 2
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    for i, (doc, text) in enumerate(texts):
        n = len(text.split())
        assert (doc in left) == (doc % 2 == 0 or 100 * (n - 9) < 80 * (n + 1)), (doc, n)
    strict = {r["doc_id"] for r in neardup.near_duplicates(docs, percent=85).where("kept").collect()}
    assert len(strict - left) == 40 and neardup.search(85) == neardup.Search(85, 24, 83)


def test_decisions_are_by_text(spark, tmp_path):
    def prose(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    test = prose("t", 20)
    rows = [
        (None, prose("a")), (None, prose("a") + " end"), (None, prose("b")), (3, prose("b")),
        (4, prose("c")), (4, prose("d")), (2, prose("d")), (None, f"{prose('e')} {test}"),
        (5, prose("f")), (5, f"{prose('g')} {test}"), (6, prose("h")), (6, prose("h")), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(0, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sum(i is None and (t or "").startswith("a0 ") for i, t in left) == 1
    want = [r for k, r in enumerate(rows) if k not in (0, 1, 2, 5, 11)]
    rest = [r for r in left if not (r[1] or "").startswith("a0 ")]
    assert sorted(rest, key=str) == sorted(want, key=str)
    clean = [tuple(r) for r in corpus_pipeline.drop_benchmark_passages(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted((r for k, r in enumerate(rows) if k not in (7, 9)), key=str)
