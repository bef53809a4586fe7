"""Filter interactions, SentencePiece spans and centroid clusters against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import shutil
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from volgrid.llm import centroids, filters, pieces

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter interactions ---------------------------------------------------------------------


def fails(text, doc, same):
    words = WORD.findall(text)
    return (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        doc is not None and any(d is not None and d < doc for d in same),
    )


def brute_audit(docs, labels):
    by_text = {}
    for doc, text, _ in docs:
        by_text.setdefault(text or "", []).append(doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = [(s or "", fails(t or "", d, by_text[t or ""]), d in good, d in toxic) for d, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                earlier = [any(m[b] for b in before) for _, m, _, _ in mine]
                removed = [m[f] and not e for (_, m, _, _), e in zip(mine, earlier)]
                shapley[f] += sum(removed)
                out[part, "".join("ABCDE"[i] for i in order), step] = [
                    sum(not e and not m[f] for (_, m, _, _), e in zip(mine, earlier)),
                    sum(removed),
                    sum(m[f] and e for (_, m, _, _), e in zip(mine, earlier)),
                    sum(m[f] and sum(m) == 1 for _, m, _, _ in mine),
                    sum(r and g for (_, _, g, _), r in zip(mine, removed)),
                    sum(r and t for (_, _, _, t), r in zip(mine, removed)),
                    f,
                ]
        for (p, _, _), values in out.items():
            if p == part:
                values[6] = shapley[values[6]]
    return out


def as_audit(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)] + ["Aa", "B", "$x"]
    texts = [None, "", " \t\n\x0b", "A", "é ü", "a#b", "　 wide space"]
    texts += [" ".join(rng.choice(pool[: rng.choice([60, 400, 403])]) for _ in range(rng.randint(150, 300))) for _ in range(12)]
    texts.append("y " * 30_000)
    docs = [(i, rng.choice(texts), rng.choice(["hot", "hot", "b", None, ""])) for i in range(90)]
    rng.shuffle(docs)
    # Copies whose smallest id arrives last, repeated rows, rows without an id.
    docs = [(1000 - i, "copied text", "hot") for i in range(30)] + docs + [docs[3], docs[3], (None, "", "hot"), (None, None, None), (None, "copied text", "b")]
    docs += [(7, "one id, two parts", "b"), (7, "one id, two parts", "hot"), (5, "one id, two parts", None), (-3, "copied text", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(-5, 990, 2)]
    labels += [(0, 0, 0), (0, 1, 1), (None, 1, 1), (1000, 1, 1), (999, 1, 0)]
    return docs, labels


def write_files(folder, docs, files):
    folder.mkdir()
    for i in range(files):
        some = docs[i * len(docs) // files : (i + 1) * len(docs) // files]
        # Columns with the names of the operator's own.
        table = pa.table(
            {"doc_id": pa.array([d for d, _, _ in some], pa.int64()), "text": pa.array([t for _, t, _ in some], pa.string()),
             "source": pa.array([s for _, _, s in some], pa.string()), "mask": pa.array(range(len(some))), "part": ["x"] * len(some)}
        )
        pq.write_table(table, folder / f"part-{i}.parquet")


def write_labels(path, labels):
    columns = [pa.array([r[i] for r in labels], pa.int64()) for i in range(3)]
    pq.write_table(pa.table(columns, names=["doc_id", "quality", "toxic"]), path)


@pytest.mark.parametrize("files, batches, per_task, per_key", [(1, 1, 100_000, 1), (6, 6, 3, 256), (5, 3, 50, 4)])
def test_filter_audit(spark, tmp_path, audited, monkeypatch, files, batches, per_task, per_key):
    monkeypatch.setattr(filters, "PER_TASK", per_task)
    monkeypatch.setattr(filters, "TEXTS_PER_KEY", per_key)
    docs, labels = audited
    write_files(tmp_path / "documents.parquet", docs, files)
    write_labels(tmp_path / "labels.parquet", labels)
    got = filters.interactions(spark, str(tmp_path / "documents.parquet"), str(tmp_path / "labels.parquet"), batches)
    assert as_audit(got) == brute_audit(docs, labels)


def test_filter_counters_after_later_files(spark, tmp_path, audited):
    """A second run takes back what smaller ids in new files make wrong."""
    docs, labels = audited
    write_labels(tmp_path / "labels.parquet", labels)
    write_files(tmp_path / "all", docs, 4)
    (tmp_path / "documents").mkdir()
    for n in (2, 4):
        for i in range(n - 2, n):
            shutil.copy(tmp_path / "all" / f"part-{i}.parquet", tmp_path / "documents")
        filters.run_stream(spark, str(tmp_path / "documents"), str(tmp_path / "labels.parquet"), str(tmp_path / "run"), 1)
        some = docs[: n * len(docs) // 4]
        counts = filters.counters(spark, str(tmp_path / "run"))
        assert as_audit(filters.all_orders(counts)) == brute_audit(some, labels)
    changes = spark.read.parquet(str(tmp_path / "run/changes"))
    assert changes.where("change < 0").count() > 0


def test_filter_audit_of_nothing(spark, tmp_path):
    write_files(tmp_path / "documents", [], 1)
    write_labels(tmp_path / "labels.parquet", [])
    got = filters.interactions(spark, str(tmp_path / "documents"), str(tmp_path / "labels.parquet"))
    assert got.count() == 0 and len(got.columns) == 10


# --- SentencePiece ---------------------------------------------------------------------------


def odd_texts(n):
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "a", "b", "é", "日", "\n", "\t", "ﬁ", "①", "ｶﾞ", "　", "̀", "\x00", "😀", "‍", "Å", "<s>", "<0x41>", "foo", "\r", "\x85", "A", "¨", "<unk>"]
    return ["", " ", "\n", "▁"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def model_with(rule, extra, dummy):
    """The piece model with another, non-trivial character map."""
    other = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=extra, escape_whitespaces=True
    )
    with open(PIECE_MODEL, "rb") as file:
        fields = [(n, v) for n, v in pieces._fields(file.read()) if n in (pieces.PIECES, pieces.TRAINER)]
    spec = pieces._message(pieces.NORMALIZER, other.serialized_normalizer_spec())
    return b"".join(pieces._message(n, v) for n, v in fields) + spec


CASES = [None] + [(rule, extra, dummy) for rule in ("nmt_nfkc", "nfkc_cf") for extra in (True, False) for dummy in (True, False)]


@pytest.mark.parametrize("case", CASES)
def test_pieces_and_spans_are_the_library_s(case):
    proto = model_with(*case) if case else open(PIECE_MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    own = pieces.Model(proto=proto)
    texts = odd_texts(1500)
    wanted = library.encode(texts, add_bos=True, add_eos=True)
    for text, ids, (got, begins, ends) in zip(texts, wanted, own.encode(texts)):
        assert got.tolist() == ids
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        # The library counts bytes in this form.
        assert list(zip(begins.tolist(), ends.tolist()))[1:-1] == spans
        assert (begins[0], ends[0]) == (0, 0) or not spans
        assert own.decode(got) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_longest_prefix_normalisation(rule):
    """Normalised text and its alignment, against the library's own."""
    proto = model_with(rule, True, True)
    own = pieces.Model(proto=proto).normalizer
    other = sentencepiece.SentencePieceNormalizer(model_proto=proto)
    for text in odd_texts(800):
        wanted, places = other.normalize(text, with_offsets=True)
        normal, source = own(text)
        assert normal == wanted
        # The library gives code points: bytes of the text up to each, at each normalised one.
        starts = [0] + np.cumsum([len(c.encode()) for c in text]).tolist()
        firsts = [0] + np.cumsum([len(c.encode()) for c in normal]).tolist()
        # For a text of white space alone the library gives no place.
        assert not normal or [int(source[i]) for i in firsts] == [starts[p] for p in places]


def test_whole_text_segments_without_byte_pieces():
    """Without byte pieces unknown characters join across line ends: no cuts, spans still right."""
    with open(PIECE_MODEL, "rb") as file:
        fields = list(pieces._fields(file.read()))
    out = b""
    for number, value in fields:
        if number == pieces.TRAINER:
            value += bytes([0x98, 0x02, 0])  # byte_fallback off
        if number == pieces.PIECES and dict(pieces._fields(value)).get(3) == pieces.BYTE:
            value = value[: value.rindex(bytes([0x18, pieces.BYTE]))] + bytes([0x18, 5])  # unused
        out += pieces._message(number, value)
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    own = pieces.Model(proto=out)
    texts = ["日\n\n本 a\nb", "\n", "plain words", "x\n"]
    for text, (ids, begins, ends) in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[1:-1] == want


def test_pieces_as_tables(spark):
    texts = [None, "", "same", "same", "héllo  wörld\n日本", "word " * 60_000, "x" * 70_000, *odd_texts(60)]
    rows = [(None if i % 9 == 8 else i // 2, t, [1], "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    want, spans = [], []
    for doc, text, _, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
        found = library.encode(text or "", return_type="proto").pieces
        size = found[-1].end if found else 0
        begins, ends = [0, *(p.begin for p in found), size], [0, *(p.end for p in found), size]
        spans.append((doc, ids, begins, ends, decoded))
    got = pieces.digests(docs, PIECE_MODEL).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r[:4])) for r in got)
    crc = sorted(zlib.crc32(np.array(b + e, "<i8").tobytes()) for _, _, b, e, _ in spans)
    assert sorted(r["spans_crc32"] for r in got) == crc
    assert sorted(map(str, spans)) == sorted(str(tuple(r)) for r in pieces.encode(docs, PIECE_MODEL).collect())
    assert pieces.digests(docs.limit(0), PIECE_MODEL).count() == 0


# --- centroid clusters -----------------------------------------------------------------------


def brute_clusters(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centres[j] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    per = {}
    for _, j, d in out:
        per[j] = per.get(j, 0) + d
    most = 2**63 - 1
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), j, min(d, most), min(per[j], most), min(sum(per.values()), most), shas[j]) for i, j, d in out)


def clusters(spark, rows, kind="float", **settings):
    df = spark.createDataFrame([(i, v, i) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster long")
    out = centroids.centroid_clusters(df.repartition(3), **settings)
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def as_float(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width)) * 3
    return [(i, (centres[rng.integers(7)] + rng.normal(size=width) * rng.choice([0.02, 1.0])).tolist()) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 3, 8])
def test_centroids(spark, monkeypatch, rounds):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rows = vectors(500, 6, rounds)
    # Copies of a third of all, ties on a grid, odd rows.
    rows += [(500 + i, rows[0][1]) for i in range(250)] + [(800 + i, [float(i % 2)] * 6) for i in range(20)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0] * 5 + [None]), (905, [float("nan")] * 6), (906, [float("inf")] * 6), (907, [float("-inf")] * 6), (908, [-0.0] * 6)]
    rows += [(None, [0.5] * 6), (None, [0.25] * 6), (3, rows[3][1]), (3, rows[4][1])]
    rows = [(i, as_float(v)) for i, v in rows]
    got = clusters(spark, rows, k=9, rounds=rounds, width=6)
    assert got == brute_clusters(rows, 9, rounds, 6, 64)


def test_centroids_of_few_and_of_large_numbers(spark):
    few = [(i, as_float(v)) for i, v in vectors(5, 4, 1)]
    assert clusters(spark, few, k=9, width=4) == brute_clusters(few, 9, 3, 4, 64)
    assert clusters(spark, few[:1], k=9, width=4) == brute_clusters(few[:1], 9, 3, 4, 64)
    assert clusters(spark, [], k=9, width=4) == []
    rng = random.Random(4)
    for top in (1e7, 1e12, 1e30, 1e300):
        large = [(i, [rng.uniform(-top, top) for _ in range(4)]) for i in range(60)] + few
        got = clusters(spark, large, "double", k=5, width=4)
        assert got == brute_clusters(large, 5, 3, 4, 64)


def test_heaps_leave_most_vectors_alone():
    """After the first pass only vectors whose gap has expired are compared with all centroids."""
    x = centroids.scaled(np.array([v for _, v in vectors(2000, 8, 3)]))
    centres = [x[i].tolist() for i in range(6)]
    cluster, heaps, drift = np.full(len(x), -1, dtype=np.int32), [[] for _ in centres], [0.0] * 6
    looked = []
    for _ in range(8):
        looked.append(len(centroids.advance(x, cluster, heaps, centres, drift)))
        squares = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        assert (cluster == squares.argmin(axis=1)).all()
        assert sum(map(len, heaps)) == len(x)
        moved = [(x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else c for j, c in enumerate(centres)]
        steps = [math.dist(a, b) for a, b in zip(centres, moved)]
        drift = [d + steps[j] + max(s for i, s in enumerate(steps) if i != j) for j, d in enumerate(drift)]
        centres = moved
    assert looked[0] == len(x) and looked[-1] < len(x) / 3
