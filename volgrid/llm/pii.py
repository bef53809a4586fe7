"""Personal data in texts: four exact rules, and a conditional random field beside them.

The rules find e-mail addresses, IP addresses, card numbers and telephone numbers of their exact
form. A linear-chain conditional random field over word shapes then reads the whole text and
adds what looks like one of them where no rule has matched, and secrets: keys, tokens and passwords.
Its spans have kinds of their own (``crf_email``, ...); those of the rules stay.

The field is trained by maximum likelihood on a small labelled table: windows of words around
spans of the rules in a bounded sample of the corpus, windows without any, and some hundred rows made
from templates of forms that the rules miss (``TEMPLATES``). A word's features are those of its shape
and of its neighbours' shapes, so that scores are looked up by shape. Tags of many sequences are
decoded at once by Viterbi over numpy arrays; a stretch of words of letters alone has no span.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_short, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field: those of the rules in other forms, and keys, tokens and passwords.
FIELD_KINDS = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
#: Bound of the fit: expected documents with a span of the rules that windows are taken from, and
#: windows taken from each. They bound the fit alone: every word of every document is decoded.
TRAIN_DOCS = 1_000
WINDOWS = 6
#: Words on either side of a span in a training window.
AROUND = 8
#: Labelled rows made from each template, and how often each weighs for so many corpus windows.
PER_TEMPLATE = 12
TEMPLATE_SHARE = 1_500
STEPS = 120
#: Long texts are decoded in sequences that end at the first word of letters alone after so many
#: words, and reach so many words into their neighbours.
SEQUENCE = 128
LONGEST = 160
OVERLAP = 16
#: Longer words are several to the field, so that all of a text without spaces is read.
WORD_LENGTH = 400
#: Distinct words whose shape is kept per task.
KEPT = 150_000
KEPT_SHAPES = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(rf"\S{{1,{WORD_LENGTH}}}")

#: Forms that the rules miss, and others that are no personal data. ``{kind:...}`` marks a span,
#: ``<x5>`` stands for five characters of an alphabet (``_ALPHABETS``), and ``w`` alone for a word.
TEMPLATES = (
    "w {phone:(<93>) <93>-<94>} w", "w {phone:<93>-<93>-<94>} w", "w {phone:<93>.<93>.<94>} w", "w {phone:(0<92>) <94>-<94>} w",
    "tel {phone:0<92> <97>} w", "w {phone:0<92>/<97>} w", "call {phone:0<92>-<92>-<92>-<92>} w",
    "w {email:<x4>.<x3>[at]<x4>.<x7>.<x3>} w", "w {email:<x6>(at)<x5>.<x3>} w", "w {email:<x3><92>[at]<x4><92>.<x3>} w",
    "w {email:<x6>@<x8>} w", "w {card:<94>.<94>.<94>.<94>} w", "w {card:<94>/<94>/<94>/<94>} w",
    "w {card:<94>_<94>_<94>_<94>} w", "w {ip:[<92>.<92>.<93>.<91>]} w",
    "w {secret:AKIA<K16>} w", "w {secret:ASIA<K16>}, w", "w {secret:<K20>} w", "w {secret:<x3>_<m30>} w",
    "w {secret:<x2>_<x4>_<m24>} w", "w {secret:<x4>-<99><93>-<m24>} w", "w {secret:<m32>} w",
    "w {secret:password=<h18>} w", "w {secret:password=<m8>} w", "w {secret:pwd:<m10>} w",
    "w {secret:secret='<m16>'} w", "w {secret:api_key=<h24>} w", "w {secret:key=\"<m24>\"} w",
    "w token = {secret:\"<h40>\"} w", "w secret = {secret:\"<m20>\"} w", "w = {secret:\"<h32>\"} w",
    "w token: {secret:<h32>} w", "bearer {secret:<m28>} w", "w password: {secret:<m12>} w", "w {secret:<h40>} w",
    "w <91>.<91> w <94> w", "w <94> w <94> w w", "w <91>.<91>.<91> w <92> w", "w <92>,<93> w w", "w <96> w <92> w",
    "w <94>-<92>-<92> w <92>:<92> w", "w <92>.<92>.<94> w w", "w <x3>=<x4> w <x4>=<92> w", "w <x5> = \"<x5>\" w",
    "w token w w", "w password w w.", "w <x4><91> w <X2><92> w", "w <h7> w w", "w (<92>) w [<91>] w", "w <92>% w $<92>.<92> w",
    "w <x3>/<x4>/<x3>.<x3> w", "w <x5>-<x4>-<x5> w", "w <X18> w", "w #### w *** w", "w <93>-<91>-<92>-<96>-<91> w", "w <91>/<91> w <92>-<92> w",
)
#: Words that name what follows them.
NAMES = frozenset("password passwd passphrase pwd secret token apikey api_key access_key secret_key key bearer".split())
_ALPHABETS = {
    "9": "0123456789", "x": "abcdefghijklmnopqrstuvwxyz", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef",
    "K": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "m": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}


def template_row(template: str, rng: random.Random) -> tuple[list[str], list[str]]:
    """Words and tags of one text made from a template."""

    def made(part: str) -> str:
        return _SLOT.sub(lambda m: "".join(rng.choice(_ALPHABETS[m[1]]) for _ in range(int(m[2]))), part)

    words, tags = [], []
    for kind, inside, outside in _MARKED.findall(template):
        if kind:
            some = made(inside).split()
            words += some
            tags += [f"{'I' if i else 'B'}-{kind}" for i in range(len(some))]
        elif outside == "w":
            word = made(f"<x{rng.randint(1, 12)}>")
            words.append(word.capitalize() if rng.random() < 0.2 else word)
            tags.append("O")
        elif outside == ",":
            words[-1] += outside
        else:
            words.append(made(outside))
            tags.append("O")
    return words, tags


_MARKED = re.compile(r"\{(\w+):([^}]*)\}|(\S+)")
_SLOT = re.compile(r"<([9xXhKm])(\d+)>")


def template_rows(templates: tuple[str, ...] = TEMPLATES, each: int = PER_TEMPLATE, seed: int = 1) -> list[tuple[list[str], list[str]]]:
    """The labelled table: ``each`` rows of every template."""
    rng = random.Random(seed)
    out = []
    for t in templates:
        for i in range(each):
            words, tags = template_row(t, rng)
            # Some texts begin or end with what is marked.
            first = int(i % 4 == 1 and tags[0] == "O")
            last = len(words) - int(i % 4 == 2 and tags[-1] == "O")
            out.append((words[first:last], tags[first:last]))
    return out


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind the spans (code points, end exclusive) of the exact rules."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                end = domain.end()
                out["email"].append((start, end))
            at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
    return out


_RUN = re.compile(r"([A-Z]+)|([^\W\d_A-Z]+)|([0-9]+)|(.)", re.S)
#: A long run of letters and digits mixed, by its alphabet.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}(?![A-Za-z0-9])")
_AT = re.compile(r"[\[(]at[\])]", re.I)
_HEX, _CAPITALS = re.compile(r"[0-9a-f]+"), re.compile(r"[0-9A-Z]+")


def _mixed_sign(run: re.Match) -> str:
    kind = "\x01" if _HEX.fullmatch(run[0]) else "\x02" if _CAPITALS.fullmatch(run[0]) else "\x03"
    return kind if len(run[0]) >= 16 else kind + "\x04"


_SECRET_SIGN = re.compile(r"[hKm](?!<)|&")
_SIGNS = {"\x01": "h", "\x02": "K", "\x03": "m", "\x04": "<"}


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits (by length) as one sign each; the rest as is.

    Long runs of letters and digits mixed are one sign, and so is a name of a secret (``&``).
    """
    signs = []
    plain = _AT.sub("@", word)
    for upper, lower, digits, other in _RUN.findall(_MIXED.sub(_mixed_sign, plain)):
        if lower and lower in NAMES:
            signs.append("&")
        elif upper:
            signs.append("X")
        elif lower:
            signs.append("x")
        elif digits:
            n = len(digits)
            signs.append(str(n) if n <= 4 else "a" if n <= 6 else "b" if n <= 8 else "c" if n <= 12 else "d" if n <= 19 else "e")
        else:
            signs.append(_SIGNS.get(other) or (other if other in "@.-+()/:[]_,%='\"" else "*"))
    return "".join(signs) if len(signs) <= 16 else "".join(signs[:10]) + "~" + "".join(signs[-5:])


def features(sign: str) -> list[str]:
    """Features of a shape, shared by similar shapes."""
    core = sign.strip(".,:;")
    kinds = "".join(sorted({("d" if c in "1234abcde" else "x" if c in "xX" else c) for c in core}))
    mixed = "".join(c for c in core if c in "hKm&")
    return [
        f"s{sign}", f"c{core}", f"k{kinds}", f"f{core[:2]}", f"l{core[-2:]}",
        f"n{min(sum(c in '1234abcde' for c in core), 5)}", f"@{'@' in core}", f".{core.count('.')}",
        f"m{mixed}{'<' in core}",
    ]


@dataclass(frozen=True)
class Field:
    """Weights per feature and tag of a word, the word before and the word after; of tag pairs."""

    index: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def emissions(self, sign: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [self.index[f] for f in features(sign) if f in self.index]
        return tuple(w[at].sum(axis=0) for w in (self.own, self.before, self.after))


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: an inner tag needs its kind before."""
    out = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, left in enumerate(TAGS):
                if left[1:] != tag[1:]:
                    out[i, j] = -1e4
    return out


def fit(rows: list[tuple[list[str], list[str]]], steps: int = STEPS) -> Field:
    """The field of ``(words, tags)`` rows, by gradient ascent of the penalised likelihood.

    Rows of equal shapes and tags count as one row that weighs as many.
    """
    folded = Counter((tuple(map(shape, words)), tuple(tags)) for words, tags in rows)
    signs: dict[str, int] = {"": 0}
    for shapes, _ in folded:
        for sign in shapes:
            signs.setdefault(sign, len(signs))
    index: dict[str, int] = {}
    for sign in signs:
        for f in features(sign):
            index.setdefault(f, len(index))
    has = np.zeros((len(signs), len(index)))
    for sign, i in signs.items():
        has[i, [index[f] for f in features(sign)]] += 1
    n, length, tags = len(folded), max(len(w) for w, _ in folded), len(TAGS)
    many = np.array(list(folded.values()), dtype=float)
    word = np.zeros((n, length + 2), dtype=np.int64)  # an empty shape on either side
    gold = np.zeros((n, length), dtype=np.int64)
    real = np.zeros((n, length))
    number = {t: i for i, t in enumerate(TAGS)}
    for r, (shapes, labels) in enumerate(folded):
        word[r, 1 : len(shapes) + 1] = [signs[sign] for sign in shapes]
        gold[r, : len(shapes)] = [number[t] for t in labels]
        real[r, : len(shapes)] = 1
    own, before, after = word[:, 1:-1], word[:, :-2], word[:, 2:]
    blocked = _allowed()
    weights = {k: np.zeros((len(index), tags)) for k in ("own", "before", "after")} | {"moves": np.zeros((tags, tags))}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    truth = np.eye(tags)[gold] * real[:, :, None]
    pairs = np.zeros((tags, tags))
    both = real[:, 1:] > 0
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), np.broadcast_to(many[:, None], both.shape)[both])
    start = np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        tables = {k: has @ weights[k] for k in ("own", "before", "after")}
        emit = (tables["own"][own] + tables["before"][before] + tables["after"][after]) * real[:, :, None]
        moves = weights["moves"] + blocked
        forward = np.zeros((n, length, tags))
        forward[:, 0] = emit[:, 0] + start
        for t in range(1, length):
            moved = lse(forward[:, t - 1, :, None] + moves, 1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None] > 0, moved, forward[:, t - 1])
        backward = np.zeros((n, length, tags))
        for t in range(length - 2, -1, -1):
            moved = lse(moves[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None] > 0, moved, 0)
        total = lse(forward[:, -1], 1)
        marginal = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        expected = np.zeros((tags, tags))
        for t in range(1, length):
            joint = forward[:, t - 1, :, None] + moves + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            expected += (np.exp(joint) * (many * real[:, t])[:, None, None]).sum(axis=0)
        error = (truth - marginal) * many[:, None, None]
        slopes = {"moves": pairs - expected}
        for k, at in (("own", own), ("before", before), ("after", after)):
            by_sign = np.zeros((len(signs), tags))
            np.add.at(by_sign, at.ravel(), error.reshape(-1, tags))
            slopes[k] = has.T @ by_sign
        for k, w in weights.items():
            slope = slopes[k] / many.sum() - 1e-4 * w
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            w += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights["own"], weights["before"], weights["after"], weights["moves"])


def tagged(text: str, spans: dict[str, list[tuple[int, int]]]) -> tuple[list[str], list[str]]:
    """The words of a text and their tags by the rules."""
    owner = {}
    words = list(_WORD.finditer(text))
    ends = [w.end() for w in words]
    every = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    tags = ["O"] * len(words)
    for a, b, kind in every:
        inside = False
        i = bisect_right(ends, a)
        while i < len(words) and words[i].start() < b:
            if i not in owner:
                tags[i] = f"{'I' if inside else 'B'}-{kind}"
                owner[i] = kind
                inside = True
            i += 1
    return [w[0] for w in words], tags


def training_rows(docs: DataFrame, n: int = TRAIN_DOCS) -> list[tuple[list[str], list[str]]]:
    """The labelled table: windows of about ``n`` documents, and the rows of the templates.

    Documents are drawn by a hash of their text, at a rate that follows from how many have a span;
    nothing is sorted, so no task gets more of them than any other.
    """
    signs = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{13}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
    rate = n / max(n, docs.where(signs).count())
    share = F.pmod(F.xxhash64("text"), F.lit(2**32)) / float(2**32)
    # The hash first: it spares most texts the search.
    drawn = docs.select("text").where(share < rate).where(signs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[list[str], list[str]]] = []
            for text in batch.column(0).to_pylist():
                words, tags = tagged(text, base_spans(text))
                marked = [i for i, t in enumerate(tags) if t[0] == "B"][:WINDOWS]
                plain = [i for i, t in enumerate(tags) if t == "O"][:: max(1, len(tags) // 2)][:2]
                for i in marked + plain:
                    a = max(0, i - AROUND)
                    while a < len(tags) and tags[a][0] == "I":
                        a += 1
                    some = words[a : i + AROUND]
                    # What looks like a secret has no label from the rules.
                    if not any(_SECRET_SIGN.search(shape(w)) for w in some):
                        rows.append((some, tags[a : i + AROUND]))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], strings), pa.array([r[1] for r in rows], strings)],
                names=["words", "tags"],
            )

    found = drawn.mapInArrow(windows, "words array<string>, tags array<string>").collect()  # (WINDOWS + 2) * n, as expected
    rows = sorted((list(r["words"]), list(r["tags"])) for r in found if r["words"])
    return rows + template_rows() * max(1, len(rows) // TEMPLATE_SHARE)


class Decoder:
    """Viterbi over many sequences of shapes at once."""

    def __init__(self, model: Field):
        self.model = model
        self.moves = (model.moves + _allowed()).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.signs: dict[str, int] = {"": 0}
        self.tables = [t[None] for t in self.model.emissions("")]
        self.plain = np.zeros(1, dtype=bool)

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.signs) > KEPT_SHAPES:
            self.forget()
        out = list(map(self.words.get, words))
        if None in out:
            found = {}
            fresh: list[str] = []
            for w in {w for w, c in zip(words, out) if c is None}:
                sign = shape(w)
                if sign not in self.signs:
                    self.signs[sign] = len(self.signs)
                    fresh.append(sign)
                found[w] = self.signs[sign]
            if fresh:
                rows = [self.model.emissions(s) for s in fresh]
                self.tables = [np.concatenate([t, np.stack([r[i] for r in rows])]) for i, t in enumerate(self.tables)]
                self.plain = np.concatenate([self.plain, [set(s) <= set("xX.,") for s in fresh]])
            out = [found[w] if c is None else c for w, c in zip(words, out)]
            if len(self.words) + len(found) > KEPT:
                self.words = {}
            keep_short(self.words, found)
        return np.array(out, dtype=np.int64)

    def decode(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Tag numbers of the words of each text."""
        codes = self.codes(list(chain.from_iterable(lists)))
        own, before, after = (t.astype(np.float32) for t in self.tables)
        # Sequences: where they begin and end, and the part of them whose tags count.
        spans: list[tuple[int, int, int, int]] = []
        unlike = np.concatenate([[0], np.cumsum(~self.plain[codes])])
        at = 0
        for words in lists:
            first, left, end = at, at, at + len(words)
            while left < end:
                cut = end
                if end - left > LONGEST:
                    cut = left + SEQUENCE
                    while cut < left + LONGEST and not self.plain[codes[cut]]:
                        cut += 1
                # Words of letters alone make no span, so what has no other word needs no decoding.
                if unlike[cut] > unlike[left]:
                    spans.append((max(first, left - OVERLAP), min(end, cut + OVERLAP), left, cut))
                left = cut
            at = end
        tags = np.zeros(len(codes), dtype=np.int8)
        if spans:
            padded = np.concatenate([[0], codes, [0]])
            table = np.array(spans)
            table = table[np.argsort(table[:, 1] - table[:, 0], kind="stable")]
            total = int((table[:, 1] - table[:, 0]).sum())
            for some in np.array_split(table, max(1, -(-total // 40_000))):
                self._decode_some(padded, some, own, before, after, tags)
        cuts = np.cumsum([len(w) for w in lists])[:-1]
        return np.split(tags, cuts)

    def _decode_some(self, padded, spans, own, before, after, tags) -> None:
        if not len(spans):
            return
        starts, lengths = spans[:, 0], spans[:, 1] - spans[:, 0]
        low, high = spans[:, 2] - starts, spans[:, 3] - starts
        n, longest = len(starts), int(lengths.max())
        inner = [t[0] == "I" for t in TAGS]
        back = np.zeros((longest, n, len(TAGS)), dtype=np.int8)
        state = None
        last = len(padded) - 1
        for t in range(longest):
            at = np.minimum(starts + t + 1, last)
            # Neighbours beyond the sequence are unknown words.
            left = padded[at - 1] if t else np.zeros(n, dtype=np.int64)
            right = np.where(t + 1 < lengths, padded[np.minimum(at + 1, last)], 0)
            emit = own[padded[at]] + before[left] + after[right]
            if state is None:
                state = emit + np.where(inner, np.float32(-1e4), np.float32(0))
                continue
            steps = state[:, :, None] + self.moves
            back[t] = steps.argmax(axis=1)
            moved = steps.max(axis=1) + emit
            state = np.where((t < lengths)[:, None], moved, state)
        tag = state.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            mine = (t >= low) & (t < high)
            tags[starts[mine] + t] = tag[mine]
            tag = np.where(t < lengths, back[t][np.arange(n), tag], tag)


def _plausible(kind: str, text: str) -> bool:
    """An exact check behind the field: a number that is no card number is left alone."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        return "@" in text or "[at]" in text.lower() or "(at)" in text.lower()
    if kind == "secret":
        # A name alone, or a short value without one, is left alone.
        runs = re.findall(r"[A-Za-z0-9]+", text)
        named = any(r.lower() in NAMES for r in runs[:-1])
        long = any(len(r) >= 16 and any(c.isdigit() for c in r) and any(c.isalpha() for c in r) for r in runs)
        return long or (named and len(runs[-1]) >= 8 and any(c.isdigit() for c in runs[-1]))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 4 <= len(digits) <= 12 if kind == "ip" else 7 <= len(digits) <= 15


def added_spans(text: str, tags: np.ndarray, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the field that touch none of the rules'."""
    if not tags.any():
        return []
    words = list(_WORD.finditer(text))
    starts, ends = [], []  # of the rules' spans, those that overlap as one
    for a, b in sorted(s for k in KINDS for s in base[k]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    i = 0
    while i < len(words):
        tag = TAGS[tags[i]]
        if tag == "O":
            i += 1
            continue
        j = i + 1
        while j < len(words) and TAGS[tags[j]] == f"I-{tag[2:]}":
            j += 1
        raw = text[words[i].start() : words[j - 1].end()]
        kept = raw.strip(".,;:!?\"'")
        start = words[i].start() + raw.find(kept)
        end = start + len(kept)
        i = j
        at = bisect_right(ends, start)  # the first span that ends behind the start
        if _plausible(tag[2:], kept) and not (at < len(starts) and starts[at] < end):
            out.append((f"crf_{tag[2:]}", start, end))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _words(text: str) -> list[str]:
    """The words of a text as ``_WORD`` finds them."""
    words = text.split()
    return _WORD.findall(text) if words and max(map(len, words)) > WORD_LENGTH else words


def _found(part: pa.RecordBatch, decoder: Decoder):
    """Per text its base spans by kind and the added ones."""
    texts = [t or "" for t in part.column(1).to_pylist()]
    for text, tags in zip(texts, decoder.decode([_words(t) for t in texts])):
        base = base_spans(text)
        extra = sorted(added_spans(text, tags, base), key=lambda s: (FIELD_KINDS.index(s[0][4:]), s[1]))
        yield text, base, extra


def find(docs: DataFrame, model: Field) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans`` of every row.

    The counts by kind and the digest are those of the rules; ``spans`` lists all spans, the rules'
    first, and ``n_spans`` counts them.
    Null text is empty. Rows keep their number; other columns are not looked at.
    """

    def run(part: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans, added, total = [], [], [], []
        for _, base, extra in _found(part, decoder):
            for k, kind in enumerate(KINDS):
                counts[k].append(len(base[kind]))
            own = [(k, a, b) for k in KINDS for a, b in base[k]]
            digests.append(hashlib.sha256(joined(own).encode()).hexdigest())
            spans.append(joined(own + extra))
            added.append(len(extra))
            total.append(len(own) + len(extra))
        return pa.RecordBatch.from_arrays(
            [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
             pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(total, pa.int64())],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return map_texts(rows, run, schema, setup=lambda: Decoder(model))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, then longest."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.removeprefix('crf_').upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: Field) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in ``text`` replaced by its kind."""
    names = docs.columns

    def run(part: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
        texts = [masked(t, [(k, a, b) for k in KINDS for a, b in base[k]] + extra) for t, base, extra in _found(part, decoder)]
        kept = [None if null else t for t, null in zip(texts, part.column(1).is_null().to_pylist())]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], names=["rest", "text"])

    others = [c for c in names if c != "text"]
    kinds = dict(docs.dtypes)
    rest = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in others) + ">"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), "text")
    out = map_texts(packed, run, f"rest {rest}, text string", setup=lambda: Decoder(model))
    return out.select(*["text" if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])
