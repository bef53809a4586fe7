"""Encoding and decoding by a SentencePiece model, with the source bytes of every piece.

1. *Normalisation.* At each place of the text the longest key of the model's compiled character
   map is replaced by its value; without one a character stays as it is. White space is escaped,
   a mark is put in front, and white space is collapsed, as the model's settings say. Next to each
   normalised byte the place of the source character it came from is recorded.
2. *Encoding.* Normalised text is cut where no piece of the vocabulary can reach across: before
   white space that follows another character, and around line ends. Each distinct segment is
   merged once per worker, by the library with the model's own normalisation switched off, and
   then looked up. Models that such cuts could change (see ``Model``) take whole texts.
3. *Projection.* The lengths of the pieces add up to places in the normalised text, which the
   recorded alignment turns into spans of source bytes. Of the byte pieces of one character the
   last has its whole span, those before it an empty one at its start; begin and end marks have
   empty spans at the ends of the text.
4. *Decoding* is the library's ``decode`` of the ids.

Null text counts as empty: begin and end marks alone. Rows are worked on one by one, so repeated
rows and ids give equal results, and an empty table gives no rows. Other columns are not looked
at. Models with user-defined pieces or white space as a suffix are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Distinct segments that a worker keeps, each of up to ``LONGEST_KEPT`` code points: some 60 MB.
KEPT = 300_000
LONGEST_KEPT = 48
SPACE = "▁"
#: Fixed values of the model file: numbers of fields and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
SPACE_AS_SUFFIX, BYTE_FALLBACK = 24, 35
USER_DEFINED, BYTE = 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _message(number: int, data: bytes) -> bytes:
    size, head = len(data), bytearray([number << 3 | 2])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    return bytes(head) + bytes([size]) + data


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 keys, and the values' text."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.array = np.frombuffer(blob, "<u4", size // 4, 4)
        self.units = self.array.tolist()
        self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The value of the longest key that starts at ``at``, and the key's length."""
        units, found = self.units, None
        node = self._children(units[0])
        for length, byte in enumerate(data[at:], 1):
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._children(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, length
        if found is None:
            return None
        start, length = found
        return self.values[start : self.values.index(b"\0", start)], length

    @staticmethod
    def _children(unit):
        return unit >> 10 << ((unit & 512) >> 6)

    def has_inner_space(self) -> bool:
        """Whether a key holds a space that is not its first byte."""
        labels = np.arange(1, 256, dtype=np.uint32)
        bases = self._children(self.array[:1])
        first = True
        while len(bases):
            places = bases[:, None] ^ labels[None, :]
            units = np.where(places < len(self.array), self.array[np.minimum(places, len(self.array) - 1)], 0)
            hit = (units & 0x800000FF) == labels[None, :]
            if not first and hit[:, 31].any():
                return True
            bases, first = places[hit] ^ self._children(units[hit]), False
        return False


def _character(data: bytes, at: int) -> int:
    """Length of the UTF-8 character at a place."""
    lead = data[at]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Text to (normalised text, source byte of each normalised byte and of the end)."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        blob = fields.get(CHARSMAP, b"")
        self.map = CharMap(blob) if blob else None
        self.dummy_prefix = bool(fields.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(fields.get(REMOVE_EXTRA, 1))
        self.space = (SPACE if fields.get(ESCAPE, 1) else " ").encode()
        self.stretch = re.compile(rb"(?s).+" if self.map and self.map.has_inner_space() else rb" |[^ ]+")
        self.known: dict[bytes, list[tuple[bytes, int]]] = {}

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        return self._plain(text) if self.map is None and not self.remove_extra else self._mapped(text)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """Without rules every byte keeps its character, and a space becomes ``space``."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        array = np.frombuffer(data, np.uint8)
        places = np.arange(len(array))
        own = np.maximum.accumulate(np.where((array & 0xC0) == 0x80, 0, places))
        width = len(self.space)
        if width > 1 and " " in text:
            own = np.repeat(own, np.where(array == 32, width, 1))
        space = self.space.decode()
        front = width if self.dummy_prefix else 0
        out = text.replace(" ", space)
        return (space + out if front else out), np.concatenate([np.zeros(front, np.int64), own, [len(data)]])

    def _prefixes(self, data: bytes) -> list[tuple[bytes, int]]:
        """A stretch as (value, length of its key): the longest key each time."""
        found = self.known.get(data)
        if found is None:
            found, at = [], 0
            while at < len(data):
                hit = self.map.longest(data, at) if self.map else None
                if hit is None:
                    size = _character(data, at)
                    hit = data[at : at + size], size
                found.append(hit)
                at += hit[1]
            if len(data) <= LONGEST_KEPT:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[data] = found
        return found

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        hits = [hit for stretch in self.stretch.findall(data) for hit in self._prefixes(stretch)]
        at = first = 0
        if self.remove_extra:
            while first < len(hits) and hits[first][0] == b" ":
                at += hits[first][1]
                first += 1
        if first == len(hits):
            return "", np.array([at])
        out, places, counts = [], [], []

        def add(value: bytes) -> None:
            value = value.replace(b" ", self.space)
            out.append(value)
            places.append(at)
            counts.append(len(value))

        if self.dummy_prefix:
            add(b" ")
        after_space = self.remove_extra
        for value, length in hits[first:]:
            if after_space:
                value = value.lstrip(b" ")
            if value:
                add(value)
                after_space = self.remove_extra and value.endswith(b" ")
            at += length
        joined = b"".join(out)
        source = np.append(np.repeat(np.array(places, np.int64), counts), at)
        if self.remove_extra:
            kept = len(joined)
            while joined[:kept].endswith(self.space):
                kept -= len(self.space)
            joined, source = joined[:kept], source[: kept + 1]
        return joined.decode(), source


class Model:
    """A model file with its normaliser, and the segments that a worker has met."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import SentencePieceProcessor

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        fields = list(_fields(proto))
        spec = next((v for n, v in fields if n == NORMALIZER), b"")
        trainer = dict(_fields(next((v for n, v in fields if n == TRAINER), b"")))
        vocabulary = [dict(_fields(v)) for n, v in fields if n == PIECES]
        texts = [v.get(1, b"").decode() for v in vocabulary]
        kinds = [v.get(3, 1) for v in vocabulary]
        if USER_DEFINED in kinds or trainer.get(SPACE_AS_SUFFIX):
            raise ValueError("user-defined pieces and white space as a suffix are not supported")
        self.normalizer = Normalizer(spec)
        self.library = SentencePieceProcessor(model_proto=proto)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        plain = struct.pack("6B", DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0)
        rest = b"".join(_message(n, v) for n, v in fields if n in (PIECES, TRAINER))
        #: The same merges without any normalisation.
        self.merger = SentencePieceProcessor(model_proto=rest + _message(NORMALIZER, plain))
        self.sizes = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(texts, kinds)], dtype=np.int64)
        # Without byte pieces neighbouring unknown characters join, whatever lies between cuts.
        whole = not trainer.get(BYTE_FALLBACK) or any(SPACE in t.lstrip(SPACE) or "\n" in t for t in texts)
        self.segment = re.compile(r"(?s).+" if whole else rf"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def _segments(self, parts: list[list[str]]) -> list[list[bytes]]:
        """The ids of the segments of several texts, as little-endian unsigned 32-bit bytes."""
        look_up = self.known.get
        out = [list(map(look_up, p)) for p in parts]
        unseen = list({s for p, values in zip(parts, out) if None in values for s, v in zip(p, values) if v is None})
        if not unseen:
            return out
        found: dict[str, bytes] = {}
        for at in range(0, len(unseen), 4096):
            some = unseen[at : at + 4096]
            found.update((s, struct.pack(f"<{len(i)}I", *i)) for s, i in zip(some, self.merger.encode(some, num_threads=1)))
        out = [[found[s] if v is None else v for s, v in zip(p, values)] if None in values else values for p, values in zip(parts, out)]
        if len(self.known) + len(found) > KEPT:
            self.known.clear()
        self.known.update((s, v) for s, v in found.items() if len(s) <= LONGEST_KEPT)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text the ids with both marks, and where each piece begins and ends in its bytes."""
        normal = [self.normalizer(t) for t in texts]
        parts = self._segments([self.segment.findall(t) for t, _ in normal])
        for (text, source), values in zip(normal, parts):
            ids = np.frombuffer(b"".join(values), dtype="<u4")
            ends = np.cumsum(self.sizes[ids])
            if len(ids) and ends[-1] + 1 != len(source):
                ends = self._unknown(text, ids)
            at = source[np.concatenate([[0], ends])] if len(ids) else source[:1]
            last = source[-1:]
            yield (
                np.concatenate([np.array([self.begin], "<u4"), ids, np.array([self.end], "<u4")]),
                np.concatenate([[0], at[:-1], last]),
                np.concatenate([[0], at[1:], last]),
            )

    def _unknown(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Ends of pieces in a text with unknown ones, whose length the id does not tell."""
        found = self.merger.encode(text, return_type="proto").pieces
        assert [p.id for p in found] == ids.tolist()
        return np.array([p.end for p in found], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@functools.cache
def model(path: str) -> Model:
    """One per worker process, so that what it has seen serves later tasks too."""
    return Model(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(1).to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, begins, ends, decoded`` for every row of ``docs(doc_id, text)``.

    ``begins`` and ``ends`` are the source bytes of each piece, ends exclusive.
    """

    def run(part: pa.RecordBatch, known: Model) -> pa.RecordBatch:
        out = list(known.encode(_texts(part)))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([i.astype(np.int32) for i, _, _ in out], pa.list_(pa.int32())),
             pa.array([b for _, b, _ in out], longs), pa.array([e for _, _, e in out], longs),
             pa.array([known.decode(i) for i, _, _ in out], pa.string())],
            names=["doc_id", "ids", "begins", "ends", "decoded"],
        )

    schema = "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string"
    return map_texts(_rows(docs), run, schema, setup=lambda: model(path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32``: ``encode`` in short.

    ``spans_crc32`` is taken over begins, then ends, as little-endian 64-bit integers.
    """

    def run(part: pa.RecordBatch, known: Model) -> pa.RecordBatch:
        counts, ids_sha, decoded_sha, spans = [], [], [], []
        for ids, begins, ends in known.encode(_texts(part)):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(known.decode(ids).encode()).hexdigest())
            spans.append(zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes())))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
             pa.array(decoded_sha, pa.string()), pa.array(spans, pa.int64())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return map_texts(_rows(docs), run, schema, setup=lambda: model(path))
