"""Encoding by a tokenizer file, one distinct segment of text at a time.

A text is cut at spaces and line ends into segments that the tokenizer provably encodes one by
one, so that each distinct segment is encoded once per task and then looked up.

- *Word tokenizers* (white space dropped before the merges): every space or line end separates
  tokens, so segments are what lies between them. Where the file lower-cases and cuts words as
  ``_WORDS`` says, and the text holds only characters that this is certain for, segments are its
  lower-cased words: there are far fewer of them, and many are encoded in one go.
- *Byte tokenizers* (white space belongs to the following word): a token boundary lies before a
  run of spaces and line ends that follows any other character, provided the text holds no
  further kind of white space, and what follows the boundary does not depend on what lies
  before it. Texts with other white space are one segment.

Special strings of the tokenizers hold neither spaces nor line ends, so they lie inside one
segment and get the library's default treatment.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np

#: Distinct segments that a worker process keeps; beyond that those in use move to a new
#: generation, and the one before is forgotten.
KEPT = 900_000
#: Longer ones are encoded anew each time, so that what is kept is bounded in bytes.
LONGEST_KEPT = 64

#: Distinct lower-cased words that a worker keeps, twice: some 60 MB each.
KEPT_WORDS = 250_000
#: Words that are encoded in one go.
JOINED = 512

# How the files of word tokenizers that are cut finely normalise and cut texts.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Lower-case letters of Latin alphabets, which no normalisation changes or joins.
_LETTERS = "a-zß-öø-ſ"
#: Any other character than these letters, their capitals, ASCII, spaces and line ends, or what
#: may be a special string.
_UNSURE = re.compile(r"[^\n -~À-ÖØ-öø-įı-ňŊ-ſ]|<\|")
#: As ``_WORDS``, letters first: an apostrophe is none, so that the order does not matter to them.
_LOWER_WORD = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{_LETTERS}0-9]+")

_BYTE_SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Known:
    """Values of segments, encoded on first sight; ``parse`` makes a value of an encoding."""

    kept = KEPT

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict = {}
        self.older: dict = {}

    def parse(self, encoding):
        raise NotImplementedError

    def encoded(self, new: list[str]) -> Iterator:
        """The values of segments that were not seen before."""
        for at in range(0, len(new), 4096):
            yield from map(self.parse, self.tokenizer.encode_batch_fast(new[at : at + 4096], add_special_tokens=False))

    def values(self, parts: list[list[str]]) -> list[list]:
        """The values of the segments of several texts: distinct unseen ones first, then one
        look-up each."""
        flat = list(chain.from_iterable(parts))
        unseen = set(flat).difference(self.known)
        if len(self.known) + len(unseen) > self.kept:
            self.older, self.known = self.known, {}
            unseen = set(flat)
        # Not set.intersection, which goes through all of the older ones.
        again = {s for s in unseen if s in self.older}
        self.known.update((s, self.older[s]) for s in again)
        new = list(unseen - again)
        self.known.update(zip(new, self.encoded(new)))
        found = list(map(self.known.__getitem__, flat))
        for s in [s for s in new if len(s) > LONGEST_KEPT]:
            del self.known[s]
        ends = list(accumulate(map(len, parts), initial=0))
        return [found[a:b] for a, b in zip(ends, ends[1:])]


class _Words(_Known):
    """Token ids of lower-cased words, each of which ends with a token that is marked as an end."""

    kept = KEPT_WORDS

    def __init__(self, tokenizer, suffix: str):
        self.tokenizer = tokenizer
        self.known, self.older = {}, {}
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encoded(self, new: list[str]) -> Iterator[bytes]:
        for at in range(0, len(new), JOINED):
            some = new[at : at + JOINED]
            joined = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer does not end each word with a token of its own")
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *cuts], cuts))


class WordIds(_Known):
    """Token ids of texts under a word tokenizer, as little-endian unsigned 32-bit bytes."""

    kept = KEPT_WORDS

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        cut = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = said["model"].get("end_of_word_suffix")
        same = (said.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        special = all(t["content"].startswith("<|") for t in said.get("added_tokens", []))
        fine = same and special and suffix and cut[0].get("pattern") == {"Regex": _WORDS}
        self.words = _Words(self.tokenizer, suffix) if fine else None

    def parse(self, encoding) -> bytes:
        ids = encoding.ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        new, rough = [], []
        for at, text in enumerate(texts):
            if self.words is None or _UNSURE.search(text):
                rough.append(at)
                continue
            words = _LOWER_WORD.findall(text.lower())
            found = list(map(self.words.known.get, words))
            if None in found:
                places = [i for i, ids in enumerate(found) if ids is None]
                new.append((at, found, places, [words[i] for i in places]))
            else:
                out[at] = b"".join(found)
        # Most words were seen before: only the others take the way through the tokenizer.
        if new:
            for (at, found, places, _), ids in zip(new, self.words.values([words for *_, words in new])):
                for i, some in zip(places, ids):
                    found[i] = some
                out[at] = b"".join(found)
        if rough:
            parts = [texts[at].replace("\n", " ").split(" ") for at in rough]
            for at, ids in zip(rough, self.values(parts)):
                out[at] = b"".join(ids)
        return out


class ByteCounts(_Known):
    """Segments of texts under a byte tokenizer and the number of tokens of each."""

    def parse(self, encoding) -> int:
        return len(encoding)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return [text] if _OTHER_SPACE.search(text) else _BYTE_SEGMENT.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        return [sum(values) for values in self.values([self.split(t) for t in texts])]

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries at which the encoding starts anew, and the tokens before each.

        Boundaries are code points from the start of ``text``; its start and end are among them.
        For texts with other white space they come from the library's own offsets: the ends of
        the words that it splits before merging.
        """
        if _OTHER_SPACE.search(text):
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ends = np.array([b for _, b in e.offsets], dtype=np.int64)
            words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
            starts = np.array([a for a, _ in e.offsets], dtype=np.int64)
            new = np.ones(len(ends), dtype=bool)
            # A new word, or a special token (which has no word or starts the count again).
            new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
            at = np.flatnonzero(new)
            return np.append(starts[at], len(text)), np.append(at, len(ends))
        parts = self.split(text)
        positions = np.cumsum([0, *map(len, parts)])
        return positions, np.cumsum([0, *self.values([parts])[0]])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker process, so that what it has seen serves later tasks too."""
    return WordIds(path)


@functools.cache
def byte_counts(path: str) -> ByteCounts:
    return ByteCounts(path)
