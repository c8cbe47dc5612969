"""Token ids of whole texts by the tokenizers library, fast for repeated words.

The bytes of a batch of texts are cut, in whole columns, as the vocabulary
file's own splitter cuts ASCII and Latin letters; each distinct word of the
batch is looked up once, and given to the library's model if the worker has not
met it. Where text has other characters, an apostrophe or the mark of a special
token, the part between two ASCII white spaces, which the splitter never
crosses, is one such word. It is cut by a regular expression if its characters
are Latin, else it takes the library's whole pipeline, also once each. So do
whole texts, if the file's splitter is another one.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import release, sole_cache

# the splitter this module knows, as the vocabulary file states it
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for lower-case plain text in Python's syntax
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
# for the whole pipeline: characters beyond Latin letters, which may combine, and those that Python alone takes for white space
ODD = re.compile("[\x00\x1c-\x1fİ\u0250-\U0010ffff]")
SPECIAL = "<|"
MOST = 250_000  # cached words; the cache is emptied beyond
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
NOT_LETTERS = [0xD7, 0xF7, 0x130]  # times, divided by, and a letter that two libraries lower in two ways


def byte_kinds() -> bytes:
    """The kind of each byte; those of OTHER are not plain."""
    kinds = np.full(256, SIGN, np.uint8)
    kinds[list(b"\t\n\v\f\r ")] = SPACE
    kinds[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    kinds[list(b"0123456789")] = DIGIT
    kinds[[0, *range(0x1C, 0x20), *range(0x80, 0x100), ord("'")]] = OTHER
    return kinds.tobytes()


KINDS = byte_kinds()


def byte_letters() -> dict[int, str]:
    """A printable character per byte: Latin-1's own printable ones, and for
    the others those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


def cut_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and how many there are in
    each text. A to Z are lowered, but not in words that hold other kinds."""
    raw = [t.encode() for t in texts]
    joined = b"\n".join([*raw, b""])  # so every word ends before white space
    data, plain = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)  # of bytes: A to Z alone
    kinds = np.frombuffer(bytearray(joined.translate(KINDS)), np.uint8)
    if not joined.isascii():
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))  # U+00C0 to U+023F in two bytes
        point = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        letter = lead[~np.isin(point, NOT_LETTERS)]
        kinds[letter] = kinds[letter + 1] = LETTER
    other = np.flatnonzero(kinds == OTHER)
    marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    if len(other) or len(marks):
        spaces = np.flatnonzero(kinds == SPACE)
        part = np.unique(np.searchsorted(spaces, np.concatenate([other, marks])))
        edge = np.zeros(len(data) + 1, np.int8)
        edge[np.concatenate(([0], spaces + 1))[part]] = 1
        edge[spaces[part]] = -1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        kinds[inside] = OTHER
        plain = np.where(inside, data, plain)
    solid = kinds != SPACE
    new = kinds == DIGIT  # each digit is a word
    new[1:] |= kinds[1:] != kinds[:-1]
    new[:1] = True
    new &= solid
    # the white space left out, a word ends where the next one starts
    start = np.append(np.flatnonzero(new[solid]), np.count_nonzero(solid))
    words = pa.Array.from_buffers(pa.large_utf8(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(plain[solid])])
    after = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    return words, np.diff(np.searchsorted(np.flatnonzero(new), after), prepend=0)


class Slots(dict):
    """Word to its number; words are numbered, and listed, when first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        slot = self[key] = len(self)
        return slot


class TokenIds:
    """Ids of texts; one instance per worker process and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer  # alone: the whole file as Python objects is large
        split = json.loads(split.__getstate__()) if split else {}
        steps = split.get("pretokenizers", [{}])
        self.known = steps[0].get("pattern") == {"Regex": SPLITTER}
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids_of(self, key: str) -> list[int]:
        if self.known and key.isascii() and key.isalpha():
            return [t.id for t in self.model.tokenize(key)]
        if not self.known or ODD.search(key) or SPECIAL in key:
            return self.whole(key)
        words = ["".join(map(self.letters.__getitem__, w.encode())) for w in WORDS.findall(key.lower())]
        return [t.id for w in words for t in self.model.tokenize(w)]

    def learn(self) -> None:
        """The ids of the words numbered since the last call."""
        flat: list[int] = []
        ends = []
        for key in self.slots.new:
            flat += self.ids_of(key)
            ends.append(len(flat))
        length = np.diff(np.array(ends, np.int64), prepend=0)
        start = len(self.flat) + np.array(ends, np.int64) - length
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.start = np.concatenate([self.start, start])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.slots.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of ids for each text."""
        if len(self.slots) > MOST:
            self.clear()
        words, counts = cut_words(texts) if self.known else (pa.array(texts, pa.large_utf8()), np.ones(len(texts), np.int64))
        distinct = words.dictionary_encode()
        keys = distinct.dictionary.to_numpy(zero_copy_only=False)
        own = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        self.learn()
        slots = own[distinct.indices.to_numpy()]
        length = self.length[slots].astype(np.int64)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[slots] - (ends - length), length) + np.arange(total)]
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    sole_cache("tokens", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
        release()  # what reading the file took
    return _LOADED[path]
