"""Whole texts to token ids with the tokenizers library, each different word once.

Both vocabularies used here split a text into words before any merge, and no
word reaches over white space but for one leading blank.  A column of texts is
therefore cut into units (a word with its blank, or white space) where it lies
in memory, the units are dictionary-encoded by Arrow, each different unit goes
through the vocabulary's pattern and the library's merges once, and the ids of
a text are its units' ids in order.  Texts with special strings or white space
beyond ASCII go to the library whole, so the ids are always what the library
gives for the text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Units after which a worker's memo turns over.  It changes speed and memory only.
MEMO_WORDS = 100_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 2 << 20
ENCODE_ROWS = 1 << 16

#: White space in a unit that was cut at ASCII white space, or a control that one of the libraries may take for it.
_ODD = re.compile(r"[^\S \t\n\x0b\x0c\r]")
_BLANK = frozenset(b" \t\n\x0b\x0c\r")
_IS_BLANK = np.isin(np.arange(256), list(_BLANK))
#: ASCII but letters, digits and white space: at the end of a word it is a piece by itself.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

#: Fixed value: how a byte-level vocabulary without a pattern of its own cuts a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


LETTERS = "".join(byte_letters()[b] for b in range(256))


def as_letters(piece: bytes) -> str:
    return charmap_decode(piece, "strict", LETTERS)[0]


@lru_cache(maxsize=4)
def split_pattern(path: str) -> regex.Pattern:
    """The pattern whose matches are the words, as the vocabulary's file has it."""
    step = json.loads(library(path).to_str())["pre_tokenizer"]
    for part in step.get("pretokenizers", [step]):
        if part["type"] == "Split":
            return regex.compile(part["pattern"]["Regex"])
    return regex.compile(BYTE_LEVEL_PATTERN)


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


class Memo(dict):
    """What ``make`` gives for a key, made once; at a turnover, keys not used since the last one go."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def units(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of a text column, and the bounds of each row's units; a null has none.

    In a run of white space before a word the last character is by itself, or
    belongs to the word if it is a blank; what comes before it is one unit, and
    so is a run at the end of a text.  Nothing is copied but the places.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return pa.array([], pa.binary()), np.zeros(len(column) + 1, np.int64)
    data, offsets = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi], offsets - lo
    blank = _IS_BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    row_ends = np.zeros(len(data), bool)
    row_ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    before = np.empty(len(data), bool)  # the character before is white space of the same text
    before[0] = False
    before[1:] = blank[:-1] & ~row_ends[:-1]
    last = np.empty(len(data), bool)  # the last of a run before a word of the same text
    last[-1] = False
    last[:-1] = blank[:-1] & ~blank[1:] & ~row_ends[:-1]
    after = before & ~blank
    after[1:] &= data[:-1] != 32
    begins[:-1] |= (blank & ~before) | last | after
    begins[-1] = True
    cuts = np.flatnonzero(begins)
    # Rows without text begin where the next one does.
    bounds = np.searchsorted(cuts, offsets)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]), bounds


def values(column: pa.Array) -> list[bytes]:
    """The values of a binary column that begins at its buffers' beginning."""
    if not len(column):
        return []
    at, data = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1].tolist(), column.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(at, at[1:])]


def _odd(text: str, specials: tuple[str, ...]) -> bool:
    return any(s in text for s in specials) or (not text.isascii() or not text.isprintable()) and _ODD.search(text) is not None


def _word(text: str) -> bool:
    """Letters of the Latin alphabets, which every version of Unicode knows as such.

    Not the dotted capital I: its lower case is a letter and a mark, where vocabularies split.
    """
    return text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text)


class _Units:
    """What the subclass gives for each different unit of texts."""

    def __init__(self, path: str, memo_words: int):
        self.path, self.split, self.specials = path, split_pattern(path).findall, specials(path)
        self.merge, self.known = library(path).model.tokenize, Memo(self._unit, memo_words)
        # A special string with a letter in it is neither a word nor the marks after one.
        self.marks = _MARKS if all(any(c.isalnum() for c in s) for s in self.specials) else b""

    def _unit(self, unit: bytes):
        """None where the text must go to the library whole."""
        word = unit.rstrip(self.marks)
        if word and _word(word[word[0] == 32 :].decode()):
            return self._letters(word) if len(word) == len(unit) else self.known[word] + self.known[unit[len(word) :]]
        text = unit.decode()
        return None if _odd(text, self.specials) else self._pieces(text)

    def looked_up(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray, pa.Array]:
        """What is known of each different unit, the units' numbers, each text's bounds, the texts to be taken whole."""
        cut, bounds = units(column)
        coded = cut.dictionary_encode()
        found, index = list(map(self.known.__getitem__, values(coded.dictionary))), np.asarray(coded.indices)
        whole = np.array([], np.int64)
        if None in found:
            whole = np.unique(np.searchsorted(bounds, np.flatnonzero(np.array([x is None for x in found])[index]), side="right") - 1)
        self.known.turn()
        return found, index, bounds, whole


class ByteLevelEncoder(_Units):
    """Ids of texts for a byte-level vocabulary whose words take one leading space."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        super().__init__(path, memo_words)

    def _letters(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.merge(as_letters(word))]).tobytes()

    def _pieces(self, text: str) -> bytes:
        return array("I", [t.id for piece in self.split(text) for t in self.merge(as_letters(piece.encode()))]).tobytes()

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian unsigned 32-bit ids of all texts, and the bounds of each text's; ``end_id`` closes each."""
        found, index, bounds, whole = self.looked_up(column)
        ids = [x or b"" for x in found]
        size = np.array([len(x) >> 2 for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        every = np.asarray(lists.take(pa.array(index)).flatten())
        bounds = np.concatenate(([0], np.cumsum(size[index])))[bounds]
        if len(whole):  # put in by stretches
            parts, lengths, at = [], np.diff(bounds), 0
            for row in whole.tolist():
                own = np.asarray(library(self.path).encode(column[row].as_py(), add_special_tokens=False).ids, dtype="<u4")
                parts += [every[at : bounds[row]], own]
                lengths[row], at = len(own), bounds[row + 1]
            every, bounds = np.concatenate([*parts, every[at:]]), np.concatenate(([0], np.cumsum(lengths)))
        if end_id is not None:
            every, bounds = np.insert(every, bounds[1:], end_id), bounds + np.arange(len(bounds))
        return every.astype("<u4", copy=False), bounds


class WordCounter(_Units):
    """Token counts of texts for a vocabulary that drops white space between words."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        super().__init__(path, memo_words)
        self.normal = library(path).normalizer.normalize_str

    def _letters(self, word: bytes) -> int:
        text = word.decode().strip()
        return len(self.merge(as_letters((text.lower() if text.isascii() else self.normal(text)).encode())))

    def _pieces(self, text: str) -> int:
        text = text.strip()
        return sum([len(self.merge(as_letters(piece.encode()))) for piece in self.split(text.lower() if text.isascii() else self.normal(text))])

    def count(self, column: pa.Array) -> np.ndarray:
        found, index, bounds, whole = self.looked_up(column)
        n = np.array([x or 0 for x in found], np.int64)
        total = np.concatenate(([0], np.cumsum(n[index] if len(n) else n)))
        out = total[bounds[1:]] - total[bounds[:-1]]
        for row in whole.tolist():
            out[row] = len(library(self.path).encode(column[row].as_py(), add_special_tokens=False))
        return out


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@lru_cache(maxsize=4)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)
