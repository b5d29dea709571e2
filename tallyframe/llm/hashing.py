"""Hashes of words and of runs of words, for whole Arrow columns at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from tallyframe.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C13)
_STEPS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes that are hashed at once.
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 2**64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def table_of(separators: bytes, lower: bool) -> np.ndarray:
    """For each byte its letter, 0 for a byte that separates words; A-Z as a-z if ``lower``."""
    table = _letters().copy()
    if lower:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: White space alone separates: ``[^\x20\x09-\x0D]+`` is a word.
SPACED = (b" \t\n\x0b\x0c\r", True)
#: Anything in ASCII but letters and digits separates.
ALPHANUMERIC = (bytes(b for b in range(128) if not chr(b).isalnum()), True)


def words(column: pa.Array, kind: tuple[bytes, bool] = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and the bounds of each row's words.

    Row i has the words ``hashes[bounds[i]:bounds[i + 1]]``; a null has none.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi]
    offsets, table = offsets - lo, table_of(*kind)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = _break(data, offsets, table, min(at + CHUNK, len(data)))
        found, start = _hashed(table[data[at:end]], offsets - at)
        hashes.append(found)
        starts.append(start + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _break(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, at: int) -> int:
    """The first place from ``at`` on over which no word runs."""
    row_end = int(offsets[np.searchsorted(offsets, at)])
    while at < row_end:
        gap = np.flatnonzero(table[data[at : min(at + 4096, row_end)]] == 0)
        if len(gap):
            return at + int(gap[0])
        at = min(at + 4096, row_end)
    return at


def _hashed(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in a stretch of letters, 0 being none; rows begin at ``offsets``."""
    inside = np.empty(len(values) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(values, 0, out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(values))]  # where a row ends, a word ends
    both = edges[inside[1:-1][edges - 1] & inside[1:-1][edges]]
    first[both] = True
    last[both - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(1 << max(16, int(len(values)).bit_length()))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.multiply(values, up[: len(values)], out=values)
    np.cumsum(values, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEPS[63]), start


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; run i begins with word i, row bounds are not looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _STEPS[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _STEPS[j % 63]
    return mixed(out + np.uint64(k))


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct runs of ``k`` words; all words as one run where there are fewer."""
    every, out = runs(hashes, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(every[a : b - k + 1])
            out.append(own if len(own) < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
