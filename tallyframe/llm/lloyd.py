"""What both kinds of Lloyd iteration need: whole-number vectors, exact distances, sums by cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(v: Column) -> Column:
    """True for a vector without nulls, NaNs and infinities; null for a null one."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def packed(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def to_bytes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, the first of which is their width."""
    small = packed(values)
    return bytes([small.itemsize]) + small.astype(small.dtype.newbyteorder("<")).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows of x, rows of c) exact squared Euclidean distances of whole numbers, as int64.

    As a product of doubles where no figure in it reaches 2**53, else in int64;
    OverflowError where even that is too narrow.
    """
    most = max((int(np.abs(v).max()) if v.size else 0) for v in (x, c))
    bound = 4 * max(1, x.shape[1]) * most * most
    if bound < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError(f"components of {most} are too large for exact squared distances in 64 bits")
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - c[None, :, j]
        out += d * d
    return out


def sums_by(labels: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, width) exact sums of the rows of ``x`` with each label, and how many there are."""
    order = np.argsort(labels, kind="stable")
    n = np.bincount(labels, minlength=k)
    total, there = np.zeros((k, x.shape[1]), np.int64), n > 0
    if len(x):
        total[there] = np.add.reduceat(x[order], (np.cumsum(n) - n)[there], axis=0)
    return total, n
