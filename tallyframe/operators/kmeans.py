"""K-means whose starts share their scans.

The centres of all starts travel together: a pass over the different points, each
with the number of its rows, assigns them for every start that isn't done, and
returns the sums by start and cluster, which grow with the parameters and not with
the rows.  Starts that stand still drop out; the one with the least cost wins.

First centres are drawn as k-means++ draws them, for all starts in one pass a
centre: each row races with an exponential time by a hash of its number, at a rate
that is its squared distance to the start's nearest centre, and the first one is
drawn.  So the same rows give the same centres in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.boosting import hashed
from tallyframe.shared import kept, spread

#: Rows for which distances to the centres of a start are held at once; points of a partition at most where more tasks are to be had.
ROWS, SPREAD_POINTS = 1 << 15, 1 << 12


@dataclass(frozen=True)
class Centres:
    """A clustering: its centres, the sum of squared distances, and how many passes its start took."""

    centres: np.ndarray
    cost: float
    passes: int

    def nearest(self, features: list[str]) -> Column:
        """The number of the nearest centre, the first of several."""
        d = F.array(*[sum(((F.col(f) - F.lit(float(x))) * (F.col(f) - F.lit(float(x))) for f, x in zip(features, c, strict=True)), F.lit(0.0)) for c in self.centres])
        return F.array_position(d, F.array_min(d)).cast("int") - 1


def blocks_of(rows: DataFrame, features: list[str], number: str) -> RDD:
    """(row numbers, features) of the rows as arrays; ``number`` may be another column of whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.asarray(c, np.float64) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0)).tobytes()]), pa.array([np.ascontiguousarray(x.T).tobytes()])], names=["number", "x"])

    d = len(features)
    packed = rows.select(number, *[F.col(f).cast("double") for f in features]).mapInArrow(pack, "number binary, x binary")
    return packed.rdd.map(lambda r: (np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.float64).reshape(-1, d)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, rows) squared distances of (features, rows)."""
    return sum((v - c[:, None]) ** 2 for v, c in zip(x, centres.T, strict=True))


def _drawn(blocks: RDD, centres: list[np.ndarray] | None, starts: int, nth: int, seed: int) -> list[np.ndarray]:
    """The next centre of each start: the row that wins its race."""

    def race(part: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[float, int, np.ndarray] | None]]:
        best: list[tuple[float, int, np.ndarray] | None] = [None] * starts
        for number, x in part:
            wide = np.ascontiguousarray(x.T)
            for s in range(starts):
                rate = np.ones(len(x)) if centres is None else _distances(wide, centres[s]).min(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    time = -np.log1p(-hashed(number, seed + 7919 * s + nth)) / rate
                time[np.isnan(time)] = np.inf
                least = np.flatnonzero(time == time.min()) if len(x) else time
                at = int(least[number[least].argmin()]) if len(x) else -1
                if at >= 0 and (best[s] is None or (time[at], number[at]) < best[s][:2]):
                    best[s] = (float(time[at]), int(number[at]), x[at])
        yield best

    def first(a: list, b: list) -> list:
        return [x if y is None or x is not None and x[:2] <= y[:2] else y for x, y in zip(a, b, strict=True)]

    return [x[2] for x in blocks.mapPartitions(race).treeReduce(first)]


def first_centres(blocks: RDD, k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, features) centres to begin from."""
    chosen = [_drawn(blocks, None, starts, 0, seed)]
    while len(chosen) < k:
        chosen.append(_drawn(blocks, [np.array(c) for c in zip(*chosen, strict=True)], starts, len(chosen), seed))
    return np.array([list(c) for c in zip(*chosen, strict=True)])


def _sums(blocks: RDD, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, k, features) sums, (starts, k) counts and (starts) costs by the nearest centres, of points with their numbers of rows."""

    def add(part: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[np.ndarray]]:
        total = [np.zeros(centres.shape), np.zeros(centres.shape[:2]), np.zeros(len(centres))]
        for number, every in part:
            for at in range(0, len(every), ROWS):
                x, weight = np.ascontiguousarray(every[at : at + ROWS].T), number[at : at + ROWS].astype(np.float64)
                for s, c in enumerate(centres):
                    d = _distances(x, c)
                    label = d.argmin(axis=0)
                    total[0][s] += np.array([np.bincount(label, weight * v, minlength=len(c)) for v in x]).T
                    total[1][s] += np.bincount(label, weight, minlength=len(c))
                    total[2][s] += d.min(axis=0) @ weight
        yield total

    return tuple(blocks.mapPartitions(add).treeReduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)]))


def kmeans(rows: DataFrame, features: list[str], number: str, k: int, starts: int, seed: int, passes: int = 300, tolerance: float = 1e-4) -> Centres:
    """The best of ``starts`` clusterings of rows that are numbered by ``number``.

    A start is done when its centres move by no more than ``tolerance`` times the mean
    variance of the features, as squares summed; an empty cluster keeps its centre.
    """
    variance = rows.agg(sum((F.var_pop(f) for f in features), F.lit(0.0)) / len(features)).first()[0] or 0.0
    drawn = blocks_of(spread(rows, rows.count()), features, number).persist(StorageLevel.MEMORY_AND_DISK)
    centres = first_centres(drawn, k, starts, seed)
    drawn.unpersist()
    points = kept(rows.groupBy(*features).agg(F.count(F.lit(1)).alias("_weight")), "points")
    blocks = blocks_of(spread(points, points.count(), SPREAD_POINTS), features, "_weight").persist(StorageLevel.MEMORY_AND_DISK)
    active, taken = list(range(starts)), [0] * starts
    for _ in range(passes):
        sums, counts, _ = _sums(blocks, centres[active])
        new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres[active])
        moved = ((new - centres[active]) ** 2).sum(axis=(1, 2))
        centres[active] = new
        for s in active:
            taken[s] += 1
        active = [s for s, m in zip(active, moved, strict=True) if m > tolerance * variance]
        if not active:
            break
    costs = _sums(blocks, centres)[2]
    blocks.unpersist()
    best = int(costs.argmin())
    return Centres(centres[best], float(costs[best]), taken[best])
