"""Boosted trees of second order, grown for all fits of an evaluation at once.

A fit is a model of some of the rows: those of all folds but one, of an inner
split of these, or of all.  Fits share everything but their rows, so they grow
side by side over the same scans:

- Features are cut into bins once, at quantiles of all rows (a category is a bin
  of its own), and packed as blocks of rows, feature by feature.  What a missing
  value counts as, the median or the most frequent category, is each fit's own.
- For each level of a tree one aggregation sums gradients and second
  derivatives by (fit, output) and, within, by node, feature and bin.  The
  reducer of a (fit, output) finds the best split of each node, so the driver
  sees splits only: fits * outputs * nodes rows, whatever the table.
- Leaves are -rate * G / (H + 1).  Rows and columns of a tree are drawn by hash
  and seed, the same in every fit.
- Several classes are one model: a tree for each class a round, from the softmax
  gradients of one vector of margins.

Rows with the same bins get the same margins, so trees are grown over cells, the
different rows of bins, with sums of what a tree draws (``grown_over``):

- Of a table of at most ``PARTITION_ROWS`` rows each fit is one task, which draws from its rows.
- Where a larger table has few cells (``CELLS``), all rows are drawn where they lie,
  for a batch of trees a job, and only the sums by cell go to the fits' tasks.
- Where it has many, but the grid of all combinations of bins is not larger than ``GRID``
  and the target is a class, rows are dealt by their place in the grid; for a batch of trees
  a job they send the fits how many rows of a place aren't drawn.  A fit's task grows its
  trees over the grid, whose nodes are boxes, and the margins stay where the fit is.
- Otherwise a level is a job, and the margins are a state beside the blocks: one
  persisted RDD a tree, with a checkpoint in the shared folder every ``CHECKPOINT``
  trees, so that a lost executor costs a bounded part.

The rows are written before the first tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.policies import Boosting
from tallyframe.shared import removed, shared_dir

#: Bins of a numeric feature at most, trees between checkpoints.
BINS, CHECKPOINT = 256, 16
#: Rows of a table whose fits are a task each, and its bins at most.
PARTITION_ROWS, PARTITION_BINS = 1 << 20, 1 << 24
#: Cells at most, margins of all fits at most, rows that a table has at least and rows a cell on average, if only sums by cell go to the fits (a grid needs as many rows).
CELLS, CELL_MARGINS, CELL_TABLE, CELL_ROWS = 1 << 16, 1 << 22, 1 << 12, 4
#: Bytes of drawn sums that a task holds, rows it draws at once, rows of a partition at most where more tasks are to be had.
DRAWN_BYTES, DRAWN_ROWS, SPREAD_ROWS = 1 << 26, 1 << 16, 1 << 18
#: Places of a grid at most, numbers by place of a fit at most, bytes of what a fit isn't sent of a batch of trees before they
#: are compressed, batches between checkpoints, places whose gradients are made at once, places a cell at most in a fit's task.
GRID, GRID_NUMBERS, GRID_BYTES, GRID_BATCHES, GRID_PIECE, GRID_CELL = 1 << 21, 1 << 24, 1 << 28, 8, 1 << 14, 8
#: Added to sums of second derivatives, least such sum of a child, least gain.
SMOOTH, LEAST_CHILD, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Gains are equal that differ by less than this share of what they are made of.
SAME_GAIN = 1e-12
#: What a missing value is stored as.
MISSING = 0xFFFF


@dataclass
class Block:
    """Some rows: ``bins`` by feature, target, fold, inner fold by outer fold, the rows' numbers and keys."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    inner: np.ndarray
    row: np.ndarray
    key: np.ndarray


State = tuple[Block, np.ndarray]


@dataclass(frozen=True)
class Fit:
    """The rows of a model: all, or those outside fold ``outer``, or of these those outside its inner fold ``inner``."""

    outer: int | None = None
    inner: int | None = None

    def trains(self, block: Block) -> np.ndarray:
        if self.outer is None:
            return np.ones(len(block.y), bool)
        rows = block.fold != self.outer
        return rows if self.inner is None else rows & (block.inner[self.outer] != self.inner)

    def holds_out(self, block: Block) -> np.ndarray:
        """The rows that this fit is to answer for, which it didn't learn from."""
        if self.inner is None:
            return ~self.trains(block)
        return (block.fold != self.outer) & (block.inner[self.outer] == self.inner)


@dataclass
class Binning:
    """Edges of numeric features and the values of the others."""

    numeric: list[str]
    edges: list[np.ndarray]
    categorical: list[str]
    values: list[list[str]]

    @property
    def offsets(self) -> np.ndarray:
        """Where each feature's bins begin when those of all stand in one line."""
        return np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges] + [len(v) for v in self.values]))).astype(np.int64)

    def columns(self) -> list[Column]:
        numbers = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(self.numeric)]
        return numbers + [F.col(f"`{c}`").cast("string").alias(f"_x{len(numbers) + i}") for i, c in enumerate(self.categorical)]

    def bins(self, columns: list, n: int) -> np.ndarray:
        """(features, rows) bin numbers of ``columns``; a category that isn't known is beyond the bins and equals none."""
        out = np.empty((len(columns), n), np.uint16)
        for i, (edges, x) in enumerate(zip(self.edges, columns, strict=False)):
            x = np.asarray(x, np.float64)
            out[i] = np.where(np.isnan(x), MISSING, np.searchsorted(edges, x, side="left"))
        for i, (values, x) in enumerate(zip(self.values, columns[len(self.edges) :], strict=True), len(self.edges)):
            number = {v: j for j, v in enumerate(values)}
            out[i] = [MISSING if v is None else number.get(v, len(values)) for v in x]
        return out


def fit_binning(df: DataFrame, features: list[str], bins: int = BINS) -> Binning:
    """Edges at quantiles of all rows, and all categories: what comes to the driver grows with columns, bins and categories.

    A feature without any value is left out.
    """
    numeric = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
    categorical = [c for c in features if c not in numeric]
    at = [i / bins for i in range(1, bins)]
    # The largest value is no edge, as nothing lies beyond it.
    cuts = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 20_000) for c in numeric], F.lit(0)).first()
    most = df.agg(*[F.max(F.col(f"`{c}`").cast("double")) for c in numeric], F.lit(0)).first()
    values = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))) for c in categorical], F.lit(0)).first()
    edges = {c: np.unique([x for x in cuts[i] if x < most[i]]) for i, c in enumerate(numeric) if cuts[i]}
    known = {c: list(values[i]) for i, c in enumerate(categorical) if values[i]}
    too_many = [c for c, v in known.items() if len(v) >= MISSING]
    if too_many:
        raise ValueError(f"too many categories to learn from: {too_many}")
    return Binning(list(edges), list(edges.values()), list(known), list(known.values()))


@dataclass
class Trees:
    """One tree for each (fit, output), as full binary trees: node ``i`` has the children 2 i + 1 and 2 i + 2.

    ``feature`` is -1 where a node is a leaf or beyond one.
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int) -> Trees:
        size = 2 ** (depth + 1) - 1
        return cls(np.full((n, size), -1, np.int32), np.zeros((n, size), np.int32), np.zeros((n, size)))

    def nodes(self, t: int, bins: np.ndarray, n_numeric: int, depth: int) -> np.ndarray:
        """The node of tree ``t`` in which each row lies after ``depth`` levels."""
        at = np.zeros(bins.shape[1], np.int64)
        for _ in range(depth):
            inside = np.flatnonzero(self.feature[t, at] >= 0)
            if not len(inside):
                break
            here = at[inside]
            f, cut = self.feature[t, here], self.bin[t, here]
            b = bins[f, inside]
            at[inside] = 2 * here + 1 + np.where(f < n_numeric, b > cut, b == cut)
        return at


@dataclass
class Layout:
    """What tasks need to know of the fits: nothing in it grows with the rows."""

    kind: str
    outputs: int
    fits: list[Fit]
    n_numeric: int
    offsets: np.ndarray
    fill: np.ndarray
    weights: np.ndarray
    base: np.ndarray
    depth: int

    def filled(self, fit: int, bins: np.ndarray) -> np.ndarray:
        """The bins with a fit's own values for those that are missing."""
        return np.where(bins == MISSING, self.fill[fit][:, None], bins)

    def added(self, tree: Trees, fit: int, own: np.ndarray) -> np.ndarray:
        """(outputs, rows): what a round's trees add to a fit's margins."""
        first = fit * self.outputs
        return np.array([tree.value[t, tree.nodes(t, own, self.n_numeric, self.depth)] for t in range(first, first + self.outputs)])

    def answers(self, margins: np.ndarray) -> np.ndarray:
        """(outputs, rows): numbers, the chance of class 1, or the chances of all classes."""
        return {"regression": lambda m: m, "binary": chance, "multiclass": softmax}[self.kind](margins)


def chance(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margins))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


def _squared_error(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return margins - y, np.ones_like(margins)


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = chance(margins)
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _cross_entropy(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(margins)
    return p - (np.arange(len(p))[:, None] == y), np.maximum(2 * p * (1 - p), 1e-16)


#: Gradients and second derivatives, (outputs, rows) each, from margins of that shape and the target.
LOSSES = {"regression": _squared_error, "binary": _logistic, "multiclass": _cross_entropy}


def best_splits(sums: np.ndarray, offsets: np.ndarray, n_numeric: int, allowed: np.ndarray) -> list[tuple[int, int, float, float, float, float, float]]:
    """(feature, bin, gain, left G, left H, G, H) for each node of (2, nodes, bins + 1) sums, the last bin being the node's total.

    A numeric feature sends bins up to the cut to the left; a categorical one sends
    one category to the right.  The first of equal gains is taken, which are those
    that differ by less than sums in another order do.
    """
    g, h = sums[..., :-1]
    total_g, total_h = sums[..., -1:]
    left_g, left_h = np.empty_like(g), np.empty_like(h)
    for f, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        for left, of, total in ((left_g, g, total_g), (left_h, h, total_h)):
            left[:, a:b] = of[:, a:b].cumsum(axis=1) if f < n_numeric else total - of[:, a:b]
    right_g, right_h = total_g - left_g, total_h - left_h
    before = total_g**2 / (total_h + SMOOTH)
    gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - before
    gain[(left_h < LEAST_CHILD) | (right_h < LEAST_CHILD) | ~allowed] = -np.inf
    out = []
    for node in range(len(g)):
        most = gain[node].max()
        at = int((gain[node] >= most - SAME_GAIN * (abs(most) + before[node, 0])).argmax()) if np.isfinite(most) else 0
        f = int(np.searchsorted(offsets, at, side="right")) - 1
        out.append((f, int(at - offsets[f]), *(float(x) for x in (gain[node, at], left_g[node, at], left_h[node, at], total_g[node, 0], total_h[node, 0]))))
    return out


def hashed(row: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row number and seed."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def drawn(row: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """The rows that a tree is grown from, by a hash of their number."""
    return hashed(row, tree * 1_000_003 + seed) < share


def column_sample(offsets: np.ndarray, n_numeric: int, tree: int, policy: Boosting) -> np.ndarray:
    """Which bins a tree may split at: a share of the features, each category counting as one."""
    sizes = np.concatenate([np.diff(offsets[: n_numeric + 1]), np.ones(offsets[-1] - offsets[n_numeric], np.int64)])
    chosen = np.zeros(len(sizes), bool)
    chosen[np.random.default_rng([policy.seed, tree]).permutation(len(sizes))[: max(1, int(len(sizes) * policy.columns))]] = True
    return np.repeat(chosen, sizes)


def packed_blocks(df: DataFrame, binning: Binning, folds: list[str]) -> RDD:
    """Blocks of the rows of ``df``: ``_y`` is the target, ``_row`` and ``_key`` name a row, ``folds`` has the outer fold and then the inner ones."""
    n_folds, columns = len(folds), binning.columns()
    n_features = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(f"_x{i}") for i in range(n_features)]
            values = [x.to_numpy(zero_copy_only=False) if i < len(binning.numeric) else x.to_pylist() for i, x in enumerate(values)]
            own = np.array([np.asarray(batch.column(f"_f{i}")) for i in range(n_folds)], np.int8)
            parts = (binning.bins(values, batch.num_rows), np.asarray(batch.column("_y")), own, np.asarray(batch.column("_row")), np.asarray(batch.column("_key")))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["bins", "y", "folds", "row", "key"])

    def opened(r) -> Block:
        y = np.frombuffer(r[1], np.float64)
        own = np.frombuffer(r[2], np.int8).reshape(n_folds, len(y))
        return Block(np.frombuffer(r[0], np.uint16).reshape(n_features, len(y)), y, own[0] if n_folds else np.full(len(y), -1, np.int8), own[1:], np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.int64))

    rows = df.select(F.col("_y").cast("double"), "_row", "_key", *[F.col(c).cast("int").alias(f"_f{i}") for i, c in enumerate(folds)], *columns)
    return rows.mapInArrow(pack, "bins binary, y binary, folds binary, row binary, key binary").rdd.map(opened)


def training_counts(blocks: RDD, fits: list[Fit], offsets: np.ndarray) -> np.ndarray:
    """(fits, bins): how many training rows each bin has; medians and modes are read from it."""

    def count(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((len(fits), offsets[-1]), np.int64)
        for b in part:
            for i, fit in enumerate(fits):
                own = b.bins[:, fit.trains(b)]
                for x, a, z in zip(own, offsets, offsets[1:], strict=False):
                    total[i, a:z] += np.bincount(x[x != MISSING], minlength=z - a)
        yield total

    return blocks.mapPartitions(count).treeReduce(np.add)


def fills(counts: np.ndarray, n_numeric: int, offsets: np.ndarray) -> np.ndarray:
    """(fits, features): the median's bin, or the most frequent category (the first of several)."""
    out = np.zeros((len(counts), len(offsets) - 1), np.uint16)
    for i, every in enumerate(counts):
        for f, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
            n = every[a:b]
            out[i, f] = np.searchsorted(n.cumsum(), (n.sum() + 1) // 2) if f < n_numeric else n.argmax()
    return out


def weights_and_base(blocks: RDD, fits: list[Fit], kind: str, classes: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """(fits, classes) balanced weights of the classes, and (fits, outputs) margins to begin from.

    Numbers begin from their mean; classes, as they are balanced, from even chances.
    """

    def sums(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((len(fits), max(2, classes)))
        for b in part:
            for i, fit in enumerate(fits):
                y = b.y[fit.trains(b)]
                total[i] += (y.sum(), len(y)) if kind == "regression" else np.bincount(y.astype(np.int64), minlength=total.shape[1])
        yield total

    total = blocks.mapPartitions(sums).treeReduce(np.add)
    if kind == "regression":
        return np.ones((len(fits), 1)), (total[:, 0] / np.maximum(total[:, 1], 1))[:, None]
    present = (total > 0).sum(axis=1, keepdims=True)
    return total.sum(axis=1, keepdims=True) / (present * np.maximum(total, 1)), np.zeros((len(fits), outputs))


def _samples(part: Iterator[State], layout: Layout, number: int, policy: Boosting) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """What a tree is grown from, for each block and fit: (fit, bins, [gradients, second derivatives])."""
    for b, margins in part:
        sample = drawn(b.row, number, policy.seed, policy.subsample)
        for i, fit in enumerate(layout.fits):
            rows = np.flatnonzero(sample & fit.trains(b))
            y = b.y[rows]
            weight = 1.0 if layout.kind == "regression" else layout.weights[i][y.astype(np.int64)]
            yield i, layout.filled(i, b.bins[:, rows]), [x * weight for x in LOSSES[layout.kind](margins[i][:, rows], y)]


def _summed(samples: Iterable[tuple[int, np.ndarray, list[np.ndarray]]], layout: Layout, tree: Trees, level: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of gradients and second derivatives for each (fit, output): (2, nodes of the level, bins + 1)."""
    offsets, n_nodes, first = layout.offsets, 2**level, 2**level - 1
    total = np.zeros((len(layout.fits) * layout.outputs, 2, n_nodes, offsets[-1] + 1))
    for i, own, both in samples:
        for o in range(layout.outputs):
            t = i * layout.outputs + o
            node = tree.nodes(t, own, layout.n_numeric, level) - first
            here = np.flatnonzero(node >= 0)  # others lie in leaves of upper levels
            node, bins = (node, own) if len(here) == len(node) else (node[here], own[:, here])
            weights = [x[o] if len(here) == len(x[o]) else x[o, here] for x in both]
            for s, w in enumerate(weights):
                total[t, s, :, -1] += np.bincount(node, w, minlength=n_nodes)
            for f, (a, z) in enumerate(zip(offsets, offsets[1:], strict=False)):
                cell = node * (z - a) + bins[f]
                for s, w in enumerate(weights):
                    total[t, s, :, a:z] += np.bincount(cell, w, minlength=n_nodes * (z - a)).reshape(n_nodes, z - a)
    yield from enumerate(total)


def _advanced(state: State, layout: Layout, tree: Trees) -> State:
    block, margins = state
    return block, np.array([m + layout.added(tree, i, layout.filled(i, block.bins)) for i, m in enumerate(margins)])


def _split(tree: Trees, level: int, found: list[tuple[int, list]], rate: float) -> bool:
    """Put the best splits of a level into the trees, and their children's values; False if there is none."""
    first, some = 2**level - 1, False
    for t, splits in found:
        for at, (f, cut, gain, left_g, left_h, g, h) in enumerate(splits, first):
            if level and tree.feature[t, (at - 1) // 2] < 0:
                continue  # beyond a leaf
            if gain > LEAST_GAIN:
                some, tree.feature[t, at], tree.bin[t, at] = True, f, cut
                tree.value[t, 2 * at + 1] = -rate * left_g / (left_h + SMOOTH)
                tree.value[t, 2 * at + 2] = -rate * (g - left_g) / (h - left_h + SMOOTH)
            elif not level:
                tree.value[t, at] = -rate * g / (h + SMOOTH)
    return some


@dataclass
class Grown:
    """All fits' trees, and the margins of all rows by every fit."""

    binning: Binning
    layout: Layout
    trees: list[Trees]
    state: RDD

    def held_out(self, spark, fits: list[int]) -> DataFrame:
        """(_key, y, fit, answers): every row's answers by those of the fits that hold it out."""
        layout = self.layout

        def answered(state: State) -> Iterator[tuple]:
            b, margins = state
            for i in fits:
                rows = layout.fits[i].holds_out(b)
                parts = (b.key[rows], b.y[rows], layout.answers(margins[i][:, rows]).T)
                yield i, *[bytearray(np.ascontiguousarray(x).tobytes()) for x in parts]

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fit, key, y, answers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    key = np.frombuffer(key, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * layout.outputs, pa.int32()), pa.array(np.frombuffer(answers, np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.frombuffer(y, np.float64)), pa.array(np.full(len(key), fit, np.int32)), lists], names=["_key", "y", "fit", "answers"])

        blocks = spark.createDataFrame(self.state.flatMap(answered), "fit int, key binary, y binary, answers binary", verifySchema=False)
        return blocks.mapInArrow(opened, "_key long, y double, fit int, answers array<double>")

    def model(self, fit: int) -> Model:
        own, at = self.layout, slice(fit * self.layout.outputs, (fit + 1) * self.layout.outputs)
        one = replace(own, fits=[own.fits[fit]], fill=own.fill[fit : fit + 1], weights=own.weights[fit : fit + 1], base=own.base[fit : fit + 1])
        return Model(self.binning, one, [Trees(t.feature[at], t.bin[at], t.value[at]) for t in self.trees])


@dataclass
class Model:
    """One fit's trees by themselves."""

    binning: Binning
    layout: Layout
    trees: list[Trees]

    def answers(self, columns: list, n: int) -> np.ndarray:
        """(outputs, rows) from the values of the features."""
        own = self.layout.filled(0, self.binning.bins(columns, n))
        margins = np.repeat(self.layout.base[0][:, None], n, axis=1)
        for tree in self.trees:
            margins += self.layout.added(tree, 0, own)
        return self.layout.answers(margins)

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``answers``, whatever its other columns."""
        model, columns = self, self.binning.columns()
        if not columns:
            return df.withColumn("answers", F.array(*[F.lit(float(x)) for x in self.layout.answers(self.layout.base[0][:, None])[:, 0]]))

        def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in batches:
                yield pd.Series(list(model.answers(list(parts), len(parts[0])).T))

        return df.withColumn("answers", F.pandas_udf(answer, "array<double>")(*columns))


def grow(df: DataFrame, features: list[str], kind: str, policy: Boosting, fits: list[Fit], classes: int = 0, folds: list[str] | None = None) -> Grown:
    """All fits' models of ``_y`` from a table that is written already (its rows' numbers must not change)."""
    spark = df.sparkSession
    shared_dir(spark)
    binning, outputs = fit_binning(df, features), classes if kind == "multiclass" else 1
    offsets, n_numeric, n_rows = binning.offsets, len(binning.numeric), df.count()
    blocks = packed_blocks(df, binning, folds or [])
    spread = min(spark.sparkContext.defaultParallelism, -(-n_rows // SPREAD_ROWS))
    if blocks.getNumPartitions() < spread:
        blocks = packed_blocks(df.repartition(spread), binning, folds or [])
    n_parts = max(1, spread, min(blocks.getNumPartitions(), -(-n_rows // PARTITION_ROWS)))
    blocks = blocks.coalesce(n_parts).persist(StorageLevel.MEMORY_AND_DISK)
    weights, base = weights_and_base(blocks, fits, kind, classes, outputs)
    layout = Layout(kind, outputs, fits, n_numeric, offsets, fills(training_counts(blocks, fits, offsets), n_numeric, offsets), weights, base, policy.depth)
    cells = None
    if n_rows <= PARTITION_ROWS and n_rows * (len(offsets) - 1) <= PARTITION_BINS:
        trees, state = _grown_by_fit(blocks, layout, policy, n_parts)
    elif n_rows >= CELL_TABLE and (cells := few_cells(blocks, layout, n_rows)) is not None:
        trees, state = _grown_from_cells(blocks, layout, policy, cells)
    elif n_rows >= CELL_TABLE and kind != "regression" and (grid := grid_of(blocks, layout)) is not None:
        trees, state = _grown_on_grid(blocks, layout, policy, grid, n_rows)
    else:
        trees, state = _grown_by_level(blocks.map(lambda b: (b, np.repeat(layout.base[:, :, None], len(b.y), axis=2))), layout, policy)
    if cells is None:
        blocks.unpersist()
    return Grown(binning, layout, trees, state)


def coded(bins: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
    """A number for each row of ``bins`` that tells the different ones apart; None if they are too many to number."""
    code, most = np.zeros(bins.shape[1], np.int64), 1
    for x, size in zip(bins, np.diff(offsets).tolist(), strict=True):
        most *= size + 2  # one beyond the bins, and one that is missing
        if most >= 1 << 62:
            return None
        code = code * (size + 2) + np.minimum(x, size + 1)
    return code


def few_cells(blocks: RDD, layout: Layout, n_rows: int) -> np.ndarray | None:
    """(features, cells) of the different rows of bins in the order of their codes, if they are few."""
    per_cell = len(layout.fits) * layout.outputs
    most = min(CELLS, CELL_MARGINS // per_cell, n_rows // CELL_ROWS, DRAWN_BYTES // (8 * _drawn_numbers(layout)))

    def different(part: Iterator[Block]) -> Iterator[np.ndarray | None]:
        found = np.zeros(0, np.int64)
        for b in part:
            code = coded(b.bins, layout.offsets)
            found = None if code is None else np.union1d(found, code)
            if found is None or len(found) > most:
                yield None
                return
        yield found

    def both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return None
        c = np.union1d(a, b)
        return c if len(c) <= most else None

    code = blocks.mapPartitions(different).treeReduce(both)
    if code is None:
        return None
    bins = np.empty((len(layout.offsets) - 1, len(code)), np.uint16)
    for f, size in reversed(list(enumerate(np.diff(layout.offsets).tolist()))):
        at = code % (size + 2)
        bins[f], code = np.where(at == size + 1, MISSING, at), code // (size + 2)
    return bins


def _numbers(layout: Layout) -> int:
    """What is summed of a cell's rows: their count and targets, or their counts by class."""
    return 2 if layout.kind == "regression" else layout.weights.shape[1]


def drawn_sums(layout: Layout, key: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """(numbers, size) sums of rows by ``key``."""
    if layout.kind == "regression":
        return np.array([np.bincount(key, minlength=size), np.bincount(key, y, minlength=size)])
    n = _numbers(layout)
    return np.bincount(y * size + key, minlength=n * size).reshape(n, size).astype(np.float64)


def cell_gradients(layout: Layout, fit: int, margins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives, (outputs, cells) each, of the rows that ``sums`` counts."""
    if layout.kind == "regression":
        return margins * sums[0] - sums[1], sums[:1]
    own = sums * layout.weights[fit][:, None]
    total = own.sum(axis=0)
    if layout.kind == "binary":
        p = chance(margins)
        return p * total - own[1], np.maximum(p * (1 - p), 1e-16) * total
    p = softmax(margins)
    return p * total - own, np.maximum(2 * p * (1 - p), 1e-16) * total


def grown_over(layout: Layout, fit: int, bins: np.ndarray, margins: np.ndarray, draws: Iterable[tuple[int, np.ndarray]], policy: Boosting) -> tuple[list[Trees], np.ndarray]:
    """One fit's trees over cells: ``draws`` are the numbers of its trees with the sums that each draws; the margins after them.

    ``bins`` are the cells' as they are filled for the fit.  Cells go down together,
    those in a leaf as in its left children.
    """
    offsets, total, trees = layout.offsets, int(layout.offsets[-1]) + 1, []
    line = bins.astype(np.int32) + offsets[:-1, None].astype(np.int32)
    features = range(len(line))
    for number, sums in draws:
        tree, allowed = Trees.empty(layout.outputs, policy.depth), column_sample(offsets, layout.n_numeric, number, policy)
        both, added = cell_gradients(layout, fit, margins, sums), np.empty_like(margins)
        for o in range(layout.outputs):
            weights, node, depth = [np.ascontiguousarray(x[o]) for x in both], np.zeros(line.shape[1], np.int64), 0
            while depth < policy.depth:
                n_nodes, row = 2**depth, node * total
                found = np.zeros((2, n_nodes, total))
                for s, w in enumerate(weights):
                    found[s, :, -1] = np.bincount(node, w, minlength=n_nodes)
                for f in features:
                    key, (a, z) = row + line[f], offsets[f : f + 2]
                    for s, w in enumerate(weights):
                        found[s, :, a:z] = np.bincount(key, w, minlength=n_nodes * total).reshape(n_nodes, total)[:, a:z]
                if not _split(tree, depth, [(o, best_splits(found, offsets, layout.n_numeric, allowed))], policy.rate):
                    break
                chosen, cut = (x[o, n_nodes - 1 : 2 * n_nodes - 1] for x in (tree.feature, tree.bin))
                node *= 2
                for f in np.unique(chosen[chosen >= 0]):
                    number_of, mine = np.arange(total - 1) - offsets[f], (chosen == f)[:, None]
                    right = np.zeros((n_nodes, total), np.int8)
                    right[:, :-1] = mine & ((number_of > cut[:, None]) if f < layout.n_numeric else (number_of == cut[:, None]))
                    node += right.ravel().take(row + line[f])
                depth += 1
            added[o] = _ends(tree, o, depth)[node]
        trees.append(tree)
        margins = margins + added
    return trees, margins


@dataclass(frozen=True)
class Grid:
    """All combinations of bins: the features by axis, the largest last, the axes' lengths, and which end with a place for missing values."""

    features: tuple[int, ...]
    sizes: tuple[int, ...]
    missing: tuple[bool, ...]

    @classmethod
    def of(cls, offsets: np.ndarray, missing: np.ndarray) -> Grid:
        sizes = np.diff(offsets) + missing
        order = np.argsort(sizes, kind="stable").tolist()
        return cls(tuple(order), tuple(sizes[order].tolist()), tuple(missing[order].tolist()))

    @property
    def places(self) -> int:
        return math.prod(self.sizes)

    def placed(self, bins: np.ndarray) -> np.ndarray:
        """Where each row lies when the grid stands in one line."""
        at = np.zeros(bins.shape[1], np.int64)
        for f, size in zip(self.features, self.sizes, strict=True):
            at = at * size + np.minimum(bins[f], size - 1)
        return at

    def without_missing(self, x: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """(numbers, places) sums with those of missing values added to where ``fill`` puts them."""
        x = x.reshape(-1, *self.sizes)
        for axis, (f, gap) in enumerate(zip(self.features, self.missing, strict=True), 1):
            if gap:
                before = (slice(None),) * axis
                last, x = x[(*before, -1)], x[(*before, slice(-1))].copy()
                x[(*before, int(fill[f]))] += last
        return x.reshape(len(x), -1)

    def with_missing(self, x: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """(numbers, places) margins with those of missing values."""
        x = x.reshape(-1, *[n - gap for n, gap in zip(self.sizes, self.missing, strict=True)])
        for axis, (f, gap) in enumerate(zip(self.features, self.missing, strict=True), 1):
            if gap:
                x = np.concatenate([x, x.take([int(fill[f])], axis=axis)], axis=axis)
        return x.reshape(len(x), -1)


def _summed_out(x: np.ndarray, axis: int) -> np.ndarray:
    """``x.sum(axis=axis)``; along the last two axes products with ones are faster, whatever box ``x`` is of an array."""
    if axis == x.ndim - 1:
        return x @ np.ones(x.shape[-1])
    return np.ones(x.shape[-2]) @ x if axis == x.ndim - 2 else x.sum(axis=axis)


def marginals(x: np.ndarray) -> list[np.ndarray]:
    """(2, length) sums along each axis of ``x`` but the first."""
    if x.ndim < 3:
        return [x] if x.ndim == 2 else []
    last = _summed_out(x, x.ndim - 2)
    return [*marginals(_summed_out(x, x.ndim - 1)), last.sum(axis=tuple(range(1, last.ndim - 1)))]


class BoxSums:
    """Sums along each axis of boxes of a (2, places by axis) array.

    An axis along which a box isn't cut is summed out first, for all such boxes at once.
    """

    def __init__(self, x: np.ndarray):
        self.whole = tuple(range(x.ndim - 1))
        self.tables, self.sizes, self.held, self.most = {self.whole: x}, x.shape[1:], 0, x.size

    def over(self, axes: tuple[int, ...]) -> np.ndarray:
        """Sums over all axes but ``axes``, from the smallest table that has them; tables are kept up to the array's own size."""
        at = min((k for k in self.tables if set(axes) <= set(k)), key=lambda k: self.tables[k].size)
        x = self.tables[at]
        while at != axes:
            out = max(i for i, a in enumerate(at) if a not in axes)
            x, at = _summed_out(x, out + 1), (*at[:out], *at[out + 1 :])
            if self.held + x.size <= self.most:
                self.held += x.size
                self.tables[at] = x
        return x

    def box(self, node: tuple) -> list[np.ndarray]:
        cut = tuple(a for a, n in zip(self.whole, self.sizes, strict=True) if not isinstance(node[a], slice) or node[a] != slice(0, n))
        own = dict(zip(cut, marginals(self._boxed(node, cut, cut)), strict=True))
        for a in self.whole:
            if a not in own:
                axes = tuple(sorted((*cut, a)))
                x = self._boxed(node, axes, cut)
                for i in reversed(range(len(axes))):
                    x = x if axes[i] == a else _summed_out(x, i + 1)
                own[a] = x
        return [own[a] for a in self.whole]

    def _boxed(self, node: tuple, axes: tuple[int, ...], cut: tuple[int, ...]) -> np.ndarray:
        x = self.over(axes)
        for i, a in enumerate(axes, 1):
            if a in cut:
                x = x[(slice(None),) * i + (node[a],)]
        return x


def grown_over_grid(layout: Layout, fit: int, grid: Grid, margins: np.ndarray, draws: Iterable[tuple[int, np.ndarray]], policy: Boosting) -> tuple[list[Trees], np.ndarray]:
    """``grown_over`` for every place of a grid without missing values: a node is some bins of each feature, so its sums are those of a box."""
    offsets, trees, margins = layout.offsets, [], margins.copy()
    both = np.empty((2, *margins.shape))
    for number, sums in draws:
        tree, allowed = Trees.empty(layout.outputs, policy.depth), column_sample(offsets, layout.n_numeric, number, policy)
        for a in range(0, grid.places, GRID_PIECE):
            piece = slice(a, a + GRID_PIECE)
            both[0, :, piece], both[1, :, piece] = cell_gradients(layout, fit, margins[:, piece], sums[:, piece])
        for o in range(layout.outputs):
            own, nodes, depth = BoxSums(both[:, o].reshape(2, *grid.sizes)), [tuple(slice(0, n) for n in grid.sizes)], 0
            while depth < policy.depth:
                found = np.zeros((2, len(nodes), offsets[-1] + 1))
                for i, node in enumerate(nodes):
                    if node is not None:
                        for axis, m in enumerate(own.box(node)):
                            a, z = offsets[grid.features[axis] :][:2]
                            found[:, i, a:z][:, node[axis]] = m
                        found[:, i, -1] = m.sum(axis=1)
                if not _split(tree, depth, [(o, best_splits(found, offsets, layout.n_numeric, allowed))], policy.rate):
                    break
                first, depth = len(nodes) - 1, depth + 1
                nodes = [child for i, node in enumerate(nodes) for child in _children(node, int(tree.feature[o, first + i]), int(tree.bin[o, first + i]), grid, layout.n_numeric)]
            here = margins[o].reshape(grid.sizes)
            for node, value in zip(nodes, _ends(tree, o, depth), strict=True):
                if node is not None:
                    at = node if all(isinstance(x, slice) for x in node) else np.ix_(*[np.arange(n)[x] for n, x in zip(grid.sizes, node, strict=True)])
                    here[at] += value
        trees.append(tree)
    return trees, margins


def _children(node: tuple | None, feature: int, cut: int, grid: Grid, n_numeric: int) -> list[tuple | None]:
    """A leaf's left child has all that is in the leaf."""
    if node is None or feature < 0:
        return [node, None]
    axis = grid.features.index(feature)
    if feature < n_numeric:
        middle = min(max(cut + 1, node[axis].start), node[axis].stop)
        sides = slice(node[axis].start, middle), slice(middle, node[axis].stop)
    else:
        at = np.arange(grid.sizes[axis])[node[axis]]
        sides = at[at != cut], at[at == cut]
    return [(*node[:axis], side, *node[axis + 1 :]) for side in sides]


def _ends(tree: Trees, t: int, depth: int) -> np.ndarray:
    """The value of each node of a level: that of the leaf it lies in."""
    at = np.arange(2**depth - 1, 2 ** (depth + 1) - 1)
    for _ in range(depth):
        at = np.where((at > 0) & (tree.feature[t, (at - 1) // 2] < 0), (at - 1) // 2, at)
    return tree.value[t, at]


def _side_by_side(of_fits: list[list[Trees]]) -> list[Trees]:
    """Rounds of all fits from the rounds of each."""
    return [Trees(*[np.concatenate([getattr(t, name) for t in one]) for name in ("feature", "bin", "value")]) for one in zip(*of_fits, strict=True)]


def _grown_by_fit(blocks: RDD, layout: Layout, policy: Boosting, n_parts: int) -> tuple[list[Trees], RDD]:
    """Trees of a table of at most ``PARTITION_ROWS`` rows: a fit is a task, with the table's cells."""
    n_trees = policy.trees if len(layout.offsets) > 1 else 0

    def run(part: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, list[Trees] | None, int, Block | None, np.ndarray | None]]:
        mine = list(part)
        if not mine:
            return
        fit, own = mine[0][0], sorted((b for _, b in mine), key=lambda b: tuple(b.row[:1]))
        bins = np.concatenate([b.bins for b in own], axis=1)
        y, row, trains = (np.concatenate(x) for x in zip(*[(b.y, b.row, layout.fits[fit].trains(b)) for b in own], strict=True))
        code, grid = coded(bins, layout.offsets), None
        cell = np.arange(len(y))
        if code is not None:
            _, at, cell = np.unique(code, return_index=True, return_inverse=True)
            grid = _dense_grid(layout, len(at))
            cell = cell if grid is None else grid.placed(layout.filled(fit, bins))
            bins = bins[:, at]
        n_cells = bins.shape[1] if grid is None else grid.places
        y = y if layout.kind == "regression" else y.astype(np.int64)
        draws = ((n, drawn_sums(layout, cell[at], y[at], n_cells)) for n in range(n_trees) for at in [np.flatnonzero(trains & drawn(row, n, policy.seed, policy.subsample))])
        margins = np.repeat(layout.base[fit][:, None], n_cells, axis=1)
        trees, margins = grown_over(layout, fit, layout.filled(fit, bins), margins, draws, policy) if grid is None else grown_over_grid(layout, fit, grid, margins, draws, policy)
        yield fit, trees, -1, None, None
        ends = np.cumsum([len(b.y) for b in own])
        for i, (b, end) in enumerate(zip(own, ends.tolist(), strict=True)):
            yield fit, None, i, b if fit == 0 else None, margins[:, cell[end - len(b.y) : end]]

    n_fits = len(layout.fits)
    done = blocks.flatMap(lambda b: [(i, b) for i in range(n_fits)]).partitionBy(n_fits, int).mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
    trees = dict(done.filter(lambda x: x[1] is not None).map(lambda x: x[:2]).collect())

    def joined(parts: Iterable[tuple[int, Block | None, np.ndarray]]) -> State:
        own = sorted(parts, key=lambda x: x[0])
        return own[0][1], np.array([m for _, _, m in own])

    state = done.filter(lambda x: x[1] is None).map(lambda x: (x[2], (x[0], x[3], x[4]))).groupByKey(n_parts).map(lambda x: joined(x[1]))
    return _side_by_side([trees[i] for i in range(n_fits)]) if trees else [], state


def _views(layout: Layout) -> list[tuple[int | None, list[int], list[tuple[int, int | None]]]]:
    """(outer fold or None, its values, fits): folds that fits leave out one part of, each fit with that part's place or None.

    All rows are parted by outer fold; those beyond an outer fold by its inner folds.
    """
    out = []
    for outer in [None, *sorted({f.outer for f in layout.fits if f.inner is not None})]:
        mine = [(i, f.outer if outer is None else f.inner) for i, f in enumerate(layout.fits) if (f.inner is None if outer is None else f.outer == outer and f.inner is not None)]
        values = sorted({v for _, v in mine if v is not None})
        if mine:
            out.append((outer, values, [(i, None if v is None else values.index(v)) for i, v in mine]))
    return out


def _drawn_numbers(layout: Layout) -> int:
    """Numbers that a tree draws of a cell, in all views."""
    return _numbers(layout) * sum(len(values) + 1 for _, values, _ in _views(layout))


def _grown_from_cells(blocks: RDD, layout: Layout, policy: Boosting, cells: np.ndarray) -> tuple[list[Trees], RDD]:
    """Trees of a table of few cells: a job draws from all rows for a batch of trees, and a task a fit grows them from the sums."""
    n_cells, views, n_fits, codes = cells.shape[1], _views(layout), len(layout.fits), coded(cells, layout.offsets)
    summed = np.dtype(np.float64 if layout.kind == "regression" else np.int32)  # rows of a class are counted
    batch = max(1, DRAWN_BYTES // (summed.itemsize * n_cells * _drawn_numbers(layout)))
    n_tasks = max(1, min(n_fits, blocks.context.defaultParallelism))

    def keys(b: Block) -> list[np.ndarray]:
        """For each view where a row's numbers are summed, or -1."""
        cell, out = np.searchsorted(codes, coded(b.bins, layout.offsets)), []
        for outer, values, _ in views:
            own = b.fold if outer is None else b.inner[outer]
            part = np.full(len(own), len(values), np.int64)
            for i, v in enumerate(values):
                part[own == v] = i
            out.append(np.where(b.fold == outer, -1, part * n_cells + cell) if outer is not None else part * n_cells + cell)
        return out

    def draw(numbers: range) -> Callable[[Iterator[Block]], Iterator[tuple[tuple[int, int], np.ndarray]]]:
        def run(part: Iterator[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            total = [np.zeros((len(numbers), _numbers(layout), (len(values) + 1) * n_cells), summed) for _, values, _ in views]
            waiting, n = [], 0

            def put() -> None:
                row, y, *own = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for i, number in enumerate(numbers):
                    at = np.flatnonzero(drawn(row, number, policy.seed, policy.subsample))
                    some = y[at]
                    for v, key in enumerate(own):
                        where = key[at]
                        known = slice(None) if views[v][0] is None else where >= 0
                        total[v][i] += drawn_sums(layout, where[known], some[known], total[v].shape[2]).astype(summed)

            for b in part:
                for a in range(0, len(b.y), DRAWN_ROWS):
                    piece = slice(a, a + DRAWN_ROWS)
                    y = b.y[piece] if layout.kind == "regression" else b.y[piece].astype(np.int64)
                    waiting.append((b.row[piece], y, *[k[piece] for k in keys(b)]))
                    n += len(y)
                    if n >= DRAWN_ROWS:
                        put()
                        waiting, n = [], 0
            if n:
                put()
            for v, sums in enumerate(total):
                for i, number in enumerate(numbers):
                    yield (v, number), sums[i]

        return run

    def dealt(x: tuple[tuple[int, int], np.ndarray]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        """What each fit of a view draws: all parts but the one it leaves out."""
        (v, number), sums = x
        parts = sums.reshape(_numbers(layout), -1, n_cells)
        for fit, out in views[v][2]:
            yield fit, (number, np.delete(parts, out, axis=1).sum(axis=1) if out is not None else parts.sum(axis=1))

    def grown(margins: np.ndarray) -> Callable:
        def run(part: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, list[Trees], np.ndarray]]:
            own: dict[int, list[tuple[int, np.ndarray]]] = {}
            for fit, x in part:
                own.setdefault(fit, []).append(x)
            for fit, draws in own.items():
                yield fit, *grown_over(layout, fit, layout.filled(fit, cells), margins[fit], sorted(draws, key=lambda x: x[0]), policy)

        return run

    trees, margins = [], np.repeat(layout.base[:, :, None], n_cells, axis=2)
    for first in range(0, policy.trees if len(layout.offsets) > 1 else 0, batch):
        sums = blocks.mapPartitions(draw(range(first, min(policy.trees, first + batch)))).reduceByKey(np.add, blocks.context.defaultParallelism)
        found = sorted(sums.flatMap(dealt).partitionBy(n_tasks, int).mapPartitions(grown(margins)).collect(), key=lambda x: x[0])
        trees += _side_by_side([t for _, t, _ in found])
        margins = np.array([m for _, _, m in found])
    held = blocks.context.broadcast(margins)
    return trees, blocks.map(lambda b: (b, held.value[:, :, np.searchsorted(codes, coded(b.bins, layout.offsets))]))


def grid_of(blocks: RDD, layout: Layout) -> Grid | None:
    """The grid of a table's bins, if it isn't too large."""
    missing = np.zeros(len(layout.offsets) - 1, bool)
    if not len(missing) or _too_large(Grid.of(layout.offsets, missing), layout):
        return None
    grid = Grid.of(layout.offsets, blocks.map(lambda b: (b.bins == MISSING).any(axis=1)).treeReduce(np.logical_or))
    return None if _too_large(grid, layout) else grid


def _too_large(grid: Grid, layout: Layout) -> bool:
    return grid.places > GRID or grid.places * max(layout.outputs, _numbers(layout)) > GRID_NUMBERS


def _dense_grid(layout: Layout, n_cells: int) -> Grid | None:
    """The grid without missing values, if sums over all of it are less work than over so many cells."""
    grid = Grid.of(layout.offsets, np.zeros(len(layout.offsets) - 1, bool))
    return None if not grid.sizes or _too_large(grid, layout) or grid.places > GRID_CELL * n_cells else grid


def _joined(own: list[Block]) -> Block:
    return Block(*[np.concatenate([getattr(b, name) for b in own], axis=-1) for name in ("bins", "y", "fold", "inner", "row", "key")])


def _some(b: Block, at: np.ndarray) -> Block:
    return Block(*[x[..., at] for x in (b.bins, b.y, b.fold, b.inner, b.row, b.key)])


def _dealt_by_place(blocks: RDD, grid: Grid, n_rows: int) -> tuple[RDD, list[tuple[int, int]], list[list[int]]]:
    """(partition, (slice, block)) of slices of the grid, several partitions for one of many rows; the slices' ends, and their partitions."""
    n_slices = max(1, min(grid.places, max(blocks.getNumPartitions(), -(-n_rows // SPREAD_ROWS))))
    width = -(-grid.places // n_slices)
    ends = [(a, min(grid.places, a + width)) for a in range(0, grid.places, width)]
    rows = blocks.map(lambda b: np.bincount(grid.placed(b.bins) // width, minlength=len(ends))).treeReduce(np.add)
    parts = np.maximum(1, -(-rows // SPREAD_ROWS))
    first = np.concatenate(([0], np.cumsum(parts)))

    def deal(part: Iterator[Block]) -> Iterator[tuple[int, tuple[int, Block]]]:
        waiting, n = [], 0

        def put() -> Iterator[tuple[int, tuple[int, Block]]]:
            b = _joined(waiting)
            s = grid.placed(b.bins) // width
            to = first[s] + b.row % parts[s]
            order = np.argsort(to, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                yield int(to[at[0]]), (int(s[at[0]]), _some(b, at))

        for b in part:
            waiting.append(b)
            n += len(b.y)
            if n >= SPREAD_ROWS:
                yield from put()
                waiting, n = [], 0
        if n:
            yield from put()

    def one(part: Iterator[tuple[int, tuple[int, Block]]]) -> Iterator[tuple[int, tuple[int, Block]]]:
        mine = list(part)
        if mine:
            own = _joined([b for _, (_, b) in mine])
            yield mine[0][0], (mine[0][1][0], _some(own, np.argsort(grid.placed(own.bins), kind="stable")))

    dealt = blocks.mapPartitions(deal).partitionBy(int(first[-1]), int).mapPartitions(one, preservesPartitioning=True)
    return dealt, ends, [list(range(a, z)) for a, z in zip(first.tolist(), first.tolist()[1:], strict=False)]


def _grown_on_grid(blocks: RDD, layout: Layout, policy: Boosting, grid: Grid, n_rows: int) -> tuple[list[Trees], RDD]:
    """Trees of classes by places of a grid: rows count, for a batch of trees a job, what isn't drawn, and a task a fit grows them from the rest."""
    n_fits, n_classes = len(layout.fits), _numbers(layout)
    rows, ends, parts = _dealt_by_place(blocks, grid, n_rows)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def left_out(numbers: range | None) -> Callable[[tuple[int, tuple[int, Block]]], Iterator[tuple[int, tuple[int | None, int, str, bytes]]]]:
        """(fit, (tree, slice, type, counts by class and place)) of a fit's rows that a tree doesn't draw; for None of all its rows."""

        def run(x: tuple[int, tuple[int, Block]]) -> Iterator[tuple[int, tuple[int | None, int, str, bytes]]]:
            s, b = x[1]
            a, z = ends[s]
            key = b.y.astype(np.int64) * (z - a) + grid.placed(b.bins) - a
            trains = [fit.trains(b) for fit in layout.fits]
            for number in [None] if numbers is None else numbers:
                at = np.arange(len(key)) if number is None else np.flatnonzero(~drawn(b.row, number, policy.seed, policy.subsample))
                some = key[at]
                for fit, own in enumerate(trains):
                    counts = np.bincount(some[own[at]], minlength=n_classes * (z - a))
                    counts = counts.astype(np.min_scalar_type(counts.max()))
                    yield fit, (number, s, counts.dtype.str, pa.compress(counts, codec="zstd", asbytes=True))

        return run

    def opened(s: int, kind: str, data: bytes) -> np.ndarray:
        a, z = ends[s]
        size = n_classes * (z - a) * np.dtype(kind).itemsize
        return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), kind).reshape(n_classes, z - a)

    def counted(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple[str, np.ndarray]]]:
        own: dict[int, np.ndarray] = {}
        for fit, (_, s, kind, data) in part:
            own.setdefault(fit, np.zeros((n_classes, grid.places), np.int32))[:, slice(*ends[s])] += opened(s, kind, data)
        for fit, counts in own.items():
            yield fit, ("rows", counts)

    def base(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple[str, np.ndarray]]]:
        for fit, _ in part:
            places = math.prod(n - gap for n, gap in zip(grid.sizes, grid.missing, strict=True))
            yield fit, ("margins", np.repeat(layout.base[fit][:, None], places, axis=1))

    bare = replace(grid, sizes=tuple(n - gap for n, gap in zip(grid.sizes, grid.missing, strict=True)), missing=(False,) * len(grid.sizes))

    def grown(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        state, waiting = {}, {}
        for fit, x in part:
            if isinstance(x[0], str):
                state[x[0]] = x[1]
            else:
                waiting.setdefault(x[0], []).append(x[1:])

        def draws() -> Iterator[tuple[int, np.ndarray]]:
            for number in sorted(waiting):
                counts = state["rows"].copy()
                for s, kind, data in waiting.pop(number):
                    counts[:, slice(*ends[s])] -= opened(s, kind, data)
                yield number, grid.without_missing(counts, layout.fill[fit])

        trees, margins = grown_over_grid(layout, fit, bare, state["margins"], draws(), policy)
        yield fit, ("trees", trees)
        yield fit, ("margins", margins)

    # What a fit needs has the same partitioner, so the unions are narrow.
    counts = rows.flatMap(left_out(None)).partitionBy(n_fits, int).mapPartitions(counted, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    step, files, trees = counts.mapPartitions(base, preservesPartitioning=True), [], []
    batch = max(1, GRID_BYTES // (n_classes * grid.places))
    for i, first in enumerate(range(0, policy.trees, batch)):
        sent = rows.flatMap(left_out(range(first, min(policy.trees, first + batch)))).partitionBy(n_fits, int)
        old, margins = step, step.filter(lambda x: x[1][0] == "margins")
        step = counts.union(margins).union(sent).mapPartitions(grown, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        if i % GRID_BATCHES == GRID_BATCHES - 1:
            files.append(step)
            step.checkpoint()
        found = dict(step.filter(lambda x: x[1][0] == "trees").mapValues(lambda x: x[1]).collect())
        trees += _side_by_side([found[fit] for fit in range(n_fits)])
        old.unpersist()
        if len(files) > 1:
            removed(SparkSession.active(), files.pop(0).getCheckpointFile())

    def cut(x: tuple[int, tuple[str, np.ndarray]]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        fit, (_, margins) = x
        margins = grid.with_missing(margins, layout.fill[fit])
        for (a, z), mine in zip(ends, parts, strict=True):
            for p in mine:
                yield p, (fit, margins[:, a:z])

    def met(part: Iterator[tuple[int, tuple]]) -> Iterator[State]:
        own, margins = None, {}
        for _, (number, x) in part:
            if isinstance(x, Block):
                own = number, x
            else:
                margins[number] = x
        if own:
            s, b = own
            at = grid.placed(b.bins) - ends[s][0]
            yield b, np.array([margins[i][:, at] for i in range(n_fits)])

    cuts = step.filter(lambda x: x[1][0] == "margins").flatMap(cut).partitionBy(rows.getNumPartitions(), int)
    return trees, rows.union(cuts).mapPartitions(met)


def _grown_by_level(state: RDD, layout: Layout, policy: Boosting) -> tuple[list[Trees], RDD]:
    """Trees by one aggregation a level, the splits of all fits coming to the driver."""
    spark = state.context
    offsets, n_numeric, n_trees = layout.offsets, layout.n_numeric, len(layout.fits) * layout.outputs
    n_reducers = max(1, min(n_trees, spark.defaultParallelism))
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    trees, old, files = [], [], []
    for number in range(policy.trees if len(offsets) > 1 else 0):
        tree, allowed = Trees.empty(n_trees, policy.depth), column_sample(offsets, n_numeric, number, policy)
        for level in range(policy.depth):
            sums = state.mapPartitions(_sums(layout, tree, level, number, policy)).reduceByKey(np.add, n_reducers)
            found = sums.mapValues(_best(offsets, n_numeric, allowed)).collect()
            while level == 0 and old:  # the state stands now, and what it was made from can go
                old.pop().unpersist()
            if not _split(tree, level, found, policy.rate):
                break
        trees.append(tree)
        old.append(state)
        state = state.map(_step(layout, tree), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT == CHECKPOINT - 1:
            files.append(state)
            state.checkpoint()
            if len(files) > 2:
                removed(SparkSession.active(), files.pop(0).getCheckpointFile())
    state.count()
    for rdd in old:
        rdd.unpersist()
    return trees, state


def _best(offsets: np.ndarray, n_numeric: int, allowed: np.ndarray) -> Callable[[np.ndarray], list]:
    return lambda sums: best_splits(sums, offsets, n_numeric, allowed)


def _sums(layout: Layout, tree: Trees, level: int, number: int, policy: Boosting) -> Callable[[Iterator[State]], Iterator[tuple[int, np.ndarray]]]:
    return lambda part: _summed(_samples(part, layout, number, policy), layout, tree, level)


def _step(layout: Layout, tree: Trees) -> Callable[[State], State]:
    return lambda state: _advanced(state, layout, tree)
