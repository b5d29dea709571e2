"""Trees of classes grown over the grid of all bins, against those of a job a level."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import boosting
from tallyframe.operators.boosting import MISSING, Grid, grow
from tallyframe.operators.models import multiclass_models
from tallyframe.shared import kept
from tests.test_boosting_cells import FITS, POLICY, margins_of, table


@pytest.mark.parametrize(("kind", "target", "classes"), [("binary", "two", 2), ("multiclass", "three", 3)])
def test_grid_agrees_with_a_job_a_level(spark, monkeypatch, kind, target, classes):
    df = kept(table(spark).withColumn("_y", F.col(target).cast("double")), "test-grid")
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    monkeypatch.setattr(boosting, "SPREAD_ROWS", 90)  # several slices, and several partitions for some
    monkeypatch.setattr(boosting, "CELL_TABLE", 100)
    monkeypatch.setattr(boosting, "CELLS", 10)
    monkeypatch.setattr(boosting, "GRID_BYTES", 700)  # a few trees a job
    monkeypatch.setattr(boosting, "GRID_BATCHES", 1)
    monkeypatch.setattr(boosting, "GRID_PIECE", 50)
    found = {}
    for way, most in (("_grown_on_grid", 1 << 21), ("_grown_by_level", 10)):
        monkeypatch.setattr(boosting, "GRID", most)
        called, grower = [], getattr(boosting, way)
        monkeypatch.setattr(boosting, way, lambda *x, called=called, grower=grower: called.append(1) or grower(*x))
        found[way] = grow(df, ["a", "b", "c"], kind, POLICY, FITS, classes, ["fold", *["inner"] * 3])
        assert called
    one, other = found.values()
    assert len(one.trees) == POLICY.trees
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, atol=1e-9) for a, b in zip(one.trees, other.trees, strict=True))
    mine, want = margins_of(one), margins_of(other)
    assert mine.keys() == want.keys() and max(np.abs(mine[r] - m).max() for r, m in want.items()) < 1e-9
    held = [sorted((r["_key"], r.fit, r.answers) for r in g.held_out(spark, [0, 2]).collect()) for g in (one, other)]
    assert [x[:2] for x in held[0]] == [x[:2] for x in held[1]] and np.allclose([x[2] for x in held[0]], [x[2] for x in held[1]], atol=1e-9)


@pytest.mark.parametrize(("kind", "target", "classes"), [("regression", "number", 0), ("binary", "two", 2), ("multiclass", "three", 3)])
def test_a_fit_grows_the_same_over_grid_and_cells(spark, monkeypatch, kind, target, classes):
    df = kept(table(spark).withColumn("_y", F.col(target).cast("double")), "test-dense")
    found, grids = [], []
    dense = boosting._dense_grid
    for share in (100, 0):
        monkeypatch.setattr(boosting, "GRID_CELL", share)
        grids.append(dense(boosting.Layout(kind, max(1, classes), [], 2, np.array([0, 3, 9, 11]), None, np.ones((1, max(1, classes))), None, 3), 30))
        found.append(grow(df, ["a", "b", "c"], kind, POLICY, FITS, classes, ["fold", *["inner"] * 3]))
    assert grids[0].sizes == (2, 3, 6) and grids[1] is None
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, atol=1e-9) for a, b in zip(*[g.trees for g in found], strict=True))
    mine, want = map(margins_of, found)
    assert mine.keys() == want.keys() and max(np.abs(mine[r] - m).max() for r, m in want.items()) < 1e-9


def test_many_cells_of_classes_take_no_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    monkeypatch.setattr(boosting, "CELL_TABLE", 100)
    monkeypatch.setattr(boosting, "CELLS", 10)
    df = kept(table(spark).withColumn("_y", F.col("three").cast("double")), "test-jobs")
    sc = spark.sparkContext
    sc.setJobGroup("grid", "trees of many cells")
    grown = grow(df, ["a", "b", "c"], "multiclass", replace(POLICY, trees=60), FITS[:2], 3, ["fold", *["inner"] * 3])
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(grown.trees) == 60 and len(sc.statusTracker().getJobIdsForGroup("grid")) < 30


def test_scores_are_written_once(spark, monkeypatch):
    asked = []
    held_out = boosting.Grown.held_out
    monkeypatch.setattr(boosting.Grown, "held_out", lambda self, *x: asked.append(held_out(self, *x)) or asked[-1])
    oof, _ = multiclass_models(table(spark).select("a", "b", "c", "three"), "three", replace(POLICY, trees=2))
    assert "ExistingRDD" not in oof._jdf.queryExecution().optimizedPlan().toString() and len(asked) == 1
    assert oof.count() == 600


def test_places_of_missing_values():
    grid = Grid.of(np.array([0, 2, 5]), np.array([True, False]))
    assert (grid.features, grid.sizes, grid.missing) == ((0, 1), (3, 3), (True, False))
    assert grid.placed(np.array([[0, 1, MISSING], [2, 0, 1]], np.uint16)).tolist() == [2, 3, 7]
    sums = np.arange(9)[None]
    assert grid.without_missing(sums, np.array([1, 0])).tolist() == [[0, 1, 2, 9, 11, 13]] and sums.tolist() == [list(range(9))]
    assert grid.with_missing(np.arange(6.0)[None], np.array([1, 0])).tolist() == [[0, 1, 2, 3, 4, 5, 3, 4, 5]]


def test_sums_of_boxes():
    x = np.random.default_rng(5).normal(size=(2, 4, 3, 5, 6))
    sums = boosting.BoxSums(x)
    whole = [slice(0, n) for n in x.shape[1:]]
    for cuts in ({}, {2: slice(1, 4)}, {0: slice(1, 2), 3: np.array([0, 2, 5])}, {1: np.array([1]), 2: slice(0, 2), 3: slice(2, 6)}, {0: slice(2, 4), 1: slice(0, 0)}, dict(enumerate([slice(0, 3), slice(1, 3), slice(2, 5), slice(0, 5)]))):
        node = tuple(cuts.get(a, at) for a, at in enumerate(whole))
        own = x
        for a, at in enumerate(node, 1):
            own = own[(slice(None),) * a + (at,)]
        want = [own.sum(axis=tuple(b for b in range(1, 5) if b != a)) for a in range(1, 5)]
        assert all(g.shape == w.shape and np.allclose(g, w, atol=1e-12) for g, w in zip(sums.box(node), want, strict=True))
    assert sums.held <= x.size
