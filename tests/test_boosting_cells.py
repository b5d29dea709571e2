"""Trees grown over cells, the different rows of bins, against those of a job a level."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import boosting
from tallyframe.operators.boosting import MISSING, Fit, coded, grow
from tallyframe.plans.policies import Boosting
from tallyframe.shared import kept

POLICY = Boosting(trees=7, depth=3, rate=0.3, folds=3, inner_folds=2)
FITS = [Fit(0), Fit(2), Fit(1, 0), Fit(1, 1), Fit()]


def table(spark, n=600):
    rng, rows = random.Random(9), []
    for i in range(n):
        a, b, c = rng.choice([None, 0.5, 1.0, 2.5]), rng.randrange(6), rng.choice(["p", "q", None])
        signal = (a or 1) + (c == "q") * 2 - b / 2 + rng.gauss(0, 1)
        rows.append((a, b, c, i % 3, i % 2, i, i * 7, signal, int(signal > 0), sum(signal > t for t in (-1, 1))))
    return spark.createDataFrame(rows, "a double, b int, c string, fold int, inner int, _row long, _key long, number double, two int, three int").repartition(4)


def margins_of(grown):
    return {int(r): margins[:, :, i] for block, margins in grown.state.collect() for i, r in enumerate(block.row)}


@pytest.mark.parametrize(("kind", "target", "classes"), [("regression", "number", 0), ("binary", "two", 2), ("multiclass", "three", 3)])
def test_ways_of_growing_agree(spark, monkeypatch, kind, target, classes):
    df = kept(table(spark).withColumn("_y", F.col(target).cast("double")), "test-cells")
    found = {}
    for way, rows, least, held in (("_grown_by_fit", 1000, 1000, 1 << 26), ("_grown_from_cells", 100, 100, 20_000), ("_grown_by_level", 100, 1000, 1 << 26)):
        monkeypatch.setattr(boosting, "PARTITION_ROWS", rows)
        monkeypatch.setattr(boosting, "CELL_TABLE", least)
        monkeypatch.setattr(boosting, "DRAWN_BYTES", held)  # sums of a few trees at once
        called, grower = [], getattr(boosting, way)
        monkeypatch.setattr(boosting, way, lambda *x, called=called, grower=grower: called.append(1) or grower(*x))
        found[way] = grow(df, ["a", "b", "c"], kind, POLICY, FITS, classes, ["fold", *["inner"] * 3])
        assert called
    one, *others = ((g, margins_of(g)) for g in found.values())
    for grown, margins in others:
        assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, atol=1e-9) for a, b in zip(one[0].trees, grown.trees, strict=True))
        assert margins.keys() == one[1].keys() and max(np.abs(margins[r] - m).max() for r, m in one[1].items()) < 1e-9


def test_few_cells_take_no_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    monkeypatch.setattr(boosting, "CELL_TABLE", 100)
    df = kept(table(spark).withColumn("_y", F.col("number")), "test-jobs")
    sc = spark.sparkContext
    sc.setJobGroup("cells", "trees of few cells")
    grown = grow(df, ["a", "b", "c"], "regression", replace(POLICY, trees=60), [Fit(0), Fit()], folds=["fold"])
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(grown.trees) == 60 and len(sc.statusTracker().getJobIdsForGroup("cells")) < 30


def test_codes_tell_rows_of_bins_apart():
    offsets = np.array([0, 2, 5])
    bins = np.array([[0, 1, MISSING, 0, 2], [2, 2, 0, MISSING, 3]], np.uint16)
    assert len(set(coded(bins, offsets).tolist())) == 5
    assert coded(np.zeros((9, 1), np.uint16), np.arange(10) * 254) is None
