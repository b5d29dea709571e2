"""K-means with shared scans against starts of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import kmeans as module
from tallyframe.operators.kmeans import blocks_of, first_centres, kmeans
from tallyframe.shared import kept


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (60, 2)) for m in ((0, 0), (6, 0), (0, 6), (6, 6), (3, 12))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(3)
    return kept(df.withColumn("n", F.monotonically_increasing_id()), "test-kmeans")


def lloyd(x, centres, tolerance):
    for _ in range(300):
        label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centres)])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tolerance:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def test_best_start_equals_separate_starts(spark, rows):
    x = np.array([(r.a, r.b) for r in rows.collect()])
    blocks = blocks_of(rows, ["a", "b"], "n")
    first = first_centres(blocks, 5, 6, 42)
    assert first.shape == (6, 5, 2) and all(len(np.unique(c, axis=0)) == 5 for c in first)
    assert (first_centres(blocks, 5, 6, 42) == first).all() and {tuple(p) for c in first for p in c} <= {tuple(p) for p in x}
    spread = 1e-4 * x.var(axis=0).mean()
    separate = [lloyd(x, c.copy(), spread) for c in first]
    found = kmeans(rows, ["a", "b"], "n", 5, 6, 42)
    best, cost = min(separate, key=lambda c: c[1])
    assert found.cost == pytest.approx(cost) and np.allclose(found.centres, best)
    labels = rows.withColumn("s", found.nearest(["a", "b"])).collect()
    assert [r.s for r in labels] == ((np.array([(r.a, r.b) for r in labels])[:, None] - found.centres) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_starts_share_their_scans(spark, rows, monkeypatch):
    scans, plain = [], module._sums
    monkeypatch.setattr(module, "_sums", lambda blocks, centres: scans.append(len(centres)) or plain(blocks, centres))
    kmeans(rows, ["a", "b"], "n", 5, 6, 42)
    assert scans[0] == scans[-1] == 6 and sorted(scans[:-1], reverse=True) == scans[:-1] and scans[-2] < 6


def test_few_and_equal_rows(spark):
    same = kept(spark.createDataFrame([(1.0, 2.0)] * 7, "a double, b double").withColumn("n", F.monotonically_increasing_id()), "test-same")
    found = kmeans(same, ["a", "b"], "n", 2, 3, 1)
    assert found.cost == 0 and (found.centres == [1.0, 2.0]).all()
