"""Copies of a row are one point with a weight, and a table of one small file is spread over all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import kmeans as module
from tallyframe.operators import segment
from tallyframe.operators.kmeans import blocks_of, first_centres, kmeans
from tallyframe.shared import kept, spread


def test_passes_go_over_different_points(spark, monkeypatch):
    rows = kept(spark.range(6000).select((F.col("id") % 20).cast("double").alias("a"), (F.pow(F.col("id") % 7, F.lit(2)) * F.when(F.col("id") % 20 > 12, 9).otherwise(1)).cast("double").alias("b"), F.monotonically_increasing_id().alias("n")), "test-copies")
    x = np.array([(r.a, r.b) for r in rows.collect()])
    seen, plain = [], module._sums

    def counted(blocks, centres):
        seen.append(blocks.map(lambda b: (len(b[0]), int(b[0].sum()))).reduce(lambda p, q: (p[0] + q[0], p[1] + q[1])))
        return plain(blocks, centres)

    monkeypatch.setattr(module, "_sums", counted)
    found = kmeans(rows, ["a", "b"], "n", 3, 4, 42)
    assert set(seen) == {(140, 6000)}
    costs = []
    for c in first_centres(blocks_of(rows, ["a", "b"], "n"), 3, 4, 42):
        for _ in range(300):
            label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(3)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var(axis=0).mean():
                break
        costs.append(((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
    assert found.cost == pytest.approx(min(costs), rel=1e-9)


def test_few_partitions_are_spread(spark):
    one = kept(spark.range(1000).coalesce(1), "test-spread")
    assert one.rdd.getNumPartitions() == 1
    assert spread(one, 1000, 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(one, 1000, 500).rdd.getNumPartitions() == 2 and spread(one, 1000).rdd.getNumPartitions() == 1


def test_rows_keep_their_numbers_when_spread(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = kept(spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(900, 2)) + 6 * rng.integers(0, 2, 900)[:, None]], "a double, b double").coalesce(1), "test-numbers")
    seen = []
    monkeypatch.setattr(segment, "kmeans", lambda rows, *x: seen.append({r["_row"]: (r.raw.a, r.raw.b) for r in rows.collect()}) or kmeans(rows, *x))
    plain = segment.segments(df)[1]
    monkeypatch.setattr(segment, "spread", lambda rows, n: spread(rows, n, 100))
    assert segment.segments(df)[1] == pytest.approx(plain, rel=1e-9)
    assert seen[0] == seen[1] and len(seen[0]) == 900
