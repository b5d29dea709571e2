"""The ROC area needs the rows once: counts by score carry the positives along."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.evaluate import roc_auc


def test_rows_are_not_joined_with_their_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.4, rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for _ in range(300)]
    out = roc_auc(spark.createDataFrame(rows, "y boolean, s double"), F.col("y"), F.col("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "LogicalRDD" not in plan  # only with the ranges' totals
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for n, b in rows if not n]
    assert out.first()["roc_auc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
