"""The rows of a table stay where they are when brackets are put beside them."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators.describe import describe


def test_rows_are_not_dealt_out_by_group(spark):
    df = spark.range(3000).select((F.col("id") % 997).cast("double").alias("a"), (F.col("id") % 31).cast("double").alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = describe(df, ["a", "b"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.variable: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    for c, m in (("a", 997), ("b", 31)):
        x = np.arange(3000) % m
        assert [got[c].n, got[c].q1, got[c].median, got[c].q3] == [3000, *np.quantile(x, [0.25, 0.5, 0.75])]
