"""Folds within folds are dealt from written rows, so the source isn't read anew for each deal."""

from pyspark.sql import functions as F

from tallyframe.operators import models
from tallyframe.operators.features import stratified_folds
from tallyframe.plans.policies import Boosting
from tallyframe.shared import kept

POLICY = Boosting(trees=2, depth=2, folds=5, inner_folds=3)


def test_reads_of_a_deal_do_not_double_with_each(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 7).alias("a"), (F.col("id") * 0.5).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("two"))
    reads = {}

    def counted(df, label, path=None):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        reads[label] = plan.count("Relation") + plan.count("Range (")
        return kept(df, label, path)

    monkeypatch.setattr(models, "kept", counted)
    oof, _ = models.binary_models(rows, "two", POLICY)
    assert oof.count() == 400 and reads["binary"] <= POLICY.folds + 1 and max(reads.values()) <= POLICY.folds + 1


def test_deals_are_the_same_from_a_written_table(spark):
    rows = kept(spark.range(500).select((F.col("id") % 2).alias("y"), F.xxhash64("id").alias("_key")), "test-deals")
    one, other = (stratified_folds(rows, "y", ["_key"], 5, 42, counted=c).orderBy("_key").collect() for c in (None, rows))
    assert one == other and len({r["_fold"] for r in one}) == 5
