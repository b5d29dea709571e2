"""Diagnostics beside the tests, stratified folds, fitted models and the report's lines."""

import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import diagnostics
from tallyframe.operators.association import associations
from tallyframe.operators.features import stratified_folds
from tallyframe.plans.policies import BINARY, MULTICLASS
from tallyframe.plans.report import executive_report, report_table
from tallyframe.plans.routes import execute
from tallyframe.sources.tables import demo


def test_residuals_of_each_test(spark):
    df = demo(spark).withColumns({c: F.col(c).cast("double") for c in ("Score", "Age", "Pre", "Post")})
    assert len(df.columns) == 7 and df.count() == 12
    rows = df.collect()
    means = {g: statistics.mean(r.Score for r in rows if r.Group == g) for g in "ABC"}
    got = sorted(r.residual for r in diagnostics.group_residuals(df, "Score", "Group").collect())
    assert got == pytest.approx(sorted(r.Score - means[r.Group] for r in rows))
    for shape, points in (diagnostics.one_sample(df, "Score"), diagnostics.pairs(df, "Post", "Pre"), diagnostics.groups(df, "Score", "Group"), diagnostics.regression(df, "Score", ["Age"])):
        assert shape.first()["n"] == 12 and points.count() == 12
    both = diagnostics.welch(df, "Score", "Source").first()
    assert both["n1"] == both["n2"] == 6 and 0 <= both["spread_p"] <= 1 and both["p"] < 0.2


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(int(i % 20 == 0), i % 7) for i in range(400)], "y int, x int").withColumn("_key", F.xxhash64("y", "x"))
    folds = stratified_folds(rows, "y", ["_key"], 5, 1)
    assert {tuple(r) for r in folds.groupBy("y", "_fold").count().collect()} == {(y, f, n) for y, n in ((0, 76), (1, 4)) for f in range(5)}


def test_fitted_models_score_new_rows(spark):
    rows = spark.createDataFrame([(float(i % 40), "ab"[i % 2], int(i % 40 > 19), "xyz"[i % 40 // 14]) for i in range(160)], "v double, c string, t int, k string")
    new = spark.createDataFrame([(1.0, "a"), (39.0, "b"), (None, None)], "v double, c string")
    result, artifacts = execute(rows.drop("k"), "binary classification", "t", mode=" Fast ", policy=replace(BINARY, trees=3, folds=2, inner_folds=2))
    scored = artifacts["fitted"].score(new).collect()
    assert result["analysis_type"] == "binary" and [r.prediction for r in scored[:2]] == [0, 1] and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in scored)
    _, artifacts = execute(rows.drop("t"), "multiclass classification", "k", policy=replace(MULTICLASS, trees=2, folds=2))
    assert [r.prediction for r in artifacts["fitted"].score(new).collect()[:2]] == ["x", "z"]


def test_segments_are_described_by_raw_fields(spark):
    rows = spark.createDataFrame([(float(i % 2 * 100 + i % 5), None if i % 4 == 0 else float(i % 2 * 50 + i % 3)) for i in range(60)], "a double, b double")
    _, artifacts = execute(rows, "segmentation")
    assert artifacts["segments"].filter("b IS NULL").count() == 15
    means = {(r.segment, r.field): r["mean"] for r in artifacts["profile"].filter("side = 'high'").collect()}
    raw = {(r.segment, "b"): r["m"] for r in artifacts["segments"].groupBy("segment").agg(F.avg("b").alias("m")).collect()}
    assert all(means[k] == pytest.approx(v) for k, v in raw.items() if k in means)


def test_pairs_without_effect_score_nothing(spark):
    rows = spark.createDataFrame([(float(i), 1.0 if i else 1.0, float(i % 3)) for i in range(30)], "a double, b double, c double").withColumn("b", F.when(F.col("a") < 1, F.lit(None)).otherwise(F.col("b")))
    found = associations(rows).collect()
    scores = [r.evidence_score for r in found]
    assert None not in scores and scores == sorted(scores, reverse=True)


def test_report_is_one_table(spark):
    result = {"route": "association", "evidence": {"tests_run": 3, "mean_confidence": 0.5, "ok": True}, "method": {"a_b": 1.5}, "findings": ["plain"], "warnings": ["careful"]}
    lines = report_table(spark, result).orderBy("position").collect()
    assert [(r.section, r.label, r.value) for r in lines if r.section in ("method", "evidence")] == [("method", "A B", "1.5000"), ("evidence", "Tests run", "3"), ("evidence", "Mean confidence", "50.0%"), ("evidence", "Ok", "Yes")]
    report = executive_report(result)
    assert report["findings"] == [{"title": "plain", "subtitle": None}] and report["text"].endswith("• careful")
