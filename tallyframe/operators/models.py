"""Supervised routes: boosted trees with out-of-fold evidence.

Folds are dealt by hashes of the rows, so they are the same in every run; for
classes they are stratified.  A model for an outer fold never sees the fold.
All models of a route, those of outer and inner folds and the one of all rows
that scores new ones, grow together (``boosting.grow``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.boosting import Fit, Model, grow
from tallyframe.operators.features import class_labels, derived_fields, fold, interactions, log_features, model_features, stratified_folds
from tallyframe.plans.policies import BINARY, MULTICLASS, REGRESSION, Boosting
from tallyframe.shared import kept


@dataclass
class Fitted:
    """A model of all rows: ``score`` adds its predictions to a table with the same columns."""

    kind: str
    target: str
    features: list[str]
    labels: list
    prepare: Callable[[DataFrame], DataFrame]
    model: Model
    threshold: float | None = None
    calibrator: object = None

    def score(self, df: DataFrame) -> DataFrame:
        """For numbers ``prediction``; for classes ``probabilities`` by class number and ``prediction``, a label."""
        rows = self.model.scored(self.prepare(df.drop(self.target)))
        if self.kind == "regression":
            return rows.withColumn("prediction", F.col("answers")[0]).drop("answers")
        if self.kind == "binary":
            one = self.calibrator.transform(rows.withColumn("_score", F.col("answers")[0]))
            rows = one.withColumn("probabilities", F.array(1 - F.col("_calibrated"), F.col("_calibrated"))).drop("_score", "_calibrated", "answers")
            number = F.when(F.col("probabilities")[1] >= self.threshold, 1).otherwise(0)
        else:
            rows = rows.withColumn("probabilities", clipped(F.col("answers"))).drop("answers")
            number = hardest("probabilities")
        return rows.withColumn("prediction", F.get(F.array(*[F.lit(v) for v in self.labels]), number))


def clipped(p: Column) -> Column:
    """Chances of at least 1e-12 that sum to one."""
    some = F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)))
    return F.transform(some, lambda x: x / F.aggregate(some, F.lit(0.0), lambda a, b: a + b))


def hardest(probabilities: str) -> Column:
    """The number of the likeliest class, the first of several."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1


def _numbered(rows: DataFrame, label: str) -> DataFrame:
    """The rows written, each with a number of its own: trees draw rows by it."""
    return kept(rows.withColumn("_row", F.monotonically_increasing_id()), label)


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the row's hash as ``_key``: what folds are dealt by."""
    return df.withColumn("_key", F.xxhash64(*df.columns))


def _prepared(df: DataFrame) -> DataFrame:
    return interactions(derived_fields(df))


def regression_models(df: DataFrame, target: str, policy: Boosting = REGRESSION) -> tuple[DataFrame, Fitted]:
    """(_key, y and out-of-fold prediction of every row whose target is a number), and the model of all of them."""
    rows = log_features(_prepared(df.withColumn("_y", F.col(target).try_cast("double")).filter("_y IS NOT NULL").drop(target)))
    logs = [c.removesuffix("__log1p") for c in rows.columns if c.endswith("__log1p")]
    rows = _numbered(_keyed(rows).withColumn("_fold", fold(["_key"], policy.folds, policy.seed)), "regression")
    features = model_features(rows, "_y")
    grown = grow(rows, features, "regression", policy, [*map(Fit, range(policy.folds)), Fit()], folds=["_fold"])
    oof = grown.held_out(df.sparkSession, list(range(policy.folds))).select("_key", "y", F.col("answers")[0].alias("prediction"))

    def prepare(new: DataFrame) -> DataFrame:
        return _prepared(new).withColumns({f"{c}__log1p": F.log1p(F.col(c).cast("double")) for c in logs})

    return oof, Fitted("regression", target, features, [], prepare, grown.model(policy.folds))


def _classified(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    labels = class_labels(df, target)
    rows = df.filter(F.col(target).isNotNull())
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target)).cast("double") - 1
    return _prepared(rows.withColumn("_y", number).drop(target)), labels


def isotonic(scored: DataFrame):
    """A calibrator fitted to (score, y): it adds ``_calibrated`` to tables that have ``_score``."""
    return IsotonicRegression(featuresCol="_score", labelCol="y", predictionCol="_calibrated").fit(scored.select(F.col("score").alias("_score"), "y"))


def binary_models(df: DataFrame, target: str, policy: Boosting = BINARY) -> tuple[DataFrame, Fitted]:
    """(_key, y, uncalibrated, score and prediction out of fold of every labelled row), and the model of all of them.

    The larger class value is 1.  For each outer fold the scores of its inner folds
    fit an isotonic calibrator, which then maps the scores of the outer fold's
    model.  The model of all rows has a calibrator fitted to all outer folds' scores.
    """
    rows, labels = _classified(df, target)
    if len(labels) != 2:
        raise ValueError(f"a binary target has two values, not {len(labels)}")
    folds = range(policy.folds)
    rows = outer = kept(stratified_folds(kept(_keyed(rows), "keyed"), "_y", ["_key"], policy.folds, policy.seed), "outer")
    for i in folds:  # rows of the outer fold itself are numbered apart, and not used
        stratum = F.col("_y") + F.when(F.col("_fold") == i, 2).otherwise(0)
        rows = stratified_folds(rows.withColumn("_stratum", stratum), "_stratum", ["_key"], policy.inner_folds, 101 + i, name=f"_inner{i}", counted=outer.withColumn("_stratum", stratum)).drop("_stratum")
    rows = _numbered(rows, "binary")
    features = model_features(rows, "_y")
    fits = [*map(Fit, folds), *[Fit(i, j) for i in folds for j in range(policy.inner_folds)], Fit()]
    grown = grow(rows, features, "binary", policy, fits, 2, ["_fold", *[f"_inner{i}" for i in folds]])
    scores = grown.held_out(df.sparkSession, list(range(len(fits) - 1))).select("_key", "y", "fit", F.col("answers")[0].alias("score"))
    scores = kept(scores, "scores")
    parts = []
    for i in folds:
        first = policy.folds + i * policy.inner_folds
        calibrator = isotonic(scores.filter(F.col("fit").between(first, first + policy.inner_folds - 1)))
        parts.append(calibrator.transform(scores.filter(F.col("fit") == i).withColumn("_score", F.col("score"))))
    oof = reduce(DataFrame.unionByName, parts)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated")))
    oof = oof.select("_key", F.col("y").cast("int").alias("y"), F.col("score").alias("uncalibrated"), score.alias("score"))
    oof = oof.withColumn("prediction", (F.col("score") >= policy.threshold).cast("int"))
    final = isotonic(scores.filter(F.col("fit") < policy.folds))
    return oof, Fitted("binary", target, features, labels, _prepared, grown.model(len(fits) - 1), policy.threshold, final)


def multiclass_models(df: DataFrame, target: str, policy: Boosting = MULTICLASS) -> tuple[DataFrame, Fitted]:
    """(_key, y, probabilities and prediction out of fold, by class number), and the model of all rows: one softmax of all classes."""
    rows, labels = _classified(df, target)
    if len(labels) < 3:
        raise ValueError(f"a multiclass target has three values or more, not {len(labels)}")
    rows = _numbered(stratified_folds(_keyed(rows), "_y", ["_key"], policy.folds, policy.seed), "multiclass")
    features = model_features(rows, "_y")
    grown = grow(rows, features, "multiclass", policy, [*map(Fit, range(policy.folds)), Fit()], len(labels), ["_fold"])
    oof = grown.held_out(df.sparkSession, list(range(policy.folds))).select("_key", F.col("y").cast("int").alias("y"), clipped(F.col("answers")).alias("probabilities"))
    oof = kept(oof, "scores")  # each measure reads it anew
    return oof.withColumn("prediction", hardest("probabilities")), Fitted("multiclass", target, features, labels, _prepared, grown.model(policy.folds))
