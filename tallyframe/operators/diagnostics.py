"""What is looked at beside a test: the shape and the Q-Q points of what its errors are.

Errors are deviations from the mean (one sample), from the groups' means pooled
(Welch, ANOVA), differences of pairs, or residuals of a regression.  Each
function returns (shape, points): one row of ``describe.shape`` and the rows of
``describe.qq_points``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.compare import brown_forsythe, group_rows, measured, ttest_welch
from tallyframe.operators.describe import qq_points, shape
from tallyframe.operators.relate import ols_residuals


def _looked_at(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    return shape(errors, ["residual"]), qq_points(errors, "residual")


def one_sample(df: DataFrame, value: str, missing: str = "drop") -> tuple[DataFrame, DataFrame]:
    return _looked_at(df.select(measured(value, missing).alias("residual")))


def pairs(df: DataFrame, first: str, second: str, missing: str = "drop") -> tuple[DataFrame, DataFrame]:
    return _looked_at(df.select((measured(first, missing) - measured(second, missing)).alias("residual")))


def group_residuals(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    """level and residual: each value less its group's mean.  The means, a row a group, are joined back."""
    rows = df.select(F.col(group).cast("string").alias("level"), measured(value, missing).alias("x")).filter("x IS NOT NULL")
    return rows.join(group_rows(df, value, group, missing).select("level", "mean"), "level").select("level", (F.col("x") - F.col("mean")).alias("residual"))


def groups(df: DataFrame, value: str, group: str, missing: str = "drop") -> tuple[DataFrame, DataFrame]:
    return _looked_at(group_residuals(df, value, group, missing))


def regression(df: DataFrame, outcome: str, predictors: list[str]) -> tuple[DataFrame, DataFrame]:
    return _looked_at(ols_residuals(df, outcome, predictors).select("residual"))


def welch(df: DataFrame, value: str, group: str, **more) -> DataFrame:
    """Welch's test with the Brown-Forsythe test of equal spread beside it (``spread_f``, ``spread_p``)."""
    spread = brown_forsythe(df, value, group, more.get("missing", "drop")).select(F.col("f").alias("spread_f"), F.col("p").alias("spread_p"))
    return ttest_welch(df, value, group, **more).join(F.broadcast(spread), how="left")  # one row each
