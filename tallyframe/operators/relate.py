"""Relations between variables: correlation, contingency tables, linear regression."""

from __future__ import annotations

from itertools import combinations
from math import atanh, sqrt, tanh

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.special import chi2_p, f_tail, t_critical, t_p, t_two_sided
from tallyframe.operators.compare import measured
from tallyframe.operators.describe import ordered_counts, ordered_sums
from tallyframe.shared import kept

#: Fixed value: the normal quantile that Fisher intervals use.
Z95 = 1.959964


def complete(df: DataFrame, a: str, b: str, missing: str = "drop") -> DataFrame:
    if a == b:
        raise ValueError("choose two different variables")
    return df.select(measured(a, missing).alias("x"), measured(b, missing).alias("y")).dropna()


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate").when(size < 0.7, "strong").when(size >= 0.7, "very strong")


def _correlation(out: DataFrame, interval: bool) -> DataFrame:
    """From one row of n, vx, vy (spreads) and r."""
    r = F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))))
    out = out.select("n", r.alias("r"), (F.col("n") - 2).cast("double").alias("df"))
    inside = F.abs("r") < 1
    out = out.withColumn("t", F.when(inside, F.col("r") * F.sqrt(F.col("df") / F.when(inside, 1 - F.col("r") * F.col("r")))))
    out = out.withColumn("p", F.when(F.col("r").isNotNull() & ~inside, 0.0).otherwise(t_p("t", "df")))
    columns = ["n", "r", "t", "df", "p"]
    if interval:
        at, reach = F.atanh(F.when(inside & (F.col("n") > 3), F.col("r"))), Z95 / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3))
        out = out.withColumns({"ci_low": F.when(~inside, F.col("r")).otherwise(F.tanh(at - reach)), "ci_high": F.when(~inside, F.col("r")).otherwise(F.tanh(at + reach))})
        columns += ["ci_low", "ci_high"]
    return out.select(*columns, strength(F.col("r")).alias("strength"), F.when(F.col("r") >= 0, "positive").when(F.col("r") < 0, "negative").alias("sign"))


def pearson(df: DataFrame, a: str, b: str, missing: str = "drop") -> DataFrame:
    """r, t, p, Fisher interval and a label; null where a variable has no spread or pairs are under three."""
    pairs = complete(df, a, b, missing)
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    some = (F.col("vx") > 0) & (F.col("vy") > 0)
    return _correlation(sums.withColumn("r", F.when(some, F.col("vxy") / F.sqrt(F.when(some, F.col("vx") * F.col("vy"))))), True)


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value."""
    return ordered_counts(values, column).select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, missing: str = "drop") -> DataFrame:
    """Pearson's r of average ranks; ranks come from counts of values, and equal pairs are counted before they meet them."""
    both = complete(df, a, b, missing)
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    rx, ry = average_ranks(both, "x").withColumnsRenamed({"value": "x", "rank": "rx"}), average_ranks(both, "y").withColumnsRenamed({"value": "y", "rank": "ry"})
    size = F.broadcast(both.agg(F.count(F.lit(1)).alias("n")))  # one row
    ranked = pairs.join(rx, "x").join(ry, "y").crossJoin(size)
    u, v, w = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2, F.col("w")
    sums = ranked.agg(F.sum(w).alias("n"), F.sum(w * u * u).alias("vx"), F.sum(w * v * v).alias("vy"), F.sum(w * u * v).alias("uv"))
    some = (F.col("vx") > 0) & (F.col("vy") > 0)
    return _correlation(sums.withColumn("r", F.when(some, F.col("uv") / F.sqrt(F.when(some, F.col("vx") * F.col("vy"))))), False)


def observed_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """row, column, n of the cells that have rows; rows with a blank are left out."""
    x, y = (F.trim(F.col(c).cast("string")) for c in (a, b))
    rows = df.select(x.alias("row"), y.alias("column")).filter("row IS NOT NULL AND row <> '' AND column IS NOT NULL AND column <> ''")
    return rows.groupBy("row", "column").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """row, column, observed, expected of every cell, empty cells included, as the feature shows them."""
    counts = observed_cells(df, a, b)
    rows, columns = counts.groupBy("row").agg(F.sum("n").alias("row_n")), counts.groupBy("column").agg(F.sum("n").alias("column_n"))
    # Margins, one row a category, not data rows.
    cells = rows.crossJoin(columns).join(counts, ["row", "column"], "left").withColumn("observed", F.coalesce("n", F.lit(0)))
    return cells.withColumn("expected", F.col("row_n") * F.col("column_n") / F.sum("observed").over(Window.partitionBy())).select("row", "column", F.col("observed").cast("long").alias("observed"), "expected")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's chi-square without correction, Cramer's V, and how small the expected counts are.

    Empty cells are never made: together they expect what the observed ones don't, and
    add just that to the statistic.  The smallest expected count is that of the two
    smallest margins, and how many are under 5 comes from one sweep over both
    sorted margins, each row's asking how many columns' lie below its threshold.
    """
    if a == b:
        raise ValueError("choose two different variables")
    counts = kept(observed_cells(df, a, b), "cells")
    rows, columns = counts.groupBy("row").agg(F.sum("n").alias("row_n")), counts.groupBy("column").agg(F.sum("n").alias("column_n"))
    total = counts.agg(F.sum("n").alias("n"))
    about = total.crossJoin(rows.agg(F.count(F.lit(1)).alias("rows"), F.min("row_n").alias("least_row"))).crossJoin(columns.agg(F.count(F.lit(1)).alias("columns"), F.min("column_n").alias("least_column")))  # single rows
    expected = F.col("row_n") * F.col("column_n") / F.col("total")
    seen = counts.join(rows, "row").join(columns, "column").crossJoin(F.broadcast(total.withColumnRenamed("n", "total"))).withColumn("expected", expected)
    seen = seen.agg(F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("off"), F.sum("expected").alias("in_seen"))
    asked = rows.crossJoin(F.broadcast(total)).select(F.expr("(5 * n + row_n - 1) div row_n").alias("v"), F.lit(0).alias("m"), F.lit(1).alias("w"))
    margins = columns.select(F.col("column_n").alias("v"), F.lit(1).alias("m"), F.lit(0).alias("w")).unionByName(asked).groupBy("v").agg(F.sum("m").alias("m"), F.sum("w").alias("w"))
    small = ordered_sums(margins, "v", "m").agg(F.sum(F.col("w") * F.col("before")).alias("small"))
    s = about.crossJoin(seen).crossJoin(small).filter("rows >= 2 AND columns >= 2")
    s = s.withColumns({
        "chi2": F.col("off") + F.greatest(F.lit(0.0), F.col("n") - F.col("in_seen")), "df": ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("double"),
        "min_expected": F.col("least_row") * F.col("least_column") / F.col("n"), "pct_expected_lt_5": 100.0 * F.col("small") / (F.col("rows") * F.col("columns")),
    })
    v = F.sqrt(F.col("chi2") / F.col("n") / (F.least("rows", "columns") - 1))
    return s.select("n", "rows", "columns", "chi2", "df", chi2_p("chi2", "df").alias("p"), v.alias("cramers_v"), "min_expected", "pct_expected_lt_5", ((F.col("pct_expected_lt_5") > 20) | (F.col("min_expected") < 1)).alias("warning"))


def crosstab_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """The observed counts as a table, one column a category of ``b``."""
    return crosstab(df, a, b).groupBy("row").pivot("column").sum("observed")


def ols_fit(df: DataFrame, outcome: str, predictors: list[str], missing: str = "drop") -> dict:
    """Least squares over complete rows, from the centred cross-products: two passes of aggregation.

    Only the (k + 1) x (k + 1) sums reach the driver.  Raises ValueError where a
    guard fails (too few rows, no spread, singular predictors).
    """
    names = [p for p in dict.fromkeys(predictors) if p != outcome]
    k = len(names)
    if not k:
        raise ValueError("choose at least one predictor other than the outcome")
    rows = df.select(*[measured(c, missing).alias(f"v{i}") for i, c in enumerate([outcome, *names])]).dropna()
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f"v{i}") for i in range(k + 1)]).first()
    n, means = first[0], np.array(first[1:], dtype=float)
    if n < k + 2:
        raise ValueError("too few complete rows")
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.agg(*[F.sum((F.col(f"v{i}") - means[i]) * (F.col(f"v{j}") - means[j])) for i, j in at]).first()
    s = np.zeros((k + 1, k + 1))
    for (i, j), value in zip(at, sums, strict=True):
        s[i, j] = s[j, i] = value
    if not s[0, 0] > 0:
        raise ValueError("the outcome has no spread")
    sxx, sxy = s[1:, 1:], s[1:, 0]
    spread = np.sqrt(np.diag(sxx))
    if (spread == 0).any() or np.linalg.matrix_rank(sxx / np.outer(spread, spread), tol=1e-12) < k:
        raise ValueError("the predictors are singular")
    inverse = np.linalg.inv(sxx)
    b = inverse @ sxy
    b0 = means[0] - means[1:] @ b
    sse, df_resid = float(s[0, 0] - b @ sxy), n - k - 1
    mse = sse / df_resid
    se = np.sqrt(np.append(mse * (1 / n + means[1:] @ inverse @ means[1:]), mse * np.diag(inverse)))
    crit, r2 = t_critical(float(df_resid)), 1 - sse / s[0, 0]
    f = ((s[0, 0] - sse) / k) / mse if mse > 0 else float("inf")
    correlation = sxx / np.outer(spread, spread)
    worst = max((abs(correlation[i, j]) for i, j in combinations(range(k), 2)), default=0.0)
    coefficients = [
        {"term": term, "b": float(v), "se": float(e), "t": float(v / e) if e else float("nan"), "p": float(t_two_sided(v / e, df_resid)) if e else float("nan"), "ci_low": float(v - crit * e), "ci_high": float(v + crit * e)}
        for term, v, e in zip(["Intercept", *names], [b0, *b], se, strict=True)
    ]
    return {
        "n": n, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df_resid, "rmse": sqrt(mse), "f": f, "df1": k, "df2": df_resid, "f_p": f_tail(f, k, df_resid), "coefficients": coefficients,
        "max_predictor_r": worst, "collinearity": "near-collinear" if worst >= 0.995 else "high" if worst >= 0.9 else "none",
        "equation": f"{outcome} = {b0:.4g}" + "".join(f" {'+' if v >= 0 else '-'} {abs(v):.4g}·{c}" for c, v in zip(names, b, strict=True)),
    }


COEFFICIENTS = "term string, b double, se double, t double, p double, ci_low double, ci_high double"


def ols_coefficients(df: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    rows = ols_fit(df, outcome, predictors)["coefficients"]
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], COEFFICIENTS)


def ols_summary(df: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    fit = ols_fit(df, outcome, predictors)
    return df.sparkSession.createDataFrame([tuple(float(fit[c]) if c != "n" else fit[c] for c in ("n", "r2", "adj_r2", "rmse", "f", "df1", "df2", "f_p", "max_predictor_r"))], "n long, r2 double, adj_r2 double, rmse double, f double, df1 double, df2 double, f_p double, max_predictor_r double")


def ols_residuals(df: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    """The complete rows with ``fitted`` and ``residual``: what a residual plot shows."""
    terms = {r["term"]: r["b"] for r in ols_fit(df, outcome, predictors)["coefficients"]}
    names = [c for c in terms if c != "Intercept"]
    fitted = sum((F.col(c).cast("double") * terms[c] for c in names), F.lit(terms["Intercept"]))
    return df.dropna(subset=[outcome, *names]).select("*", fitted.alias("fitted"), (F.col(outcome).cast("double") - fitted).alias("residual"))


def fisher_interval(r: float, n: int) -> tuple[float, float] | None:
    if abs(r) >= 1:
        return (r, r)
    return (tanh(atanh(r) - Z95 / sqrt(n - 3)), tanh(atanh(r) + Z95 / sqrt(n - 3))) if n > 3 else None
