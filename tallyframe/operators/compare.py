"""Comparing means: t-tests, one-way ANOVA, Tukey-Kramer, Brown-Forsythe.

Data are reduced to one row, or one row a group, by distributed aggregation;
everything after that is arithmetic on those rows.  Nulls are dropped; with
``missing="zero"`` a null measurement counts as 0.  A guard that fails gives a
row whose statistics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.special import f_p, t_p, t_quantile, tukey_p, tukey_quantile
from tallyframe.operators.describe import quantiles


def measured(column: str, missing: str = "drop") -> Column:
    x = F.col(column).cast("double")
    if missing == "zero":
        return F.coalesce(x, F.lit(0.0))
    if missing != "drop":
        raise ValueError("missing is 'drop' or 'zero'")
    return x


def _t_row(out: DataFrame, *more: str) -> DataFrame:
    """From n, df, diff, se and effect: t, p and the 95 % interval."""
    ok = F.col("se") > 0
    out = out.withColumn("t", F.when(ok, F.col("diff") / F.when(ok, F.col("se"))))
    out = out.withColumn("p", t_p("t", "df")).withColumn("reach", t_quantile("df") * F.when(ok, F.col("se")))
    return out.select(*more, "diff", "t", "df", "p", (F.col("diff") - F.col("reach")).alias("ci_low"), (F.col("diff") + F.col("reach")).alias("ci_high"), "effect")


def ttest_one(df: DataFrame, column: str, mu: float, missing: str = "drop") -> DataFrame:
    """One-sample t-test against ``mu``; the effect is Cohen's d."""
    x = measured(column, missing)
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    out = out.select("n", "mean", "sd", (F.col("mean") - mu).alias("diff"), (sd / F.sqrt("n")).alias("se"), (F.col("n") - 1).cast("double").alias("df"), ((F.col("mean") - mu) / sd).alias("effect"))
    return _t_row(out, "n", "mean", "sd")


def ttest_paired(df: DataFrame, first: str, second: str, missing: str = "drop") -> DataFrame:
    """Paired t-test of ``first - second`` over complete pairs; the effect is dz."""
    d = df.select((measured(first, missing) - measured(second, missing)).alias("d"))
    return ttest_one(d, "d", 0.0)


def ttest_welch(df: DataFrame, value: str, group: str, level_order: str = "value", row_order: str | None = None, missing: str = "drop") -> DataFrame:
    """Welch's t-test between two groups; the effect is Hedges' g.

    The difference is the first level minus the second: by value, or with
    ``level_order="first_seen"`` by the smallest ``row_order`` of each.
    """
    x = measured(value, missing)
    first = F.min(F.col(row_order)) if level_order == "first_seen" and row_order else F.min(F.col(group).cast("string"))
    groups = df.filter(F.col(group).isNotNull() & (F.trim(F.col(group).cast("string")) != "")).groupBy(F.col(group).cast("string").alias("level"))
    g = groups.agg(first.alias("o"), F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).agg(F.array_sort(F.collect_list(F.struct("o", "level", "n", "m", "v"))).alias("g"))
    # Two levels are asked for: one list of level rows.
    g = g.filter(F.size("g") == 2).select(*[F.col("g")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in ("level", "n", "m", "v")]).filter("n1 >= 2 AND n2 >= 2")
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (n - 2))
    diff = F.col("m1") - F.col("m2")
    some = (a + b) > 0
    out = g.select(
        "level1", "n1", F.col("m1").alias("mean1"), F.sqrt("v1").alias("sd1"), "level2", "n2", F.col("m2").alias("mean2"), F.sqrt("v2").alias("sd2"), diff.alias("diff"), F.sqrt(a + b).alias("se"),
        F.when(some, (a + b) * (a + b) / F.when(some, a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"), F.when(pooled > 0, (1 - 3 / (4 * n - 9)) * diff / F.when(pooled > 0, pooled)).alias("effect"),
    )
    return _t_row(out, "level1", "n1", "mean1", "sd1", "level2", "n2", "mean2", "sd2")


def group_rows(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    """level, n, mean, var for each group with a value."""
    x = measured(value, missing)
    rows = df.select(F.col(group).cast("string").alias("level"), x.alias("x")).filter("level IS NOT NULL AND trim(level) <> '' AND x IS NOT NULL")
    return rows.groupBy("level").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def one_way(groups: DataFrame, least_groups: int = 3) -> DataFrame:
    """One-way F from group rows, with eta and omega squared; no row unless every group has two values."""
    total = Window.partitionBy()  # a row a group
    g = groups.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(total) / F.sum("n").over(total))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("n").alias("least"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"))
    s = s.filter((F.col("k") >= least_groups) & (F.col("least") >= 2) & (F.col("ss_within") > 0) & (F.col("n") > F.col("k")))
    s = s.withColumns({"df_between": (F.col("k") - 1).cast("double"), "df_within": (F.col("n") - F.col("k")).cast("double")})
    s = s.withColumns({"ms_between": F.col("ss_between") / F.col("df_between"), "ms_within": F.col("ss_within") / F.col("df_within")})
    s = s.withColumns({"f": F.col("ms_between") / F.col("ms_within"), "ss_total": F.col("ss_between") + F.col("ss_within")})
    s = s.withColumns({"eta_squared": F.col("ss_between") / F.col("ss_total"), "omega_squared": (F.col("ss_between") - F.col("df_between") * F.col("ms_within")) / (F.col("ss_total") + F.col("ms_within"))})
    return s.select("k", "n", "ss_between", "ss_within", "df_between", "df_within", "ms_between", "ms_within", "f", f_p("f", "df_between", "df_within").alias("p"), "eta_squared", "omega_squared")


def anova(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    return one_way(group_rows(df, value, group, missing))


def anova_groups(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    """level, n, mean, sd and the 95 % interval of each group's mean."""
    g = group_rows(df, value, group, missing).withColumn("reach", t_quantile((F.col("n") - 1).cast("double")) * F.sqrt(F.col("var") / F.col("n")))
    return g.select("level", "n", "mean", F.sqrt("var").alias("sd"), (F.col("mean") - F.col("reach")).alias("ci_low"), (F.col("mean") + F.col("reach")).alias("ci_high"))


def brown_forsythe(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    """One-way F on distances from group medians.  The medians are a small table, joined back."""
    x = measured(value, missing)
    rows = df.select(F.col(group).cast("string").alias("level"), x.alias("x")).filter("level IS NOT NULL AND trim(level) <> '' AND x IS NOT NULL")
    medians = quantiles(rows, ["level"], "x", [0.5]).select("level", F.col("q")[0].alias("median"))
    away = rows.join(medians, "level").select("level", F.abs(F.col("x") - F.col("median")).alias("d"))
    return one_way(group_rows(away, "d", "level"), 2).select("k", "n", "df_between", "df_within", "f", "p")


def tukey(df: DataFrame, value: str, group: str, missing: str = "drop") -> DataFrame:
    """Tukey-Kramer comparisons of all pairs of groups."""
    g = group_rows(df, value, group, missing)
    fit = one_way(g).select("k", "df_within", "ms_within")
    a, b = (g.select(*[F.col(c).alias(f"{c}{i}") for c in ("level", "n", "mean")]) for i in (1, 2))
    # Pairs of groups, not of rows; the fit is one row.
    pairs = a.join(b, F.col("level1") < F.col("level2")).crossJoin(F.broadcast(fit))
    se, diff = F.sqrt(F.col("ms_within") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))), F.col("mean1") - F.col("mean2")
    pairs = pairs.select("level1", "level2", diff.alias("diff"), se.alias("se"), (F.abs(diff) / se).alias("q"), "k", "df_within")
    pairs = pairs.withColumns({"p": tukey_p("q", "k", "df_within"), "reach": tukey_quantile("k", "df_within") * F.col("se")})
    return pairs.select("level1", "level2", "diff", "q", "p", (F.col("diff") - F.col("reach")).alias("ci_low"), (F.col("diff") + F.col("reach")).alias("ci_high"), (F.col("p") < 0.05).alias("significant"))


def p_text(p: float) -> str:
    return "n/a" if p is None or p != p else "< .001" if p < 0.001 else f"{p:.3f}"


def verdict(p: float) -> str:
    if p is None or p != p:
        return "No test could be made."
    return "Statistically significant at the 5 % level." if p < 0.05 else "Not statistically significant at the 5 % level."
