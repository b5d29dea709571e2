"""Registered queries over the test tables, and the same in DuckDB SQL.

Doubles are rounded on both sides, as sums in different orders differ in their
last digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.special import AS241
from tallyframe.operators import association, compare, describe, evaluate, features, models, profile, relate, segment
from tallyframe.plans.policies import BINARY, MULTICLASS, REGRESSION, SEGMENTATION
from tallyframe.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c.name, digits) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


def query(sql: str | None = None, digits: int = 6):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


def simpson(density: str, upper: str, n: int = 4000) -> str:
    """The integral from 0 to ``upper`` of a density in ``u``."""
    return (
        f"(({upper}) / {n} / 3 * list_sum(list_transform(range(0, {n + 1}), lambda i: "
        f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {re.sub(r'\bu\b', f'(i * ({upper}) / {n})', density)})))"
    )


def t_p_sql(t: str, df: str) -> str:
    c = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"greatest(0.0, 1 - 2 * {c} * {simpson(f'pow(1 + u * u / ({df}), -(({df}) + 1) / 2.0)', f'least(abs({t}), 60.0)')})"


def chi2_p_sql(x: str, df: str, root: bool = False) -> str:
    """The tail of chi-square; with ``root`` by quadrature over the root of x, whose density has a bound for one degree of freedom too."""
    if root:
        c = f"(2 * exp(-({df}) / 2.0 * ln(2.0) - lgamma(({df}) / 2.0)))"
        return f"greatest(0.0, 1 - {c} * {simpson(f'((CASE WHEN ({df}) = 1 THEN 1.0 ELSE pow(u, ({df}) - 1) END) * exp(-u * u / 2))', f'sqrt({x})')})"
    c = f"exp(-({df}) / 2.0 * ln(2.0) - lgamma(({df}) / 2.0))"
    return f"greatest(0.0, 1 - {c} * {simpson(f'(CASE WHEN u = 0 THEN (CASE WHEN ({df}) = 2 THEN 1.0 ELSE 0.0 END) ELSE pow(u, ({df}) / 2.0 - 1) * exp(-u / 2) END)', x)})"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    c = f"exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0) + ({d1}) / 2.0 * ln(CAST(({d1}) AS DOUBLE) / ({d2})))"
    return f"greatest(0.0, 1 - {c} * {simpson(f'(pow(u, ({d1}) / 2.0 - 1) * pow(1 + ({d1}) * u / ({d2}), -(({d1}) + ({d2})) / 2.0))', f)})"


def t_critical_sql(df: str) -> str:
    """The 97.5 % quantile of t, as a series in 1 / df that is right to ten digits from a thousand degrees on."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({z}" + "".join(f" + {c} / pow({df}, {i + 1})" for i, c in enumerate(terms)) + ")"


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STACK = "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem"


# --- descriptives -----------------------------------------------------------


@query(f"""SELECT variable, count(x) AS n, {r("avg(x)", "mean")}, {r("stddev_samp(x)", "sd")}, {r("min(x)", '"min"')}, {r("quantile_cont(x, 0.25)", "q1")}, {r("quantile_cont(x, 0.5)", "median")},
  {r("quantile_cont(x, 0.75)", "q3")}, {r("max(x)", '"max"')} FROM ({_STACK}) GROUP BY variable""")
def descriptives(spark, folder):
    return describe.describe(table(spark, folder, "lineitem"), NUMBERS)


@query(f"""SELECT o_orderpriority, 'o_totalprice' AS variable, count(*) AS n, {r("avg(o_totalprice)", "mean", 4)}, {r("stddev_samp(o_totalprice)", "sd", 4)}, {r("min(o_totalprice)", '"min"', 4)}, {r("quantile_cont(o_totalprice, 0.25)", "q1", 4)},
  {r("median(o_totalprice)", "median", 4)}, {r("quantile_cont(o_totalprice, 0.75)", "q3", 4)}, {r("max(o_totalprice)", '"max"', 4)} FROM orders GROUP BY 1""", 4)
def descriptives_by_group(spark, folder):
    return describe.describe(table(spark, folder, "orders"), ["o_totalprice"], ["o_orderpriority"])


@query(f"""SELECT variable, count(x) AS n, {r("skewness(x)", "skewness")}, {r("kurtosis(x)", "kurtosis")}, CASE WHEN count(x) < 8 THEN 'small sample' WHEN abs(skewness(x)) <= 1 AND abs(kurtosis(x)) <= 2 THEN 'no strong warning' ELSE 'warning' END AS normality
  FROM ({_STACK}) GROUP BY variable""")
def shape(spark, folder):
    return describe.shape(table(spark, folder, "lineitem"), NUMBERS)


@query(f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(14, greatest(5, ceil(sqrt(count(*)))))::INT AS k FROM orders), w AS (SELECT *, (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / k AS width FROM s),
  c AS (SELECT least(k - 1, floor((o_totalprice - lo) / width))::INT AS bin, count(*) AS n FROM orders, w GROUP BY 1), b AS (SELECT unnest(range(0, k))::INT AS bin, lo, width FROM w)
  SELECT bin, {r("lo + bin * width", "lower", 4)}, {r("lo + (bin + 1) * width", "upper", 4)}, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""", 4)
def histogram(spark, folder):
    return describe.histogram(table(spark, folder, "orders"), "o_totalprice")


@query(f"""SELECT CAST(row_number() OVER o AS INT) AS rank, value, n, {r("100.0 * n / sum(n) OVER ()", "percent", 1)}, {r("100.0 * sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()", "cumulative_percent", 1)}
  FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) WINDOW o AS (ORDER BY n DESC, value)""", 1)
def frequency(spark, folder):
    return describe.frequency(table(spark, folder, "orders"), "o_orderpriority")


@query("SELECT count(o_orderstatus) AS valid, count(*) - count(o_orderstatus) AS missing, count(DISTINCT o_orderstatus) AS \"distinct\" FROM orders")
def valid_counts(spark, folder):
    return describe.valid_counts(table(spark, folder, "orders"), "o_orderstatus")


@query(f"""SELECT CAST(o_orderpriority AS VARCHAR) AS level, count(*) AS n, {r("quantile_cont(o_totalprice, 0.25)", "q1", 4)}, {r("median(o_totalprice)", "median", 4)}, {r("quantile_cont(o_totalprice, 0.75)", "q3", 4)},
  {r("greatest(min(o_totalprice), quantile_cont(o_totalprice, 0.25) - 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)))", "whisker_low", 4)},
  {r("least(max(o_totalprice), quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)))", "whisker_high", 4)} FROM orders GROUP BY 1""", 4)
def boxplot(spark, folder):
    return describe.boxplot(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")


@query(f"""SELECT row_number() OVER (ORDER BY o_totalprice) AS rank, {r("o_totalprice", "observed", 4)} FROM orders""", 4)
def qq_ranks(spark, folder):
    return describe.qq_points(table(spark, folder, "orders"), "o_totalprice").select("rank", "observed")


def normal_quantile_sql(p: str) -> str:
    """The quantile of the normal distribution by the same published coefficients."""

    def ratio(r: str, part: int) -> str:
        return " / ".join("(" + reduce(lambda total, c: f"({total} * {r} + CAST({c!r} AS DOUBLE))", coefficients[1:], f"CAST({coefficients[0]!r} AS DOUBLE)") + ")" for coefficients in AS241[part])

    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))', 0)} "
        f"ELSE sign({p} - 0.5) * CASE WHEN {far} <= 5 THEN {ratio(f'({far} - 1.6)', 1)} ELSE {ratio(f'({far} - 5)', 2)} END END)"
    )


@query(f"""SELECT rank, {r("x", "observed")}, {r(normal_quantile_sql("p"), "theoretical")}
  FROM (SELECT x, rank, (rank - 0.5::DOUBLE) / n AS p FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS rank, count(*) OVER () AS n FROM orders))""")
def qq_points(spark, folder):
    return describe.qq_points(table(spark, folder, "orders"), "o_totalprice")


@query(f"""SELECT {r("avg(o_totalprice)", "intercept", 4)}, {r("stddev_samp(o_totalprice)", "slope", 4)} FROM orders""", 4)
def qq_line(spark, folder):
    return describe.qq_line(table(spark, folder, "orders"), "o_totalprice")


@query(f"""SELECT count(*) AS n, {r("regr_slope(l_extendedprice, l_quantity)", "slope", 4)}, {r("regr_intercept(l_extendedprice, l_quantity)", "intercept", 4)} FROM lineitem""", 4)
def scatter_fit(spark, folder):
    return describe.fit_line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


# --- metadata ---------------------------------------------------------------


_LOOKED_AT = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT n_rows, len(types)::BIGINT AS n_columns, len(list_filter(types, lambda t: t IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR t LIKE 'DECIMAL%'))::BIGINT AS numeric_columns, missing_cells::BIGINT AS missing_cells
  FROM (SELECT count(*) AS n_rows, [{", ".join(f"typeof(any_value({c}))" for c in _LOOKED_AT)}] AS types, {" + ".join(f"count(*) FILTER (coalesce(trim(CAST({c} AS VARCHAR)), '') = '')" for c in _LOOKED_AT)} AS missing_cells FROM lineitem)""")
def overview(spark, folder):
    return profile.overview(table(spark, folder, "lineitem").select(*_LOOKED_AT))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS missing FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def variable_table(spark, folder):
    return profile.variable_table(table(spark, folder, "customer"))


_WORDS = ", ".join(f"'{w}'" for w in profile.ORDINAL_VALUES)


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS name, '{c}' AS label, CASE WHEN x >= 0.9 * n THEN 'numeric' ELSE 'text' END AS storage, CASE WHEN x >= 0.9 * n THEN 'Scale' WHEN words = n THEN 'Ordinal' ELSE 'Nominal' END AS level
      FROM (SELECT count(*) AS n, count(try_cast(v AS DOUBLE)) AS x, count(*) FILTER (lower(v) IN ({_WORDS})) AS words FROM (SELECT trim(CAST({c} AS VARCHAR)) AS v FROM part) WHERE v <> '')"""
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def measurement_levels(spark, folder):
    return profile.variables_table(table(spark, folder, "part"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS field, '{t}' AS dtype, {role} AS role, {r(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct')}, count(DISTINCT {c}) AS n_unique, {r(f'count(DISTINCT {c}) / count(*)', 'unique_ratio')} FROM customer"
    for c, t, role in (("c_custkey", "bigint", "'numeric'"), ("c_name", "string", "'categorical'"), ("c_nationkey", "int", "'numeric'"), ("c_acctbal", "double", "'numeric'"), ("c_mktsegment", "string", "'categorical'"))))
def field_profile(spark, folder):
    return profile.field_profile(table(spark, folder, "customer"))


# --- comparing means --------------------------------------------------------


def _t_sql(base: str, more: str, digits: int, p_digits: int = 6) -> str:
    """From n, df, diff, se, effect: what a t-test returns."""
    interval = ", ".join(r(f"diff {sign} {t_critical_sql('df')} * se", name, digits) for sign, name in (("-", "ci_low"), ("+", "ci_high")))
    return f"SELECT {more}, {interval}, {r('diff', 'diff', digits)}, {r('diff / se', 't', digits)}, {r('df', 'df', digits)}, {r(t_p_sql('diff / se', 'df'), 'p', p_digits)}, {r('effect', 'effect', digits)} FROM ({base})"


@query(_t_sql("SELECT count(*) AS n, avg(o_totalprice) - 150000 AS diff, stddev_samp(o_totalprice) / sqrt(count(*)) AS se, count(*) - 1 AS df, (avg(o_totalprice) - 150000) / stddev_samp(o_totalprice) AS effect, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders", f"n, {r('mean', 'mean', 4)}, {r('sd', 'sd', 4)}", 4), 4)
def ttest_one(spark, folder):
    return compare.ttest_one(table(spark, folder, "orders"), "o_totalprice", 150_000.0).withColumn("p", F.round("p", 6))


@query(_t_sql("""SELECT l1, n1, l2, n2, m1, m2, sqrt(v1) AS s1, sqrt(v2) AS s2, m1 - m2 AS diff, sqrt(a + b) AS se, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df, (1 - 3.0 / (4 * (n1 + n2) - 9)) * (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect FROM (
  SELECT x.level AS l1, y.level AS l2, x.n AS n1, y.n AS n2, x.m AS m1, y.m AS m2, x.v AS v1, y.v AS v2, x.v / x.n AS a, y.v / y.n AS b FROM (SELECT l_linestatus AS level, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1) x
  JOIN (SELECT l_linestatus AS level, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1) y ON x.level < y.level)""", f"l1 AS level1, n1, l2 AS level2, n2, {r('m1', 'mean1', 4)}, {r('m2', 'mean2', 4)}, {r('s1', 'sd1', 4)}, {r('s2', 'sd2', 4)}", 4, 4), 4)
def ttest_welch(spark, folder):
    return compare.ttest_welch(table(spark, folder, "lineitem"), "l_extendedprice", "l_linestatus")


@query(_t_sql("SELECT count(*) AS n, avg(l_discount - l_tax) AS diff, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se, count(*) - 1 AS df, avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax) AS effect, avg(l_discount - l_tax) AS mean, stddev_samp(l_discount - l_tax) AS sd FROM lineitem", f"n, {r('mean', 'mean')}, {r('sd', 'sd')}", 6))
def ttest_paired(spark, folder):
    return compare.ttest_paired(table(spark, folder, "lineitem"), "l_discount", "l_tax")


_GROUPS = "SELECT o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1"


def _one_way_sql(groups: str, columns: str) -> str:
    return f"""WITH g AS ({groups}), t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS grand FROM g),
      s AS (SELECT any_value(t.k) AS k, any_value(t.n) AS n, sum(g.n * (m - grand) ** 2) AS ssb, sum((g.n - 1) * v) AS ssw FROM g, t),
      f AS (SELECT k, n, ssb, ssw, k - 1 AS d1, n - k AS d2, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssw / (n - k) AS msw FROM s) SELECT {columns} FROM f"""


@query(_one_way_sql(_GROUPS, f"""k, n, {r("d1", "df_between")}, {r("d2", "df_within")}, {r("f", "f")}, {r(f_p_sql("f", "d1", "d2"), "p")}, {r("ssb / (ssb + ssw)", "eta_squared")}, {r("(ssb - d1 * msw) / (ssb + ssw + msw)", "omega_squared")},
  {r("ssb", "ss_between", -3)}, {r("ssw", "ss_within", -3)}, {r("ssb / d1", "ms_between", -3)}, {r("msw", "ms_within", -3)}"""))
def anova(spark, folder):
    return compare.anova(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority").withColumns({c: F.round(c, -3) for c in ("ss_between", "ss_within", "ms_between", "ms_within")})


@query(f"""SELECT level, n, {r("m", "mean", 4)}, {r("sqrt(v)", "sd", 4)} FROM ({_GROUPS})""", 4)
def anova_groups(spark, folder):
    return compare.anova_groups(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority").drop("ci_low", "ci_high")


@query(f"""SELECT level, n, {r("m", "mean", 4)}, {r("sqrt(v)", "sd", 4)}, {r(f"m - {t_critical_sql('(n - 1)')} * sqrt(v / n)", "ci_low", 4)}, {r(f"m + {t_critical_sql('(n - 1)')} * sqrt(v / n)", "ci_high", 4)} FROM ({_GROUPS})""", 4)
def anova_group_intervals(spark, folder):
    return compare.anova_groups(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")


@query(_one_way_sql("SELECT level, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM (SELECT o_orderpriority AS level, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d FROM orders) GROUP BY 1",
                    f"""k, n, {r("d1", "df_between")}, {r("d2", "df_within")}, {r("f", "f")}, {r(f_p_sql("f", "d1", "d2"), "p")}"""))
def brown_forsythe(spark, folder):
    return compare.brown_forsythe(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")


@query(f"""WITH g AS ({_GROUPS}), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM g) SELECT a.level AS level1, b.level AS level2, {r("a.m - b.m", "diff", 4)}, {r("abs(a.m - b.m) / sqrt(msw / 2 * (1.0 / a.n + 1.0 / b.n))", "q", 4)}
  FROM g a JOIN g b ON a.level < b.level, w""", 4)
def tukey_differences(spark, folder):
    return compare.tukey(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority").select("level1", "level2", "diff", "q")


@query()
def tukey(spark, folder):
    return compare.tukey(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")


# --- relations --------------------------------------------------------------

_LABEL = "CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS sign"


@query(f"""SELECT n, {r("r", "r")}, {r("r * sqrt((n - 2) / (1 - r * r))", "t", 4)}, {r("n - 2", "df")}, {r(t_p_sql("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)"), "p")}, {r("tanh(atanh(r) - 1.959964 / sqrt(n - 3))", "ci_low")}, {r("tanh(atanh(r) + 1.959964 / sqrt(n - 3))", "ci_high")}, {_LABEL}
  FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)""")
def pearson(spark, folder):
    return relate.pearson(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice").withColumn("t", F.round("t", 4))


@query(f"""SELECT n, {r("r", "r")}, {r("r * sqrt((n - 2) / (1 - r * r))", "t", 4)}, {r("n - 2", "df")}, {r(t_p_sql("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)"), "p")}, {_LABEL} FROM (SELECT count(*) AS n, corr(a, b) AS r FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem))""")
def spearman(spark, folder):
    return relate.spearman(table(spark, folder, "lineitem"), "l_quantity", "l_discount").withColumn("t", F.round("t", 4))


_CELLS = """WITH c AS (SELECT o_orderstatus AS "row", o_orderpriority AS "column", count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT "row", sum(n) AS rn FROM c GROUP BY 1), y AS (SELECT "column", sum(n) AS cn FROM c GROUP BY 1),
  e AS (SELECT x."row", y."column", coalesce(c.n, 0)::BIGINT AS observed, rn * cn / (SELECT sum(n) FROM c)::DOUBLE AS expected FROM x CROSS JOIN y LEFT JOIN c ON c."row" = x."row" AND c."column" = y."column")"""


@query(f"""{_CELLS} SELECT "row", "column", observed, {r("expected", "expected")} FROM e""")
def chi_square_cells(spark, folder):
    return relate.crosstab(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""{_CELLS}, s AS (SELECT sum(observed)::BIGINT AS n, count(DISTINCT "row") AS "rows", count(DISTINCT "column") AS "columns", sum((observed - expected) ** 2 / expected) AS chi2, min(expected) AS lo, 100.0 * avg(CASE WHEN expected < 5 THEN 1.0 ELSE 0 END) AS pct FROM e)
  SELECT n, "rows", "columns", {r("chi2", "chi2")}, {r('("rows" - 1) * ("columns" - 1)', "df")}, {r(chi2_p_sql("chi2", '(("rows" - 1) * ("columns" - 1))'), "p")}, {r('sqrt(chi2 / n / (least("rows", "columns") - 1))', "cramers_v")}, {r("lo", "min_expected")}, {r("pct", "pct_expected_lt_5")}, (pct > 20 OR lo < 1) AS warning FROM s""")
def chi_square(spark, folder):
    return relate.chi_square(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""SELECT role, {", ".join(f"sum(CASE WHEN turn = {i} THEN 1 ELSE 0 END)::BIGINT AS t{i}" for i in range(8))} FROM conversations GROUP BY role""")
def crosstab_table(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("turn", F.concat(F.lit("t"), F.col("turn").cast("string")))
    both = relate.crosstab_table(turns, "role", "turn")
    names = sorted((c for c in both.columns if c != "row"), key=lambda c: int(c[1:]))
    roles = table(spark, folder, "conversations").select("role").distinct()
    return roles.join(both, F.col("role") == F.col("row"), "left").select("role", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


@query(f"""SELECT 'Intercept' AS term, {r("regr_intercept(l_extendedprice, l_quantity)", "b", 3)} FROM lineitem UNION ALL SELECT 'l_quantity', {r("regr_slope(l_extendedprice, l_quantity)", "b", 3)} FROM lineitem""", 3)
def ols_simple(spark, folder):
    return relate.ols_coefficients(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", "b")


_TWO = """WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
  s AS (SELECT any_value(n) AS n, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, sum((l_extendedprice - my) ** 2) AS yy, sum((l_quantity - m1) ** 2) AS s11, sum((l_discount - m2) ** 2) AS s22, sum((l_quantity - m1) * (l_discount - m2)) AS s12, sum((l_quantity - m1) * (l_extendedprice - my)) AS s1y, sum((l_discount - m2) * (l_extendedprice - my)) AS s2y FROM lineitem, m),
  b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s), f AS (SELECT *, yy - b1 * s1y - b2 * s2y AS sse FROM b)"""


@query(f"""{_TWO} SELECT 'Intercept' AS term, {r("my - b1 * m1 - b2 * m2", "b", 3)}, {r("sqrt(sse / (n - 3) * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12)))", "se", 3)} FROM f
  UNION ALL SELECT 'l_quantity', {r("b1", "b", 3)}, {r("sqrt(sse / (n - 3) * s22 / (s11 * s22 - s12 * s12))", "se", 3)} FROM f UNION ALL SELECT 'l_discount', {r("b2", "b", 3)}, {r("sqrt(sse / (n - 3) * s11 / (s11 * s22 - s12 * s12))", "se", 3)} FROM f""", 3)
def ols_multiple(spark, folder):
    return relate.ols_coefficients(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", "b", "se")


@query(f"""{_TWO}, q AS (SELECT *, (yy - sse) / 2 / (sse / (n - 3)) AS f FROM f) SELECT n, {r("1 - sse / yy", "r2")}, {r("1 - (sse / yy) * (n - 1) / (n - 3)", "adj_r2")}, {r("sqrt(sse / (n - 3))", "rmse", 4)}, {r("f", "f", 2)}, {r("2", "df1")}, {r("n - 3", "df2")},
  {r("pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0)", "f_p")}, {r("abs(s12) / sqrt(s11 * s22)", "max_predictor_r")} FROM q""")  # the tail of F with two degrees is a power
def ols_summary(spark, folder):
    return relate.ols_summary(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).withColumns({"rmse": F.round("rmse", 4), "f": F.round("f", 2)})


def _coefficient_sql(term: str, b: str, se: str) -> str:
    t = f"(({b}) / ({se}))"
    p = f"CASE WHEN abs({t}) > 40 THEN 0 ELSE {t_p_sql(t, '(n - 3)')} END"
    return f"SELECT '{term}' AS term, {r(b, 'b', 3)}, {r(se, 'se', 3)}, {r(t, 't', 3)}, {r(p, 'p', 3)}, {r(f'({b}) - {t_critical_sql("(n - 3)")} * ({se})', 'ci_low', 3)}, {r(f'({b}) + {t_critical_sql("(n - 3)")} * ({se})', 'ci_high', 3)} FROM f"


@query(_TWO + " " + " UNION ALL ".join((
    _coefficient_sql("Intercept", "my - b1 * m1 - b2 * m2", "sqrt(sse / (n - 3) * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12)))"),
    _coefficient_sql("l_quantity", "b1", "sqrt(sse / (n - 3) * s22 / (s11 * s22 - s12 * s12))"),
    _coefficient_sql("l_discount", "b2", "sqrt(sse / (n - 3) * s11 / (s11 * s22 - s12 * s12))"))), 3)
def ols_coefficient_tests(spark, folder):
    return relate.ols_coefficients(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query(f"""{_TWO} SELECT l_orderkey, l_linenumber, {r("l_extendedprice", "l_extendedprice", 3)}, {r("l_quantity", "l_quantity", 3)}, {r("l_discount", "l_discount", 3)}, {r("my + b1 * (l_quantity - m1) + b2 * (l_discount - m2)", "fitted", 3)},
  {r("l_extendedprice - (my + b1 * (l_quantity - m1) + b2 * (l_discount - m2))", "residual", 3)} FROM lineitem, f""", 3)
def ols_residuals(spark, folder):
    return relate.ols_residuals(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount"), "l_extendedprice", ["l_quantity", "l_discount"])


# --- association ------------------------------------------------------------

ASSOCIATED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _spearman_sql(a: str, b: str, t: str = "lineitem") -> str:
    """field_1, field_2, effect, signed_effect and p of one pair over its complete rows, not rounded."""
    statistic = "(r * sqrt((n - 2) / (1 - r * r)))"
    return f"SELECT '{a}' AS field_1, '{b}' AS field_2, abs(r) AS effect, r AS signed, {t_p_sql(statistic, '(n - 2)')} AS p FROM (SELECT corr(a, b) AS r, count(*) AS n FROM (SELECT {_rank_sql(a)} AS a, {_rank_sql(b)} AS b FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"


def _numeric_sql(fields: list[str], t: str = "lineitem") -> str:
    return " UNION ALL ".join(_spearman_sql(a, b, t) for i, a in enumerate(fields) for b in fields[i + 1 :])


@query(f"SELECT field_1, field_2, {r('effect', 'effect')}, {r('signed', 'signed_effect')}, {r('p', 'p_value')} FROM ({_numeric_sql(ASSOCIATED)})")
def assoc_numeric(spark, folder):
    return association.numeric_pairs(table(spark, folder, "lineitem"), ASSOCIATED).select("field_1", "field_2", "effect", "signed_effect", "p_value")


def _cramer_sql(t: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS field_1, '{b}' AS field_2, sqrt(greatest(0, chi2 / n - (k - 1) * (q - 1) / (n - 1)) / least(q - (q - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)) AS effect,
      {chi2_p_sql("least(chi2, 4000)", "((q - 1) * (k - 1))", root=True)} AS p FROM (
      SELECT n * (sum(w * w / (nx * ny)) - 1) AS chi2, n, q, k FROM (SELECT {a}, {b}, count(*)::DOUBLE AS w, sum(count(*)) OVER (PARTITION BY {a})::DOUBLE AS nx, sum(count(*)) OVER (PARTITION BY {b})::DOUBLE AS ny FROM {t} GROUP BY 1, 2),
      (SELECT count(*)::DOUBLE AS n, count(DISTINCT {a}) AS q, count(DISTINCT {b}) AS k FROM {t}) GROUP BY n, q, k)"""


@query(f"SELECT field_1, field_2, {r('effect', 'effect')}, {r('p', 'p_value')} FROM ({_cramer_sql('lineitem', 'l_returnflag', 'l_linestatus')})")
def assoc_categorical(spark, folder):
    return association.categorical_pairs(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"]).select("field_1", "field_2", "effect", "p_value")


def _kruskal_sql(a: str, b: str, t: str = "lineitem") -> str:
    rows = f"(SELECT {a}, {b} FROM (SELECT {a}, {b}, count(*) OVER (PARTITION BY {a}) AS m FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE m > 1)"
    return f"""SELECT '{a}' AS field_1, '{b}' AS field_2, greatest(0, (h - k + 1) / (n - k)) AS effect, {chi2_p_sql("least(h, 4000)", "(k - 1)", root=True)} AS p FROM (
      SELECT 12.0 / (n * (n + 1)) * sum(m * (t / m - (n + 1) / 2.0) ** 2) / (1 - any_value(tied) / (n ** 3 - n)) AS h, count(*) AS k, n FROM (
      SELECT {a}, count(*)::DOUBLE AS m, sum(r) AS t FROM (SELECT {a}, {_rank_sql(b)} AS r FROM {rows}) GROUP BY 1), (SELECT sum(c)::DOUBLE AS n, sum(c::DOUBLE ** 3 - c) AS tied FROM (SELECT count(*) AS c FROM {rows} GROUP BY {b})) GROUP BY n)"""


def _mixed_sql(categorical: list[str], numeric: list[str], t: str = "lineitem") -> str:
    return " UNION ALL ".join(_kruskal_sql(a, b, t) for a in categorical for b in numeric)


@query(f"SELECT field_1, field_2, {r('effect', 'effect')}, {r('p', 'p_value')} FROM ({_mixed_sql(['l_returnflag', 'l_linestatus'], ['l_quantity', 'l_extendedprice'])})")
def assoc_mixed(spark, folder):
    return association.mixed_pairs(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]).select("field_1", "field_2", "effect", "p_value")


@query(f"""WITH p AS (SELECT l_orderkey AS field, min(l_tax) * min(l_discount) * 10 AS p_value FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p_value, field) AS i, count(*) OVER () AS m FROM p)
  SELECT field, {r("p_value", "p_value")}, {r("least(1.0, min(p_value * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING))", "q_value")} FROM k""")
def assoc_fdr(spark, folder):
    p = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("field")).agg((F.min("l_tax") * F.min("l_discount") * 10).alias("p_value"))
    return association.benjamini_hochberg(p)


#: The fields in the order of their roles: continuous before discrete, binary before others.
_BY_ROLE = ["l_quantity", "l_extendedprice", "l_linenumber", "l_discount", "l_tax"]


@query(f"""WITH every AS (
  SELECT field_1, field_2, 'numeric_numeric' AS pair_type, 'Spearman' AS test, effect, signed, p FROM ({_numeric_sql(_BY_ROLE)})
  UNION ALL SELECT field_1, field_2, 'categorical_categorical', 'ChiSquare+CramersV', effect, NULL, p FROM ({_cramer_sql("lineitem", "l_linestatus", "l_returnflag")})
  UNION ALL SELECT field_1, field_2, 'categorical_numeric', 'KruskalWallis+EpsilonSquared', effect, NULL, p FROM ({_mixed_sql(["l_linestatus", "l_returnflag"], _BY_ROLE)})
), placed AS (
  SELECT *, row_number() OVER (ORDER BY p, field_1, field_2) AS i, count(*) OVER () AS m FROM every
), judged AS (
  SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM placed
)
SELECT field_1, field_2, pair_type, test, {r("effect", "effect")}, {r("signed", "signed_effect")}, CAST(sign(signed) AS INT) AS direction, {r("p", "p_value")}, {r("q", "q_value")}, q <= 0.05 AS significant_fdr,
  CASE WHEN effect >= 0.7 THEN 'very_strong' WHEN effect >= 0.5 THEN 'strong' WHEN effect >= 0.3 THEN 'moderate' WHEN effect >= 0.15 THEN 'weak' ELSE 'very_weak' END AS effect_label,
  {r("effect * CASE WHEN q <= 0.05 THEN 1 ELSE 0.25 END", "evidence_score")} FROM judged""")
def associations(spark, folder):
    return association.associations(table(spark, folder, "lineitem").select(*ASSOCIATED, "l_returnflag", "l_linestatus"))


@query(f"""WITH parts AS (
  SELECT lang, source, n_chars, len(string_split(text, chr(10))) AS lines, len(string_split(text, ' ')) AS words FROM documents
), every AS (
  SELECT field_1, field_2, effect, p FROM ({_numeric_sql(["n_chars", "lines", "words"], "parts")})
  UNION ALL SELECT field_1, field_2, effect, p FROM ({_cramer_sql("(SELECT * FROM parts WHERE lang IS NOT NULL AND source IS NOT NULL)", "lang", "source")})
  UNION ALL SELECT field_1, field_2, effect, p FROM ({_mixed_sql(["lang", "source"], ["n_chars", "lines", "words"], "parts")})
), judged AS (
  SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, field_1, field_2) AS i, count(*) OVER () AS m FROM every)
), edges AS (
  SELECT unnest([field_1, field_2]) AS field, effect FROM judged WHERE q <= 0.05 AND effect >= 0.15
)
SELECT field, count(*) AS edges, {r("avg(effect)", "mean_effect")}, {r("max(effect)", "max_effect")} FROM edges GROUP BY field""")
def eda_connectivity(spark, folder):
    docs = table(spark, folder, "documents")
    parts = docs.select("lang", "source", "n_chars", F.size(F.split("text", "\n")).alias("lines"), F.size(F.split("text", " ")).alias("words"))
    return association.connectivity(association.associations(parts))


# --- features ---------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, {r("l_quantity * l_discount", "l_quantity__x__l_discount")}, {r("ln(1 + l_extendedprice)", "l_extendedprice__log1p")} FROM lineitem""")
def interactions_and_logs(spark, folder):
    rows = features.interactions(table(spark, folder, "lineitem"), (("l_quantity", "l_discount"),))
    return features.log_features(rows.select("l_orderkey", "l_linenumber", "l_quantity__x__l_discount", "l_extendedprice")).select("l_orderkey", "l_linenumber", "l_quantity__x__l_discount", "l_extendedprice__log1p")


@query(f"""SELECT doc_id, toxic, {r("(SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY toxic))", "weight")} FROM labels""")
def balanced_weights(spark, folder):
    return features.balanced_weight(table(spark, folder, "labels").select("doc_id", "toxic"), "toxic")


@query(f"""WITH e AS (SELECT event_id, nullif(event_type, 'click') AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events), m AS (SELECT median(value) AS md FROM e), k AS (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1)
  SELECT event_id, {r("coalesce(e.value, md)", "value")}, coalesce(e.kind, k.kind) AS kind FROM e, m, k""")
def imputed(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.nullif(F.col("event_type"), F.lit("click")).alias("kind"))
    return features.impute(e, features.medians(e, ["value"]), features.modes(e, ["kind"]))


# --- measures of predictions, over scores made by formula -------------------

_SCORED = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 5 + l_tax * 3 AS s FROM lineitem"


@query(f"""WITH d AS ({_SCORED}), k AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d), a AS (SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS roc FROM k),
  g AS (SELECT s, sum(y) AS n1, count(*) AS n FROM d GROUP BY s), c AS (SELECT n1, sum(n1) OVER w AS hits, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY s DESC)), ap AS (SELECT sum(n1 * hits / seen) / sum(n1) AS ap FROM c),
  m AS (SELECT count(*) FILTER (y = 0 AND s < 0.31) AS tn, count(*) FILTER (y = 0 AND s >= 0.31) AS fp, count(*) FILTER (y = 1 AND s < 0.31) AS fn, count(*) FILTER (y = 1 AND s >= 0.31) AS tp, avg((s - y) ** 2) AS brier,
    avg(-ln(CASE WHEN y = 1 THEN least(greatest(s, 1e-8), 1 - 1e-8) ELSE 1 - least(greatest(s, 1e-8), 1 - 1e-8) END)) AS ll FROM d)
  SELECT {r("ap", "pr_auc")}, {r("roc", "roc_auc")}, {r("tp / (tp + fp)", "precision")}, {r("tp / (tp + fn)", "recall")}, {r("2 * tp / (2 * tp + fp + fn)", "f1")}, {r("(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced_accuracy")}, {r("brier", "brier")}, {r("ll", "log_loss")}, {r("0.31", "threshold")}, tn, fp, fn, tp FROM m, a, ap""")
def metrics_binary(spark, folder):
    d = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 5 + F.col("l_tax") * 3).alias("s"))
    return evaluate.binary_metrics(d, "y", "s", 0.31)


_GUESSED = "SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '1-URGENT' ELSE '3-MEDIUM' END AS p FROM orders"


@query(f"""WITH d AS ({_GUESSED}), y AS (SELECT y AS label, count(*) AS support, count(*) FILTER (y = p) AS hits FROM d GROUP BY 1), p AS (SELECT p AS label, count(*) AS given FROM d GROUP BY 1),
  s AS (SELECT coalesce(support, 0) AS support, coalesce(hits, 0) / nullif(support, 0) AS recall, coalesce(2.0 * coalesce(hits, 0) / nullif(coalesce(support, 0) + coalesce(given, 0), 0), 0) AS f1 FROM y FULL JOIN p USING (label))
  SELECT {r("avg(f1)", "macro_f1")}, {r("sum(f1 * support) / sum(support)", "weighted_f1")}, {r("avg(recall)", "balanced_accuracy")} FROM s""")
def metrics_multiclass(spark, folder):
    o = table(spark, folder, "orders")
    guess = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "1-URGENT").otherwise("3-MEDIUM")
    return evaluate.multiclass_metrics(o.select(F.col("o_orderpriority").alias("y"), guess.alias("p")), "y", "p")


@query(f"""WITH d AS (SELECT l_linenumber % 3 AS y, l_quantity / 100 AS a, (1 - l_quantity / 100) * l_discount * 10 AS b FROM lineitem), e AS (SELECT y, [a, b, 1 - a - b] AS p, list_reverse_sort([a, b, 1 - a - b]) AS o FROM d),
  g AS (SELECT y, list_position(p, list_max(p)) - 1 AS c, o[1] AS top, o[1] - o[2] AS margin, o[1] >= 0.6 AND o[1] - o[2] >= 0.05 AS ok FROM e), f AS (SELECT label, 2.0 * count(*) FILTER (y = c AND y = label) / nullif(count(*) FILTER (y = label) + count(*) FILTER (c = label), 0) AS f1 FROM g, (SELECT unnest([0, 1, 2]) AS label) WHERE ok GROUP BY label)
  SELECT {r("avg(CASE WHEN ok THEN 1.0 ELSE 0 END)", "coverage")}, {r("1 - avg(CASE WHEN ok THEN 1.0 ELSE 0 END)", "abstention_rate")}, {r("avg(top)", "mean_confidence")}, {r("avg(margin)", "mean_margin")}, {r("avg(CASE WHEN ok THEN CASE WHEN y = c THEN 1.0 ELSE 0 END END)", "selective_accuracy")}, {r("(SELECT avg(f1) FROM f)", "selective_macro_f1")} FROM g""")
def selective_prediction(spark, folder):
    a = F.col("l_quantity") / 100
    b = (1 - F.col("l_quantity") / 100) * F.col("l_discount") * 10
    return evaluate.selective(table(spark, folder, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), F.array(a, b, 1 - a - b).alias("probabilities")), "y", "probabilities")


@query(f"""WITH d AS (SELECT l_extendedprice AS y, l_quantity * 1400 AS p FROM lineitem), c AS (SELECT quantile_cont(y, 0.9) AS cut, avg(y) AS m FROM d)
  SELECT count(*) AS n, {r("avg(abs(p - y))", "mae", 4)}, {r("sqrt(avg((p - y) ** 2))", "rmse", 4)}, {r("1 - sum((p - y) ** 2) / sum((y - m) ** 2)", "r2", 4)}, {r("avg(CASE WHEN y >= cut THEN abs(p - y) END)", "tail_mae", 4)}, {r("avg(CASE WHEN y >= cut THEN p - y END)", "tail_bias", 4)}, avg(CASE WHEN y >= cut THEN p - y END) < 0 AS tail_warning FROM d, c""", 4)
def metrics_regression(spark, folder):
    return evaluate.regression_metrics(table(spark, folder, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1400).alias("p")), "l_extendedprice", "p")


@query(f"""WITH d AS (SELECT c_nationkey % 3 AS c, c_acctbal AS a, CAST(c_custkey AS DOUBLE) AS b FROM customer), m AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM d GROUP BY c), g AS (SELECT avg(a) AS ga, avg(b) AS gb, count(*) AS n FROM d),
  w AS (SELECT c, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS s, sum((a - ma) ** 2 + (b - mb) ** 2) AS ss FROM d JOIN m USING (c) GROUP BY c), t AS (SELECT * FROM m JOIN w USING (c)),
  x AS (SELECT max((p.s + q.s) / sqrt((p.ma - q.ma) ** 2 + (p.mb - q.mb) ** 2)) AS worst FROM t p JOIN t q ON p.c <> q.c GROUP BY p.c)
  SELECT {r("(SELECT sum(t.n * ((ma - ga) ** 2 + (mb - gb) ** 2)) / (count(*) - 1) FROM t, g) / (SELECT sum(ss) / (any_value(g.n) - count(*)) FROM t, g)", "calinski_harabasz")}, {r("(SELECT avg(worst) FROM x)", "davies_bouldin")}""")
def metrics_clusters(spark, folder):
    return evaluate.cluster_metrics(table(spark, folder, "customer").withColumn("c", F.col("c_nationkey") % 3), ["c_acctbal", "c_custkey"], "c")


@query(f"""WITH d AS (SELECT c_nationkey % 4 AS segment, unnest(['c_acctbal', 'c_custkey', 'c_nationkey']) AS field, unnest([c_acctbal, c_custkey, c_nationkey]::DOUBLE[]) AS x FROM customer), o AS (SELECT field, avg(x) AS g, stddev_samp(x) AS sd FROM d GROUP BY 1),
  s AS (SELECT c_nationkey % 4 AS segment, 100.0 * count(*) / (SELECT count(*) FROM customer) AS pct FROM customer GROUP BY 1), z AS (SELECT segment, field, avg(x) AS mean, (avg(x) - any_value(g)) / any_value(sd) AS z FROM d JOIN o USING (field) GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY z DESC, field) AS hi, row_number() OVER (PARTITION BY segment ORDER BY z, field) AS lo FROM z), u AS (SELECT segment, field, mean, z, 'high' AS side, hi AS place FROM k WHERE hi <= 2 UNION ALL SELECT segment, field, mean, z, 'low', lo FROM k WHERE lo <= 2)
  SELECT segment, {r("pct", "size_pct")}, field, {r("mean", "mean")}, {r("z", "z")}, side, CAST(place AS INT) AS place FROM u JOIN s USING (segment)""")
def segment_profile(spark, folder):
    rows = table(spark, folder, "customer").withColumn("segment", F.col("c_nationkey") % 4)
    return segment.segment_profile(rows, ["c_acctbal", "c_custkey", "c_nationkey"], "segment", 2)


# --- model routes, with the folds, trees and starts of the policies --------------------------------


@query()
def segmentation(spark, folder):
    labelled, evidence = segment.segments(table(spark, folder, "part").drop("p_partkey"), SEGMENTATION)
    return labelled.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price")).withColumn("silhouette", F.lit(evidence["silhouette"]))


@query()
def regression(spark, folder):
    rows = table(spark, folder, "lineitem").filter("l_extendedprice IS NOT NULL").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    return evaluate.regression_metrics(models.regression_models(rows, "l_extendedprice", REGRESSION)[0], "y", "prediction")


@query()
def binary(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").drop("doc_id", "quality")
    return evaluate.binary_metrics(models.binary_models(rows, "toxic", BINARY)[0], "y", "score", BINARY.threshold)


@query()
def multiclass(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "value", F.hour("ts").alias("hour"), "event_type")
    oof, fitted = models.multiclass_models(rows, "event_type", MULTICLASS)
    return evaluate.selective(oof, "y", "probabilities").crossJoin(evaluate.probability_metrics(oof, "y", "probabilities", len(fitted.labels)))


@query(f"""SELECT date_trunc('day', ts) AS window_start, event_type, count(value) AS n, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "sd")} FROM events GROUP BY 1, 2""")
def running_statistics(spark, folder):
    from tallyframe.streaming.running import running_statistics

    return running_statistics(table(spark, folder, "events"), "ts", "event_type", "value")
