"""Descriptive statistics and the data behind the standard plots.

Quantiles interpolate linearly between order statistics.  Nulls are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.special import normal_quantile
from tallyframe.shared import kept


def stacked(df: DataFrame, columns: list[str], as_type: str = "double") -> DataFrame:
    """(variable, value): the named columns one below the other, in one scan."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(as_type).alias("value")) for c in columns])).alias("v")).select("v.*")


#: 1 / relative rank error of the sketches that bracket an order statistic; groups whose brackets the driver may hold.
ACCURACY, BRACKETS = 20_000, 20_000


def quantiles(rows: DataFrame, by: list[str], value: str, q: list[float], more: list[Column] | None = None) -> DataFrame:
    """by, n, what ``more`` aggregates, and ``q``: the exact quantiles of each group, interpolated linearly, as an array.

    No group is buffered or sorted.  A first pass makes one sketch a group, whose
    error in rank is bounded, and so brackets the two order statistics of each
    quantile.  The second counts, map-side, how many values lie before, between and
    beyond the brackets, and the values within them, a few in ten thousand of a
    group's; their running counts find the order statistics.  Nulls are dropped.
    """
    x = F.col(value)
    rows = rows.filter(x.isNotNull())
    q, slack = sorted(q), 4 / ACCURACY
    sides = [min(1.0, max(0.0, p + d)) for p in q for d in (-slack, slack)]
    first = rows.groupBy(*by).agg(F.count(x).alias("n"), *(more or []), F.percentile_approx(x, sides, ACCURACY).alias("_in"), F.min(x).alias("_least"), F.max(x).alias("_most"))
    # A row a group: few of them are a local table, whose size Spark doesn't know, so it is told to broadcast it and
    # neither broadcasts nor deals out the rows; many are a table of their own.
    known = first.limit(BRACKETS + 1).collect()
    few_groups = len(known) <= BRACKETS
    first = rows.sparkSession.createDataFrame(known, first.schema) if few_groups else kept(first, "brackets")
    first = F.broadcast(first.filter("n > 0")) if few_groups else first.filter("n > 0")
    # Where the slack is less than a rank, a bracket is all there is.
    few = F.col("n") <= ACCURACY
    low = [F.when(few | F.lit(p <= slack), F.col("_least")).otherwise(F.col("_in")[2 * i]) for i, p in enumerate(q)]
    high = [F.when(few | F.lit(p >= 1 - slack), F.col("_most")).otherwise(F.col("_in")[2 * i + 1]) for i, p in enumerate(q)]
    inside = F.lit(False)
    for a, b in zip(low, high, strict=True):
        inside = inside | ((x >= a) & (x <= b))
    beyond = sum((F.when(x > b, 1).otherwise(0) for b in high), F.lit(0))
    joined = _beside(rows.select(*by, x), first.select(*by, "n", "_in", "_least", "_most"), by)
    cut = joined.select(*by, beyond.alias("_beyond"), F.when(inside, x).alias("_v"), x.alias("_x")).groupBy(*by, "_beyond", "_v").agg(F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_from"))
    order = Window.partitionBy(*by).orderBy("_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = cut.withColumn("_end", F.sum("_m").over(order)).withColumn("_begin", F.col("_end") - F.col("_m"))
    ends = _beside(ends, first.select(*by, "n"), by)
    found = []
    for i, p in enumerate(q):
        at = F.lit(p) * (F.col("n") - 1)
        for j, k in enumerate((F.floor(at), F.least(F.floor(at) + 1, F.col("n") - 1))):
            found.append(F.max(F.when((F.col("_begin") <= k) & (k < F.col("_end")), F.coalesce("_v", F.raise_error(F.lit("a bracket missed its order statistic"))))).alias(f"_{i}_{j}"))
    ends = ends.groupBy(*by).agg(*found)
    out = _beside(first.drop("_in", "_least", "_most"), ends, by)
    part = [F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for p in q]
    return out.withColumn("q", F.array(*[F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * part[i] for i in range(len(q))])).drop(*[f"_{i}_{j}" for i in range(len(q)) for j in (0, 1)])


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with what is known of their groups, null groups too; without ``by`` that is one row."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    names = {c: f"_g{i}" for i, c in enumerate(by)}
    same = None
    for c, g in names.items():
        one = F.col(c).eqNullSafe(F.col(g))
        same = one if same is None else same & one
    return rows.join(groups.withColumnsRenamed(names), same).drop(*names.values())


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, mean, sd, min, quartiles and max of each column; sd of a single value is 0."""
    by = by or []
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select(*by, "v.*").filter("value IS NOT NULL")
    x = F.col("value")
    more = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")]
    out = quantiles(rows, [*by, "variable"], "value", [0.25, 0.5, 0.75], more)
    return out.select(*by, "variable", "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")).alias("sd"), "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def skewness(x: Column) -> Column:
    """Adjusted sample skewness; null under three values or without spread."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(x: Column) -> Column:
    """Adjusted sample excess kurtosis; null under four values or without spread."""
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness, excess kurtosis and what they say about normality, for each column."""
    x = F.col("value")
    out = stacked(df, columns).filter("value IS NOT NULL").groupBy("variable").agg(F.count(x).alias("n"), skewness(x).alias("skewness"), excess_kurtosis(x).alias("kurtosis"))
    calm = (F.abs("skewness") <= 1) & (F.abs("kurtosis") <= 2)
    return out.withColumn("normality", F.when(F.col("n") < 8, "small sample").when(calm, "no strong warning").otherwise("warning"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, lower, upper, n: 5 to 14 equal bins, about the square root of n; the last one is closed, empty ones are there."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    sizes = x.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).filter("n > 0")
    sizes = sizes.withColumn("k", F.least(F.lit(14), F.greatest(F.lit(5), F.ceil(F.sqrt("n")))).cast("int"))
    sizes = sizes.withColumn("width", F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) / F.col("k"))
    one = F.broadcast(sizes)  # a single row
    counts = x.crossJoin(one).select(F.least(F.col("k") - 1, F.floor((F.col("x") - F.col("low")) / F.col("width"))).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = sizes.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "low", "width")
    return bins.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent of valid and cumulative percent (one decimal), most frequent first, ties by value."""
    v = F.trim(F.col(column).cast("string"))
    counts = df.select(v.alias("value")).filter("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # Distinct values in ranges of the order; what comes before a range is one row for each.
    ranged = kept(counts.repartitionByRange(F.desc("n"), "value").withColumn("_part", F.spark_partition_id()), "ranged")
    upper = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_sum"))
    ahead = totals.select("_part", *[F.coalesce(F.sum(c).over(upper), F.lit(0)).alias(f"{c}_before") for c in ("_values", "_sum")], F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    order = Window.partitionBy("_part").orderBy(F.desc("n"), "value")
    running = F.col("_sum_before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.col("_values_before") + F.row_number().over(order)).cast("int")
    return ranged.join(F.broadcast(ahead), "_part").select(rank.alias("rank"), "value", "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("percent"), F.round(100 * running / F.col("_all"), 1).alias("cumulative_percent"))


def valid_counts(df: DataFrame, column: str) -> DataFrame:
    """valid, missing and distinct of a column, blanks counted as missing."""
    v = F.trim(F.col(column).cast("string"))
    there = v.isNotNull() & (v != "")
    return df.agg(F.count_if(there).alias("valid"), F.count_if(~F.coalesce(there, F.lit(False))).alias("missing"), F.count_distinct(F.when(there, v)).alias("distinct"))


def ordered_counts(values: DataFrame, column: str = "x") -> DataFrame:
    """(value, n, before): distinct values, their counts and how many values are smaller.

    Value counts are ranged by value, each range adds up its own, and the
    ranges' totals (one row each) give what comes before: no window runs over
    all values in one task.
    """
    return ordered_sums(values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", "n")


def ordered_sums(counts: DataFrame, value: str, n: str) -> DataFrame:
    """``counts`` of distinct values with ``before``, the sum of ``n`` over smaller values."""
    ranged = kept(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(n).alias("_total"))
    ahead = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    before = F.col("_ahead") + F.coalesce(F.sum(n).over(inner), F.lit(0))
    return ranged.join(F.broadcast(ahead), "_part").withColumn("before", before).drop("_part", "_ahead")


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """rank, observed and theoretical normal quantile of every value; nothing under three values."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    ordered = ordered_counts(x)
    total = x.agg(F.count(F.lit(1)).alias("total")).filter("total >= 3")
    ranks = ordered.select(F.col("value").alias("observed"), F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("i"))
    return ranks.crossJoin(F.broadcast(total)).select((F.col("i") + 1).alias("rank"), "observed", normal_quantile((F.col("i") + 0.5) / F.col("total")).alias("theoretical"))


def qq_line(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.agg(F.avg(x).alias("intercept"), F.stddev_samp(x).alias("slope"))


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope and intercept of the least-squares line through a scatter plot; null if x has no spread."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    out = both.agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("sxx"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return out.select("n", *[F.when(F.col("sxx") > 0, F.col(c)).alias(c) for c in ("slope", "intercept")])


def scatter_points(df: DataFrame, x: str, y: str, most: int = 5000) -> DataFrame:
    """Points for a scatter plot: those of the ``most`` rows whose values hash smallest, the sample being what the plot shows."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(most)


def boxplot(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles and whiskers for each group; whiskers are the fences, clamped to the data."""
    x = F.col(value).cast("double")
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("level"), x.alias("value"))
    out = quantiles(rows, ["level"], "value", [0.25, 0.5, 0.75], [F.min("value").alias("low"), F.max("value").alias("high")])
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    return out.select("level", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.greatest("low", F.col("q")[0] - reach).alias("whisker_low"), F.least("high", F.col("q")[2] + reach).alias("whisker_high"))
