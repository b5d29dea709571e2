"""All pairs of fields tested for association, with false-discovery control.

Numeric fields without nulls are ranked once, by ranges of their counted values,
and the ranks go back to the rows.  One matrix of sums then gives all pairs of
numeric fields, and one aggregation all of them against the categorical ones.
Pairs with nulls are a column of the data (``pair``), not a loop of jobs: they
are melted and ranked among their complete rows.  So are pairs of categories,
which are counted by value first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.special import chi2_p, t_p
from tallyframe.operators.profile import Fields, field_roles
from tallyframe.shared import kept

ALPHA, PRACTICAL, REDUNDANT = 0.05, 0.15, 0.70
COLUMNS = ("field_1", "field_2", "pair_type", "test", "effect", "signed_effect", "direction", "p_value")


#: Ranks of a field with at most so many distinct values are broadcast (two doubles each).
BROADCAST_VALUES = 500_000


def melted(df: DataFrame, pairs: list[tuple[str, str]], types: tuple[str, str]) -> DataFrame:
    """(pair, x, y, w): for each pair of fields its complete pairs of values and how many rows have them."""
    cells = [F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast(types[0]).alias("x"), F.col(f"`{b}`").cast(types[1]).alias("y")) for i, (a, b) in enumerate(pairs)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))


def ranked_counts(counts: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """``counts`` of distinct values with ``rank``, their average rank within ``by``.

    Values are ranged by (by, value); a range adds up its own counts, and one row
    for each range and ``by`` says what comes before it, so no window holds a field.
    """
    ranged = kept(counts.repartitionByRange(by, value).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(by, "_part").agg(F.sum(n).alias("_total"))
    upper = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(by, "_part", F.coalesce(F.sum("_total").over(upper), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum(n).over(inner), F.lit(0))
    return ranged.join(F.broadcast(ahead), [by, "_part"]).withColumn("rank", before + (F.col(n) + 1) / 2).drop("_part", "_ahead")


def _named(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, field_1 string, field_2 string")
    return df.join(F.broadcast(names), "pair")  # a row for each pair of fields


def _weighted_corr(n: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), n))


@dataclass
class Ranked:
    """Rows with the ranks of those numeric fields that have no null, each ranked once: ``r0``, ``r1``, ..."""

    rows: DataFrame
    fields: list[str]
    n: int
    #: field number -> sum of t ** 3 - t over its ties
    tied: dict[int, float]


def ranked_fields(df: DataFrame, fields: list[str], keep: list[str] | None = None) -> Ranked:
    """Every numeric field without nulls ranked once among all rows, beside the columns ``keep``.

    A field's values are counted, ranged and ranked for all fields together; the
    ranks go back to the rows by one join a field, broadcast where its distinct
    values are few.
    """
    x = [F.col(f"`{c}`").cast("double") for c in fields]
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(x)]).first()
    whole = [i for i in range(len(fields)) if facts[f"n{i}"] == facts["n"]]
    names = [fields[i] for i in whole]
    if not whole or not facts["n"]:
        return Ranked(df, [], facts["n"], {})
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(j).alias("field"), x[i].alias("value")) for j, i in enumerate(whole)])).alias("c")).select("c.*")
    ranks = kept(ranked_counts(cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("ties")), "field", "value", "ties"), "ranks")
    about = {r["field"]: r for r in ranks.groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tied")).collect()}
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(f"g{k}") for k, c in enumerate(keep or [])], *[x[i].alias(f"v{j}") for j, i in enumerate(whole)])
    for j in range(len(whole)):
        own = ranks.filter(F.col("field") == j).select(F.col("value").alias(f"v{j}"), F.col("rank").alias(f"r{j}"))
        rows = rows.join(F.broadcast(own) if about[j]["values"] <= BROADCAST_VALUES else own, f"v{j}")
    rows = kept(rows.drop(*[f"v{j}" for j in range(len(whole))]), "ranked")  # for both kinds of pairs
    return Ranked(rows, names, facts["n"], {j: r["tied"] for j, r in about.items()})


def gram(rows: DataFrame, columns: list[str], centre: float) -> DataFrame:
    """(i, j, s): sums of products of the centred columns, a block product for each batch of rows, added up."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = np.array([np.asarray(c, np.float64) for c in batch.columns]) - centre
            total += x @ x.T
        i, j = np.triu_indices(len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return rows.select(*columns).mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def numeric_pairs(df: DataFrame, fields: list[str], ranked: Ranked | None = None) -> DataFrame:
    """Spearman's rank correlation for every pair of numeric fields with ten complete rows.

    Fields without nulls are ranked once and all their pairs come from one matrix of
    sums; only pairs with a null are ranked again among their complete rows.
    """
    pairs = list(combinations(fields, 2))
    ranked = ranked or ranked_fields(df, fields)
    place = {c: j for j, c in enumerate(ranked.fields)}
    once = [(i, place[a], place[b]) for i, (a, b) in enumerate(pairs) if a in place and b in place]
    parts = []
    if once and ranked.n >= 10:
        # The pairs' sums: a row for each pair of fields.
        sums = {(r.i, r.j): r.s for r in gram(ranked.rows, [f"r{j}" for j in range(len(ranked.fields))], (ranked.n + 1) / 2).collect()}
        rows = [(i, ranked.n, sums[min(a, b), max(a, b)], sums[a, a], sums[b, b]) for i, a, b in once]
        parts.append(df.sparkSession.createDataFrame(rows, "pair int, n long, uv double, uu double, vv double"))
    again = [(a, b) for a, b in pairs if a not in place or b not in place]
    if again:
        number = {pair: i for i, pair in enumerate(pairs)}
        ids = F.create_map(*[F.lit(x) for k, pair in enumerate(again) for x in (k, number[pair])])
        parts.append(_again(df, again).withColumn("pair", ids[F.col("pair")]))
    if not parts:
        parts = [df.sparkSession.createDataFrame([], "pair int, n long, uv double, uu double, vv double")]
    s = reduce(DataFrame.unionByName, parts)
    some = (F.col("uu") > 0) & (F.col("vv") > 0)
    s = s.withColumn("rho", F.when(some, _weighted_corr(F.col("uv") / F.sqrt(F.when(some, F.col("uu") * F.col("vv"))))))
    d = (F.col("n") - 2).cast("double")
    s = s.withColumn("t", F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt(d / F.when(F.abs("rho") < 1, 1 - F.col("rho") * F.col("rho")))))
    p = F.when(F.abs("rho") >= 1, 0.0).otherwise(t_p("t", d))
    return _named(s, pairs).select("field_1", "field_2", F.lit("numeric_numeric").alias("pair_type"), F.lit("Spearman").alias("test"), F.abs("rho").alias("effect"), F.col("rho").alias("signed_effect"), F.signum("rho").cast("int").alias("direction"), p.alias("p_value"))


def _again(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, uv, uu, vv) of pairs ranked among their complete rows."""
    cells = kept(melted(df, pairs, ("double", "double")), "cells")
    rx, ry = (ranked_counts(cells.groupBy("pair", c).agg(F.sum("w").alias("ties")), "pair", c, "ties").select("pair", c, F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    size = cells.groupBy("pair").agg(F.sum("w").alias("n"))
    both = cells.join(rx, ["pair", "x"]).join(ry, ["pair", "y"]).join(F.broadcast(size), "pair")
    u, v = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2
    return both.groupBy("pair").agg(F.first("n").alias("n"), F.sum(F.col("w") * u * v).alias("uv"), F.sum(F.col("w") * u * u).alias("uu"), F.sum(F.col("w") * v * v).alias("vv")).filter("n >= 10")


def categorical_pairs(df: DataFrame, fields: list[str]) -> DataFrame:
    """Chi-square and bias-corrected Cramer's V for every pair of categorical fields."""
    pairs = list(combinations(fields, 2))
    cells = melted(df, pairs, ("string", "string"))
    x, y = (cells.groupBy("pair", side).agg(F.sum("w").alias(f"n{side}")) for side in ("x", "y"))
    shape = cells.groupBy("pair").agg(F.sum("w").alias("n"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k")).filter("r >= 2 AND k >= 2")
    # chi2 = n * (sum of w^2 / (row * column) - 1): empty cells need no rows of their own.
    s = cells.join(x, ["pair", "x"]).join(y, ["pair", "y"]).groupBy("pair").agg(F.sum(F.col("w") * F.col("w") / (F.col("nx") * F.col("ny"))).alias("q")).join(shape, "pair")
    s = s.withColumn("chi2", F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1)))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    least = F.least(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)
    v = F.when((n > 1) & (least > 0), F.sqrt(phi / F.when(least > 0, least)))
    return _named(s, pairs).select("field_1", "field_2", F.lit("categorical_categorical").alias("pair_type"), F.lit("ChiSquare+CramersV").alias("test"), v.alias("effect"), F.lit(None).cast("double").alias("signed_effect"), F.lit(None).cast("int").alias("direction"), chi2_p("chi2", ((r - 1) * (k - 1)).cast("double")).alias("p_value"))


def _kruskal_again(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, tied, k, spread) of pairs ranked among their complete rows, groups of one row left out."""
    cells = melted(df, pairs, ("string", "double"))
    large = cells.groupBy("pair", "x").agg(F.sum("w").alias("m")).filter("m >= 2")
    cells = kept(cells.join(large.select("pair", "x"), ["pair", "x"], "left_semi"), "cells")
    ranks = kept(ranked_counts(cells.groupBy("pair", "y").agg(F.sum("w").alias("ties")), "pair", "y", "ties"), "ranks")
    sums = cells.join(ranks.select("pair", "y", "rank"), ["pair", "y"]).groupBy("pair", "x").agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("rank")).alias("total"))
    ties = ranks.groupBy("pair").agg(F.sum("ties").alias("n"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tied"))
    spread = F.sum(F.col("m") * (F.col("total") / F.col("m") - (F.col("n") + 1) / 2) ** 2)
    return sums.join(F.broadcast(ties), "pair").groupBy("pair").agg(F.first("n").alias("n"), F.first("tied").alias("tied"), F.count(F.lit(1)).alias("k"), spread.alias("spread"))


def mixed_pairs(df: DataFrame, categorical: list[str], numeric: list[str], ranked: Ranked | None = None) -> DataFrame:
    """Kruskal-Wallis and epsilon squared for every categorical field against every numeric one; groups of one row are left out.

    Where neither field has a null and no group has one row, the field's ranks among
    all rows serve, and one aggregation sums them for all numeric fields.
    """
    pairs = list(product(categorical, numeric))
    number = {pair: i for i, pair in enumerate(pairs)}
    ranked = ranked or ranked_fields(df, numeric, categorical)
    columns = [f"r{j}" for j in range(len(ranked.fields))]
    parts, done = [], set()
    if columns:
        groups = ranked.rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"g{k}").alias("x")) for k in range(len(categorical))])).alias("g"), *columns).select("g.*", *columns)
        sums = kept(groups.groupBy("c", "x").agg(F.count(F.lit(1)).alias("m"), *[F.sum(r).alias(r) for r in columns]), "rank-sums")
        odd = {r.c for r in sums.filter("x IS NULL OR m < 2").select("c").distinct().collect()}  # categorical fields
        fine = [k for k in range(len(categorical)) if k not in odd]
        centre, n = (ranked.n + 1) / 2, ranked.n
        spread = [F.sum(F.col("m") * (F.col(r) / F.col("m") - centre) ** 2).alias(r) for r in columns]
        for row in sums.filter(F.col("c").isin(fine)).groupBy("c").agg(F.count(F.lit(1)).alias("k"), *spread).collect():  # a row a categorical field
            for j, name in enumerate(ranked.fields):
                if (categorical[row.c], name) in number:
                    done.add((categorical[row.c], name))
                    parts.append((number[categorical[row.c], name], n, ranked.tied[j], row.k, row[f"r{j}"]))
    schema = "pair int, n long, tied double, k long, spread double"
    frames = [df.sparkSession.createDataFrame(parts, schema)]
    again = [pair for pair in pairs if pair not in done]
    if again:
        ids = F.create_map(*[F.lit(x) for k, pair in enumerate(again) for x in (k, number[pair])])
        frames.append(_kruskal_again(df, again).withColumn("pair", ids[F.col("pair")]))
    n, k = F.col("n"), F.col("k")
    s = reduce(DataFrame.unionByName, frames).filter("k >= 2")
    fix = 1 - F.col("tied") / (n.cast("double") ** 3 - n)
    s = s.withColumn("h", F.when(fix > 0, 12 / (n * (n + 1)) * F.col("spread") / F.when(fix > 0, fix)))
    effect = F.when(n > k, F.greatest(F.lit(0.0), (F.col("h") - k + 1) / F.when(n > k, n - k)))
    return _named(s, pairs).select("field_1", "field_2", F.lit("categorical_numeric").alias("pair_type"), F.lit("KruskalWallis+EpsilonSquared").alias("test"), effect.alias("effect"), F.lit(None).cast("double").alias("signed_effect"), F.lit(None).cast("int").alias("direction"), chi2_p("h", (k - 1).cast("double")).alias("p_value"))


def effect_label(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").when(v >= 0.7, "very_strong").when(v >= 0.5, "strong").when(v >= 0.3, "moderate").when(v >= 0.15, "weak").otherwise("very_weak")


#: Tests that one task may rank; columns bound their number where pairs of fields are tested.
WINDOW_TESTS = 10_000


def benjamini_hochberg(df: DataFrame, p: str = "p_value", most: int | None = None) -> DataFrame:
    """``df`` with q_value: smallest false-discovery rate at which a row is significant; a null p counts as 1.

    ``most`` says, where it is known, how many rows there are at most: few are ranked in one window.

    Equal p-values share the q of the last of them, so distinct p-values are
    counted and ranged, each range adds up and takes its minima from the end, and
    one row a range gives what comes before and after: no window runs over all
    rows in one task.
    """
    tests = df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    if most is not None and most <= WINDOW_TESTS:
        up, down = Window.orderBy("_p"), Window.orderBy(F.desc("_p"))  # equal p-values are one place of either
        scaled = tests.withColumn("_q", F.col("_p") * F.count(F.lit(1)).over(Window.partitionBy()) / F.count(F.lit(1)).over(up))
        return scaled.withColumn("q_value", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_p", "_q")
    rows = kept(tests, "tests")  # each test is made once
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ranged = kept(counts.repartitionByRange("_p").withColumn("_part", F.spark_partition_id()), "ranged")
    before, after = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("total"))
    ahead = totals.select("_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_ahead"), F.sum("total").over(Window.partitionBy()).alias("_m"))
    inner = Window.partitionBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    scaled = ranged.join(F.broadcast(ahead), "_part").withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_ahead") + F.sum("_n").over(inner.orderBy("_p"))))
    later = scaled.groupBy("_part").agg(F.min("_q").alias("least")).select("_part", F.min("least").over(after).alias("_later"))
    q = F.least(F.lit(1.0), F.min("_q").over(inner.orderBy(F.desc("_p"))), F.col("_later"))
    found = scaled.join(F.broadcast(later), "_part").select("_p", q.alias("q_value"))
    return rows.join(found, "_p").select(*df.columns, "q_value")


def associations(df: DataFrame, fields: Fields | None = None) -> DataFrame:
    """Every testable pair with effect, p, q, label and evidence score.  ValueError if there is none."""
    fields = fields or field_roles(df)
    numeric, categorical = fields.numeric_like, fields.categorical_like
    parts = []
    ranked = ranked_fields(df, numeric, categorical) if numeric and len(numeric) + len(categorical) > 1 else None
    if len(numeric) > 1:
        parts.append(numeric_pairs(df, numeric, ranked))
    if len(categorical) > 1:
        parts.append(categorical_pairs(df, categorical))
    if numeric and categorical:
        parts.append(mixed_pairs(df, categorical, numeric, ranked))
    if not parts:
        raise ValueError("no testable pairs")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    n = len(numeric) + len(categorical)
    out = benjamini_hochberg(out, most=n * (n - 1) // 2).withColumn("significant_fdr", F.col("q_value") <= ALPHA)
    out = out.withColumns({"effect_label": effect_label(F.col("effect")), "evidence_score": F.coalesce("effect", F.lit(0.0)) * F.when(F.col("significant_fdr"), 1.0).otherwise(0.25)})
    return by_evidence(out)


def by_evidence(pairs: DataFrame) -> DataFrame:
    """The strongest evidence first; a row a pair of fields."""
    return pairs.orderBy(F.desc("evidence_score"), F.desc_nulls_last("effect"), "field_1", "field_2")


def by_edges(ends: DataFrame) -> DataFrame:
    """The best connected field first; a row a field."""
    return ends.orderBy(F.desc("edges"), F.desc("max_effect"), "field")


def supported(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("significant_fdr") & (F.col("effect") >= PRACTICAL))


def connectivity(pairs: DataFrame) -> DataFrame:
    """field, edges, mean and largest effect over the supported pairs, best connected first."""
    good = supported(pairs)
    ends = good.select(F.col("field_1").alias("field"), "effect").unionByName(good.select(F.col("field_2").alias("field"), "effect"))
    return by_edges(ends.groupBy("field").agg(F.count(F.lit(1)).alias("edges"), F.avg("effect").alias("mean_effect"), F.max("effect").alias("max_effect")))
