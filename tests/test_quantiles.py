"""Quantiles from brackets, frequencies, chi-square without a grid and ranks of pairs, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import association, describe, relate


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = [(g, rng.choice([rng.gauss(0, 1), 0.5, -3.0]) if g != "flat" else 7.0) for g in ("a", "flat", None) for _ in range(3000)]
    out += [("few", float(i)) for i in range(5)] + [("one", 1.5), ("none", None), ("skewed", 1e300), *[("skewed", -(1.1 ** (i % 900))) for i in range(4000)]]
    return spark.createDataFrame(out, "g string, x double").repartition(5)


@pytest.mark.parametrize(("accuracy", "brackets"), [(20_000, 20_000), (100, 20_000), (100, 2)])
def test_quantiles_are_exact(spark, rows, monkeypatch, accuracy, brackets):
    monkeypatch.setattr(describe, "ACCURACY", accuracy)
    monkeypatch.setattr(describe, "BRACKETS", brackets)
    q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    by = {}
    for r in rows.filter("x IS NOT NULL").collect():
        by.setdefault(r.g, []).append(r.x)
    got = {r.g: r for r in describe.quantiles(rows, ["g"], "x", q, [F.max("x").alias("most")]).collect()}
    assert set(got) == set(by)
    for g, x in by.items():
        assert got[g].n == len(x) and got[g].most == max(x)
        assert got[g].q == pytest.approx(np.quantile(x, q).tolist(), rel=1e-12), g
    whole = describe.quantiles(rows, [], "x", [0.5]).first()
    assert whole.q[0] == pytest.approx(np.median([v for x in by.values() for v in x]))
    assert describe.quantiles(rows.filter("g = 'none'"), ["g"], "x", [0.5]).collect() == describe.quantiles(rows.filter("g = 'none'"), [], "x", [0.5]).collect() == []


def test_no_group_is_sorted_or_buffered(rows):
    plan = describe.quantiles(rows, ["g"], "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_frequency_over_ranges(spark):
    rng = random.Random(1)
    values = [f"v{min(rng.randrange(60), rng.randrange(60))}" for _ in range(2000)] + [" ", None]
    got = describe.frequency(spark.createDataFrame([(v,) for v in values], "v string"), "v").orderBy("rank").collect()
    n = {v: values.count(v) for v in set(values) if v and v.strip()}
    order = sorted(n, key=lambda v: (-n[v], v))
    assert [(r["rank"], r.value, r.n) for r in got] == [(i + 1, v, n[v]) for i, v in enumerate(order)]
    assert got[-1].cumulative_percent == 100.0 and got[0].percent == round(100 * n[order[0]] / 2000, 1)


def test_chi_square_makes_no_empty_cells(spark):
    rng = random.Random(9)
    pairs = [(f"r{int(rng.paretovariate(1)) % 40}", f"c{int(rng.paretovariate(0.8)) % 60}") for _ in range(3000)] + [(None, "c1"), ("r1", " ")]
    df = spark.createDataFrame(pairs, "a string, b string")
    cells = {}
    for a, b in pairs[:-2]:
        cells[a, b] = cells.get((a, b), 0) + 1
    names = [sorted({k[i] for k in cells}) for i in (0, 1)]
    observed = np.array([[cells.get((a, b), 0) for b in names[1]] for a in names[0]], float)
    expected = observed.sum(axis=1, keepdims=True) * observed.sum(axis=0) / 3000
    got = relate.chi_square(df, "a", "b")
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    r = got.first()
    assert (r.rows, r.columns, r.n) == (*observed.shape, 3000) and r.chi2 == pytest.approx(((observed - expected) ** 2 / expected).sum())
    assert r.min_expected == pytest.approx(expected.min()) and r.pct_expected_lt_5 == pytest.approx(100 * (expected < 5).mean())


def test_pairs_with_nulls_and_without_are_alike(spark):
    rng = random.Random(2)
    data = [(rng.choice([1.0, 2.0, 5.0]), rng.gauss(0, 1), rng.gauss(0, 1) if i % 5 else None, rng.choice("pqr"), "s" if i == 3 else rng.choice(["t", "u", None])) for i in range(200)]
    df = spark.createDataFrame(data, "a double, b double, c double, k string, l string")
    got = {(r.field_1, r.field_2): r for r in association.numeric_pairs(df, ["a", "b", "c"]).collect()}

    def ranks(x):
        return np.array([(np.sum(x < v) + np.sum(x <= v) + 1) / 2 for v in x])

    for (i, a), (j, b) in (((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))):
        both = np.array([(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None])
        assert got[a, b].signed_effect == pytest.approx(np.corrcoef(ranks(both[:, 0]), ranks(both[:, 1]))[0, 1])
    mixed = {(r.field_1, r.field_2): r.effect for r in association.mixed_pairs(df, ["k", "l"], ["a", "c"]).collect()}
    for (i, k), (j, v) in ((((3, "k"), (0, "a"))), ((3, "k"), (2, "c")), ((4, "l"), (0, "a")), ((4, "l"), (2, "c"))):
        rows = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        names = [x for x, _ in rows]
        rows = [(x, y) for x, y in rows if names.count(x) > 1]
        x, y = np.array([r[0] for r in rows]), ranks(np.array([r[1] for r in rows]))
        n, groups = len(rows), np.unique(x)
        ties = sum(t**3 - t for t in np.unique(y, return_counts=True)[1])
        h = 12 / (n * (n + 1)) * sum((x == g).sum() * (y[x == g].mean() - (n + 1) / 2) ** 2 for g in groups) / (1 - ties / (n**3 - n))
        assert mixed[k, v] == pytest.approx(max(0, (h - len(groups) + 1) / (n - len(groups))))


def test_few_tests_and_many_get_the_same_rates(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, None if i % 50 == 0 else round(rng.random() ** 3, 2)) for i in range(400)], "i int, p_value double").repartition(4)
    few, many = ({r.i: r.q_value for r in association.benjamini_hochberg(df, most=m).collect()} for m in (400, None))
    assert few == pytest.approx(many) and len(few) == 400
