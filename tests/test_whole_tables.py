"""Queries that must take in their whole tables, on small tables of their own."""

import random

import pytest

from tallyframe import registry
from tallyframe.operators import association


def test_fdr_takes_all_orders(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.randrange(9) / 100, rng.randrange(11) / 100) for k in range(1, 601) for _ in range(2)]
    spark.createDataFrame(rows, "l_orderkey long, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    p = {k: min(t for o, t, _ in rows if o == k) * min(d for o, _, d in rows if o == k) * 10 for k in range(1, 601)}
    got = {r.field: r for r in registry.QUERIES["assoc_fdr"](spark, str(tmp_path)).collect()}
    assert set(got) == set(p)
    least = 1.0
    for i, k in sorted(enumerate(sorted(p, key=lambda k: (p[k], k)), 1), reverse=True):
        least = min(least, p[k] * len(p) / i)
        assert got[k].p_value == pytest.approx(p[k], abs=1e-6) and got[k].q_value == pytest.approx(least, abs=1e-6)


def test_fdr_has_no_window_over_all_rows(spark):
    rng = random.Random(6)
    values = [None, 0.0, 1.0, 0.5, 0.5, 0.5, *(rng.random() ** 3 for _ in range(3000))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "field long, p_value double").repartition(3)
    q = association.benjamini_hochberg(df)
    assert q.columns == ["field", "p_value", "q_value"]
    filled, want, least = [1.0 if v is None else v for v in values], {}, 1.0
    for i, k in sorted(enumerate(sorted(range(len(filled)), key=filled.__getitem__), 1), reverse=True):
        least = min(least, filled[k] * len(filled) / i)
        want[k] = least
    got = {r.field: r.q_value for r in q.collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == len(values)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(" in line and ("_p#" in line or "_rank#" in line)]
    assert whole and all("windowspecdefinition(_part#" in line and "DESC" not in line.split("windowspecdefinition(")[1].split(",")[0] for line in whole)
    assert association.benjamini_hochberg(df.limit(0)).count() == 0
