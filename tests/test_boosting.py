"""Boosting against a plain NumPy booster that grows one fit at a time, node by node."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import boosting
from tallyframe.operators.boosting import MISSING, Fit, column_sample, drawn, fit_binning, grow
from tallyframe.operators.evaluate import binary_metrics, probability_metrics
from tallyframe.operators.models import binary_models, multiclass_models, regression_models
from tallyframe.plans.policies import Boosting
from tallyframe.shared import kept

POLICY = Boosting(trees=3, depth=3, rate=0.3, folds=3, inner_folds=2)


def table(spark, n=300):
    rng, rows = random.Random(4), []
    for i in range(n):
        a, b, c = rng.choice([None, 0.5, 1.0, 2.5, 7.0]), rng.gauss(0, 1), rng.choice(["p", "q", "r", None])
        signal = (a or 1) + (c == "q") * 2 - b
        rows.append((a, b, c, i % 3, i % 2, i, i * 7, signal, int(signal > 2), sum(signal > t for t in (1, 3))))
    return spark.createDataFrame(rows, "a double, b double, c string, fold int, inner int, _row long, _key long, number double, two int, three int").repartition(4)


def one_fit(rows, binning, kind, outputs, policy, trains):
    """Margins of all rows by one fit; loops over nodes, features and cuts, sums over rows."""
    n, n_numeric = len(rows), len(binning.numeric)
    columns = [[r[f] for r in rows] for f in binning.numeric + binning.categorical]
    bins = binning.bins([[math.nan if x is None else x for x in c] if i < n_numeric else c for i, c in enumerate(columns)], n).astype(int)
    train = np.array([trains(r) for r in rows])
    for f, x in enumerate(bins):
        known = np.sort(x[train & (x != MISSING)])
        counts = np.bincount(known)
        bins[f][x == MISSING] = known[(len(known) + 1) // 2 - 1] if f < n_numeric else counts.argmax()
    y = np.array([r["_y"] for r in rows], float)
    margins = np.zeros((outputs, n))
    if kind == "regression":
        margins += y[train].mean()
        weight = np.ones(n)
    else:
        present = np.unique(y[train])
        weight = np.array([train.sum() / (len(present) * max(1, (y[train] == v).sum())) for v in y])
    row = np.array([r["_row"] for r in rows])
    sizes = np.diff(binning.offsets)
    for number in range(policy.trees):
        allowed = column_sample(binning.offsets, n_numeric, number, policy)
        mine = train & drawn(row, number, policy.seed, policy.subsample)
        if kind == "regression":
            g, h = margins - y, np.ones((1, n))
        elif kind == "binary":
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y, p * (1 - p)
        else:
            e = np.exp(margins)
            p = e / e.sum(axis=0)
            g, h = p - (np.arange(outputs)[:, None] == y), 2 * p * (1 - p)
        g, h, added = g * weight, h * weight, np.zeros((outputs, n))

        def grow_node(o, members, level):
            sample = members & mine
            total_g, total_h, best = g[o, sample].sum(), h[o, sample].sum(), (1e-6, None)
            for f in range(len(bins)):
                for cut in range(sizes[f]):
                    if not allowed[binning.offsets[f] + cut]:
                        continue
                    right = bins[f] > cut if f < n_numeric else bins[f] == cut
                    lg, lh = g[o, sample & ~right].sum(), h[o, sample & ~right].sum()
                    rg, rh = g[o, sample & right].sum(), h[o, sample & right].sum()
                    if lh < 1 or rh < 1:
                        continue
                    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, right)
            if best[1] is None or level == policy.depth:
                added[o, members] = -policy.rate * total_g / (total_h + 1)
            else:
                grow_node(o, members & ~best[1], level + 1)
                grow_node(o, members & best[1], level + 1)

        for o in range(outputs):
            grow_node(o, np.ones(n, bool), 0)
        margins = margins + added
    return margins


@pytest.mark.parametrize(("kind", "target", "outputs"), [("regression", "number", 1), ("binary", "two", 1), ("multiclass", "three", 3)])
@pytest.mark.parametrize("partition_rows", [40, 1000])
def test_all_fits_equal_a_plain_booster(spark, monkeypatch, kind, target, outputs, partition_rows):
    monkeypatch.setattr(boosting, "PARTITION_ROWS", partition_rows)
    df = kept(table(spark).withColumn("_y", F.col(target).cast("double")), "test-boosting")
    fits = [Fit(0), Fit(2), Fit(1, 0), Fit()]
    folds = ["fold", *["inner"] * 3]
    grown = grow(df, ["a", "b", "c"], kind, POLICY, fits, outputs if outputs > 1 else 2, folds)
    got = {}
    for block, margins in grown.state.collect():
        got |= {int(r): margins[:, :, i] for i, r in enumerate(block.row)}
    rows = df.collect()
    trains = [lambda r: r["fold"] != 0, lambda r: r["fold"] != 2, lambda r: r["fold"] != 1 and r["inner"] != 0, lambda r: True]
    for i, t in enumerate(trains):
        want = one_fit(rows, grown.binning, kind, outputs, POLICY, t)
        mine = np.array([got[r["_row"]][i] for r in rows]).T
        assert np.abs(mine - want).max() < 1e-9
    held = grown.held_out(spark, [0, 2]).collect()
    assert sorted((r.fit, r["_key"]) for r in held) == sorted([(0, r["_key"]) for r in rows if r["fold"] == 0] + [(2, r["_key"]) for r in rows if r["fold"] != 1 and r["inner"] == 0])
    model = grown.model(3)
    scored = {r["_row"]: r.answers for r in model.scored(df.withColumn("answers_of", F.lit(1))).collect()}
    want = model.layout.answers(np.array([got[r["_row"]][3] for r in rows]).T)
    assert np.abs(np.array([scored[r["_row"]] for r in rows]).T - want).max() < 1e-9


def test_splits_do_not_depend_on_partitions(spark, monkeypatch):
    df = table(spark).withColumn("_y", F.col("number"))
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 40)
    one, many = (grow(kept(df.repartition(n), "test-parts"), ["a", "b", "c"], "regression", POLICY, [Fit()]) for n in (1, 5))
    assert one.state.getNumPartitions() == 1 and many.state.getNumPartitions() > 1
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value) for a, b in zip(one.trees, many.trees, strict=True))


def test_lineage_is_cut(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    monkeypatch.setattr(boosting, "CHECKPOINT", 4)
    grown = grow(kept(table(spark).withColumn("_y", F.col("number")), "test-lineage"), ["a"], "regression", replace(POLICY, trees=12, depth=1), [Fit()])
    assert len(grown.trees) == 12 and grown.state.getNumPartitions() > 1 and grown.state.toDebugString().decode().count("PythonRDD") < 8


def test_odd_columns_and_tables(spark):
    df = table(spark).withColumns({"none": F.lit(None).cast("double"), "no_text": F.lit(None).cast("string"), "same": F.lit(3.0)})
    binning = fit_binning(df, ["a", "none", "same", "c", "no_text"])
    assert (binning.numeric, binning.categorical, binning.values) == (["a", "same"], ["c"], [["p", "q", "r"]])
    assert binning.bins([[0.5, 7.0, math.nan], [3.0, 4.0, 3.0], ["q", "new", None]], 3).tolist() == [[0, 3, MISSING], [0, 0, 0], [1, 3, MISSING]]
    grown = grow(kept(df.withColumn("_y", F.col("number")), "test-none"), [], "regression", POLICY, [Fit()])
    assert grown.trees == [] and grown.model(0).scored(df.limit(1)).first().answers[0] == pytest.approx(df.agg(F.avg("number")).first()[0])


def test_joint_softmax_is_not_worse_than_one_against_the_rest(spark):
    rows = table(spark).select("a", "b", "c", "three")
    joint, _ = multiclass_models(rows, "three", replace(POLICY, trees=20))
    log_loss = probability_metrics(joint, "y", "probabilities", 3).first()["log_loss"]
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns))
    parts = keyed.select(F.monotonically_increasing_id().alias("_row"), "*")
    folds = {r["_key"]: r["y"] for r in joint.collect()}
    assert len(folds) > 280
    scores = []
    for k in range(3):
        one = kept(parts.withColumns({"_y": (F.col("three") == k).cast("double"), "fold": F.pmod("_key", F.lit(3)).cast("int")}), "test-rest")
        scores.append({r["_key"]: r.answers[0] for r in grow(one, ["a", "b", "c"], "binary", replace(POLICY, trees=20), [Fit(i) for i in range(3)], 2, ["fold"]).held_out(spark, [0, 1, 2]).collect()})
    rest = -np.mean([math.log(scores[y][key] / sum(s[key] for s in scores)) for key, y in folds.items()])
    assert log_loss <= rest + 0.02


def test_routes_learn_what_is_there(spark):
    rows = table(spark, 400).drop("_row", "_key", "fold", "inner")
    oof, fitted = binary_models(rows.select("a", "b", "c", "two"), "two", replace(POLICY, trees=30, threshold=0.9))
    m = binary_metrics(oof, "y", "score", 0.9).first()
    assert m["roc_auc"] > 0.9 and oof.filter("prediction <> cast(score >= 0.9 AS int)").count() == 0 and oof.filter("score <> uncalibrated").count() > 0
    scored = fitted.score(rows.select("a", "b", "c"))
    assert fitted.threshold == 0.9 and scored.filter("prediction <> cast(probabilities[1] >= 0.9 AS int)").count() == 0
    assert scored.filter("prediction = 1").count() > 0 and scored.filter("probabilities[1] BETWEEN 0.31 AND 0.89 AND prediction = 0").count() > 0
    oof, fitted = regression_models(rows.select("a", "b", "c", "number"), "number", replace(POLICY, trees=30))
    assert oof.count() == 400 and oof.select(F.corr("y", "prediction")).first()[0] > 0.9
    assert fitted.score(rows.select("a", "b", "c")).select(F.avg("prediction")).first()[0] == pytest.approx(rows.agg(F.avg("number")).first()[0], abs=0.05)
