"""The silhouette takes all rows, at any size."""

import numpy as np
import pytest

from tallyframe.operators import evaluate


def brute(c, x):
    total = 0.0
    for i in range(len(c)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        mean = {k: d[c == k].sum() / max(1, (c == k).sum() - (k == c[i])) for k in np.unique(c)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        total += 0.0 if (c == c[i]).sum() == 1 else (b - a) / max(a, b, 1e-300)
    return total / len(c)


@pytest.mark.parametrize("group", [1 << 15, 3_000])
def test_silhouette_takes_all_rows(spark, group):
    rng = np.random.default_rng(8)
    c = np.concatenate([rng.integers(0, 3, 10_400), [3]])
    x = rng.normal(size=(len(c), 2)) + c[:, None]
    x[5_000:5_100], c[5_000:5_100] = x[5_000], c[5_000]  # copies
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(c, x, strict=True)], "c int, a double, b double")
    assert evaluate.silhouette(df, ["a", "b"], "c", group) == pytest.approx(brute(c, x), abs=1e-9)
    assert evaluate.silhouette(df.filter("c = 1"), ["a", "b"], "c") is None
