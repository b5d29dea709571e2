"""Measures of predictions, each as aggregations over (truth, prediction) columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.describe import ordered_counts, ordered_sums, quantiles
from tallyframe.shared import kept


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mae, rmse and r2, and mean absolute error and bias in the tail from the 90 % quantile of the truth on."""
    y, p = _d(truth), _d(predicted)
    rows = df.select(y.alias("y"), p.alias("p")).dropna()
    cut = F.broadcast(quantiles(rows, [], "y", [0.9], [F.avg("y").alias("mean")]).select(F.col("q")[0].alias("cut"), "mean"))  # one row
    e = F.col("p") - F.col("y")
    tail = F.col("y") >= F.col("cut")
    out = rows.crossJoin(cut).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.sum((F.col("y") - F.col("mean")) ** 2)).alias("r2"), F.avg(F.when(tail, F.abs(e))).alias("tail_mae"), F.avg(F.when(tail, e)).alias("tail_bias"))
    return out.withColumn("tail_warning", F.col("tail_bias") < 0)


def roc_auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Area under the ROC curve from average ranks of the scores."""
    rows = df.select(truth.cast("int").alias("y"), score.alias("s")).dropna()
    ranked = ordered_sums(rows.groupBy("s").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")), "s", "n")
    s = ranked.agg(F.sum(F.col("n1") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    n0 = F.col("n") - F.col("n1")
    some = (F.col("n1") > 0) & (n0 > 0)
    return s.select(F.when(some, (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / F.when(some, F.col("n1") * n0)).alias("roc_auc"))


def average_precision(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Average precision as a step sum over the distinct scores, highest first."""
    rows = df.select(truth.cast("int").alias("y"), score.alias("s")).dropna()
    seen = ordered_counts(rows.select((-F.col("s")).alias("s")), "s").select((-F.col("value")).alias("s"), (F.col("before") + F.col("n")).alias("seen"))
    hits = ordered_counts(rows.filter("y = 1").select((-F.col("s")).alias("s")), "s").select((-F.col("value")).alias("s"), F.col("n").alias("new"), (F.col("before") + F.col("n")).alias("hits"))
    s = hits.join(seen, "s").agg(F.sum(F.col("new") * F.col("hits") / F.col("seen")).alias("total"), F.sum("new").alias("n1"))
    return s.select((F.col("total") / F.col("n1")).alias("pr_auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def binary_metrics(df: DataFrame, truth: str, score: str, threshold: float = 0.31) -> DataFrame:
    """Ranking, threshold and probability measures of a binary score; ``truth`` is 0 or 1."""
    y, s = F.col(truth).cast("int"), _d(score)
    rows = df.select(y.alias("y"), s.alias("s")).dropna()
    hot = F.col("s") >= threshold
    clipped = F.least(F.lit(1 - 1e-8), F.greatest(F.lit(1e-8), F.col("s")))
    m = rows.agg(
        F.count_if((F.col("y") == 0) & ~hot).alias("tn"), F.count_if((F.col("y") == 0) & hot).alias("fp"), F.count_if((F.col("y") == 1) & ~hot).alias("fn"), F.count_if((F.col("y") == 1) & hot).alias("tp"),
        F.avg((F.col("s") - F.col("y")) ** 2).alias("brier"), F.avg(-F.when(F.col("y") == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
    )
    precision, recall, specificity = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn")), _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    m = m.withColumns({"precision": precision, "recall": recall, "balanced_accuracy": (recall + specificity) / 2, "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "threshold": F.lit(threshold)})
    one = m.crossJoin(roc_auc(rows, F.col("y"), F.col("s"))).crossJoin(average_precision(rows, F.col("y"), F.col("s")))  # single rows
    return one.select("pr_auc", "roc_auc", "precision", "recall", "f1", "balanced_accuracy", "brier", "log_loss", "threshold", "tn", "fp", "fn", "tp")


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, recall and f1 of each class, from the confusion counts."""
    cells = df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    actual, given = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("hits")), cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("given"))
    both = actual.join(given, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "given", "hits")])
    return both.select("label", "support", _ratio(F.col("hits"), F.col("support")).alias("recall"), _ratio(2 * F.col("hits"), F.col("support") + F.col("given")).alias("f1"))


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """macro_f1, weighted_f1 and balanced_accuracy."""
    s = class_scores(df, truth, predicted)
    return s.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def probability_metrics(df: DataFrame, truth: str, probabilities: str, n_classes: int) -> DataFrame:
    """log_loss and roc_auc_ovr_macro of class probabilities (an array by class number)."""
    p = F.get(F.col(probabilities), F.col(truth).cast("int"))
    out = df.agg(F.avg(-F.log(F.greatest(F.lit(1e-12), p))).alias("log_loss"))
    aucs = None
    for c in range(n_classes):
        one = roc_auc(df, F.col(truth) == c, F.get(F.col(probabilities), F.lit(c)))
        aucs = one if aucs is None else aucs.unionByName(one)
    return out.crossJoin(aucs.agg(F.avg("roc_auc").alias("roc_auc_ovr_macro")))


def confidence(probabilities: str, least: float = 0.60, margin: float = 0.05) -> dict[str, Column]:
    """Columns confidence (of the likeliest class), margin (to the second) and accepted."""
    top = F.sort_array(F.col(probabilities), asc=False)
    return {"confidence": top[0], "margin": top[0] - top[1], "accepted": (top[0] >= least) & (top[0] - top[1] >= margin)}


def selective(df: DataFrame, truth: str, probabilities: str, least: float = 0.60, margin: float = 0.05) -> DataFrame:
    """What remains when unsure predictions are withheld: coverage, confidence, and accuracy of the accepted."""
    guess = (F.array_position(F.col(probabilities), F.array_max(F.col(probabilities))) - 1).cast("int")
    p = df.select(F.col(truth).cast("int").alias("y"), guess.alias("p"), *[c.alias(name) for name, c in confidence(probabilities, least, margin).items()])
    right = F.avg(F.when(F.col("accepted"), (F.col("y") == F.col("p")).cast("double")))
    s = p.agg(F.avg(F.col("accepted").cast("double")).alias("coverage"), F.avg("confidence").alias("mean_confidence"), F.avg("margin").alias("mean_margin"), right.alias("selective_accuracy"))
    f1 = multiclass_metrics(p.filter("accepted"), "y", "p").select(F.col("macro_f1").alias("selective_macro_f1"))
    return s.crossJoin(f1).select("coverage", (1 - F.col("coverage")).alias("abstention_rate"), "mean_confidence", "mean_margin", "selective_accuracy", "selective_macro_f1")


def cluster_metrics(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores of a clustering, from sums by cluster."""
    rows = df.select(F.col(cluster).alias("c"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    xs = [f"x{i}" for i in range(len(features))]
    centres = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{x}") for x in xs])
    grand = rows.agg(F.count(F.lit(1)).alias("total"), *[F.avg(x).alias(f"g{x}") for x in xs])
    own = sum(((F.col(x) - F.col(f"m{x}")) ** 2 for x in xs), F.lit(0.0))
    within = rows.join(F.broadcast(centres), "c").groupBy("c").agg(F.avg(F.sqrt(own)).alias("spread"), F.sum(own).alias("ss"))
    table = centres.join(within, "c").crossJoin(F.broadcast(grand))
    away = sum(((F.col(f"m{x}") - F.col(f"g{x}")) ** 2 for x in xs), F.lit(0.0))
    ch = table.agg(F.sum(F.col("n") * away).alias("b"), F.sum("ss").alias("w"), F.count(F.lit(1)).alias("k"), F.first("total").alias("n"))
    ch = ch.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    a, b = (table.select("c", "spread", *[f"m{x}" for x in xs]).select(*[F.col(c).alias(f"{c}_{i}") for c in ("c", "spread", *[f"m{x}" for x in xs])]) for i in (1, 2))
    gap = F.sqrt(sum(((F.col(f"m{x}_1") - F.col(f"m{x}_2")) ** 2 for x in xs), F.lit(0.0)))
    # Pairs of clusters, a handful of rows.
    db = a.join(b, F.col("c_1") != F.col("c_2")).groupBy("c_1").agg(F.max((F.col("spread_1") + F.col("spread_2")) / gap).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))
    return ch.crossJoin(db)


#: Points of a group and of a tile: a task holds two groups, and distances of a tile by a tile.
GROUP_POINTS, TILE_POINTS = 1 << 15, 1000


def silhouette(df: DataFrame, features: list[str], cluster: str, group: int = GROUP_POINTS) -> float | None:
    """Mean Euclidean silhouette over all rows, exact at each size; the work grows with the square of the different points.

    Equal rows are one point with a weight.  Points are dealt into groups, and each
    pair of groups is one task's, once: it goes from tile to tile, adds what a
    distance says to the sums of both its points, and gives one row of sums by
    cluster for each of its points.  So a point is shuffled once for each group,
    not for each tile, and so are its sums.
    """
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(F.col(cluster).cast("int").alias("c"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, names, strict=True)]).dropna()
    points = kept(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("id", F.monotonically_increasing_id()), "points")
    sizes = {r["c"]: r["n"] for r in points.groupBy("c").agg(F.sum("w").alias("n")).collect()}  # a row a cluster
    if len(sizes) < 2:
        return None
    kinds = np.array(sorted(sizes))
    n_points, tasks = points.count(), df.sparkSession.sparkContext.defaultParallelism
    # Groups of at most ``group`` points, and enough of them that their pairs keep all tasks busy, if they have a tile's points each.
    groups = max(-(-n_points // group), min(n_points // TILE_POINTS, int((4 * tasks) ** 0.5) + 1), 1)
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    met = points.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = met.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "c", "w", *names)

    def meet(part: pa.Table) -> pa.Table:
        a, b, side = (part.column(c).to_numpy() for c in ("a", "b", "own"))
        x = np.array([part.column(c).to_numpy() for c in names])
        kind = (part.column("c").to_numpy()[:, None] == kinds) * part.column("w").to_numpy()[:, None]
        sums = np.zeros((len(side), len(kinds)))
        first, second = np.flatnonzero(side == a[0]), np.flatnonzero(side == b[0])
        same = a[0] == b[0]
        for i in range(0, len(first), TILE_POINTS):
            for j in range(i if same else 0, len(second), TILE_POINTS):
                p, q = first[i : i + TILE_POINTS], second[j : j + TILE_POINTS]
                d = np.sqrt(sum((v[p][:, None] - v[q][None, :]) ** 2 for v in x))
                sums[p] += d @ kind[q]
                if not same or i != j:
                    sums[q] += d.T @ kind[p]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(side) + 1) * len(kinds), pa.int32()), pa.array(sums.ravel()))
        return pa.table({"id": part.column("id"), "c": part.column("c"), "w": part.column("w"), "sums": lists})

    sums = met.groupBy("a", "b").applyInArrow(meet, "id long, c int, w double, sums array<double>")
    sums = sums.groupBy("id").agg(F.first("c").alias("c"), F.first("w").alias("w"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(kinds))])
    n = [float(sizes[k]) for k in kinds.tolist()]
    mine = [F.col("c") == int(k) for k in kinds]
    size = F.coalesce(*[F.when(m, F.lit(v)) for m, v in zip(mine, n, strict=True)])
    near = F.coalesce(*[F.when(m, F.col(f"s{i}")) for i, m in enumerate(mine)]) / F.greatest(F.lit(1.0), size - 1)
    away = F.array_min(F.array(*[F.when(~m, F.col(f"s{i}") / v) for i, (m, v) in enumerate(zip(mine, n, strict=True))]))
    s = F.when(size == 1, 0.0).otherwise((away - near) / F.greatest(near, away, F.lit(1e-300)))
    return sums.agg(F.sum(s * F.col("w")) / F.sum("w")).first()[0]
