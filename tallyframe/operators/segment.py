"""Segmentation: standardised principal components and k-means, and what marks each segment."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.operators.evaluate import cluster_metrics, silhouette
from tallyframe.operators.features import derived_fields, medians, numeric_columns
from tallyframe.operators.kmeans import Centres, kmeans
from tallyframe.operators.profile import field_roles
from tallyframe.plans.policies import SEGMENTATION, Segmentation
from tallyframe.shared import kept, spread

#: Outcomes of a campaign, which don't describe a customer.
OUTCOMES = ("response", "complain")


def segment_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with derived fields, and its numeric columns without ids, constants and outcomes."""
    gone = field_roles(df).excluded
    names = [c for c in df.columns if c.lower().startswith("acceptedcmp") or c.lower() in OUTCOMES]
    rows = derived_fields(df.drop(*gone, *names))
    features = numeric_columns(rows)
    if len(features) < 2:
        raise ValueError("segmentation takes at least two numeric fields")
    return rows, features


@dataclass
class Segments:
    """A segmentation: its rows (the features as they were, with ``segment``), the evidence, and what was fitted."""

    rows: DataFrame
    features: list[str]
    excluded: list[str]
    medians: dict[str, float]
    scaler: StandardScalerModel
    pca: PCAModel
    model: Centres
    evidence: dict


def fit_segments(df: DataFrame, policy: Segmentation = SEGMENTATION) -> Segments:
    rows, features = segment_features(df)
    fill = medians(rows, features)
    raw = spread(rows.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(c) for c in features]), df.count())
    filled = raw.select("_row", F.struct(*features).alias("raw"), *[F.coalesce(F.col(c), F.lit(fill.get(c, 0.0))).alias(c) for c in features])
    wide = VectorAssembler(inputCols=features, outputCol="v").transform(filled).select("_row", "raw", "v")
    scaler = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(wide)
    scaled = scaler.transform(wide).persist()
    pca = PCA(k=len(features), inputCol="z", outputCol="c").fit(scaled)
    running = list(accumulate(pca.explainedVariance))
    m = next((i + 1 for i, v in enumerate(running) if v > policy.variance), len(features))
    axes = [f"pc{i}" for i in range(m)]
    reduced = pca.transform(scaled).withColumn("pc", vector_to_array("c")).select("_row", "raw", *[F.col("pc")[i].alias(c) for i, c in enumerate(axes)])
    reduced = kept(reduced, "reduced")
    best = kmeans(reduced, axes, "_row", policy.clusters, policy.starts, policy.seed)
    labelled = kept(reduced.withColumn("segment", best.nearest(axes)), "labelled")
    scores = cluster_metrics(labelled, axes, "segment").first()
    evidence = {"silhouette": silhouette(labelled, axes, "segment"), "calinski_harabasz": scores[0], "davies_bouldin": scores[1], "pca_dimensions": m, "pca_variance": float(running[m - 1])}
    scaled.unpersist()
    return Segments(labelled.select("raw.*", "segment"), features, [c for c in df.columns if c not in features], fill, scaler, pca, best, evidence)


def segments(df: DataFrame, policy: Segmentation = SEGMENTATION) -> tuple[DataFrame, dict]:
    """``df``'s features as they are with ``segment``, and the evidence for it."""
    fit = fit_segments(df, policy)
    return fit.rows, fit.evidence


def segment_profile(df: DataFrame, features: list[str], segment: str, top: int = 3) -> DataFrame:
    """segment, size_pct, field, mean, z, side and place: the features that stand out most, up and down.

    z is the segment's mean less the overall mean, in overall standard deviations.
    """
    cells = df.select(F.col(segment).alias("segment"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select("segment", "f.*")
    sizes = df.groupBy(F.col(segment).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("size_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    overall = cells.groupBy("field").agg(F.avg("x").alias("grand"), F.stddev_samp("x").alias("sd"))
    means = cells.groupBy("segment", "field").agg(F.avg("x").alias("mean")).join(F.broadcast(overall), "field")  # a row a field
    z = means.withColumn("z", F.when(F.col("sd") > 0, (F.col("mean") - F.col("grand")) / F.when(F.col("sd") > 0, F.col("sd"))))
    parts = []
    for side, order in (("high", F.desc("z")), ("low", F.asc("z"))):
        w = Window.partitionBy("segment").orderBy(order, "field")
        parts.append(z.filter("z IS NOT NULL").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "segment").select("segment", "size_pct", "field", "mean", "z", "side", "place")
