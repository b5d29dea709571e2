"""Centroid clustering by dimension-sharded Lloyd iterations, in exact whole numbers.

Vectors are cut into column blocks.  A row of the table of slices holds one
block of columns for a group of rows, so a task needs neither whole vectors nor
whole centroids.  An assignment is made in two steps:

1. For each slice, the exact partial distances of its rows to the centroids'
   slice of the same columns.  Slices of centroids are broadcast: they are as
   large as the parameters ``k`` and ``dims`` say, whatever the table.
2. The blocks of a row group are added up by key, and the argmin is the label.

For an update the labels go back to the slices of their row group.  Every task
sums its slices by block and cluster first; a shard, the block of columns, adds
these sums up and replaces its own slice of the centroids, without seeing
another block.  Labels and centroids of each round are written to the shared
folder, so lineage never spans more than a round and lost executors cost one
round at most.

A row group holds ``GROUP_ROWS`` rows whatever cluster they are in, so large
clusters and repeated rows make no large group; no row is left out.

Cases: rows whose vector is null, has another number of components than
``dims``, or holds a null or non-finite component are not kept.  Repeated rows
count each, also as first centroids, where rows with one vec_id are taken in
the order of their components.  A null vec_id is clustered like others but is
no first centroid.  With fewer usable vectors than ``k`` there are fewer
centroids; with none there are no rows.  Ties go to the smaller number.
Components so large that a squared distance may not fit 64 bits raise
OverflowError.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, kept
from tallyframe.llm.lloyd import all_finite, from_bytes, squared_distances, sums_by, to_bytes, whole

#: Rows of a group: its partial distances are GROUP_ROWS * k numbers.
GROUP_ROWS = 2048
#: The block number under which a group's ids are stored.
IDS = -1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as whole numbers."""
    v = F.col("embedding")
    return vectors.filter((F.size(v) == dims) & all_finite(v)).select(F.col("vec_id").cast("long"), whole(v, scale).alias("v"))


def sliced(rows: DataFrame, dims: int, blocks: int) -> DataFrame:
    """(group, block, n, data): each group's rows cut into blocks of columns; block ``IDS`` has their vec_ids."""
    bounds = block_bounds(dims, blocks)
    schema = pa.schema([("group", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(-1, dims)
            for at in range(0, len(x), GROUP_ROWS):
                part, ids = x[at : at + GROUP_ROWS], batch.column("vec_id").slice(at, GROUP_ROWS)
                known = np.asarray(ids.is_valid()).astype(np.int8)
                data = [to_bytes(np.asarray(ids.fill_null(0))) + known.tobytes(), *[to_bytes(part[:, a:b]) for a, b in bounds]]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(data), pa.int64()), pa.array(range(IDS, len(bounds)), pa.int32()), pa.array([len(part)] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=schema)
                group += 1

    return in_arrow(rows.select("vec_id", "v"), cut, "group long, block int, n int, data binary")


def block_bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = [dims * i // blocks for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def first_centroids(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The vectors whose ids hash smallest, in that order: at most ``k`` rows reach the driver."""
    h = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    found = rows.filter(F.col("vec_id").isNotNull()).orderBy(h, "v").select("v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def with_centroids(slices: DataFrame, centroids: DataFrame) -> DataFrame:
    """Slices of vectors beside the centroids' slice of the same columns; k * dims numbers are broadcast."""
    return slices.join(F.broadcast(centroids), "block")


def assigned(slices: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(group, labels, distances): nearest centroid of every row, and the squared distance."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, n, data, c in zip(*[batch.column(x).to_pylist() for x in ("group", "n", "data", "centroids")], strict=True):
                found = squared_distances(from_bytes(data).reshape(n, -1), from_bytes(c).reshape(k, -1))
                yield pa.RecordBatch.from_pydict({"group": [group], "n": [n], "partial": [to_bytes(found)]}, schema=schema)

    def nearest(blocks: pa.Table) -> pa.Table:
        total = np.zeros(blocks.column("n")[0].as_py() * k, np.int64)
        for data in blocks.column("partial"):
            total += from_bytes(data.as_py())
        total = total.reshape(-1, k)
        labels = total.argmin(axis=1)  # the first of equals
        return pa.table({"group": [blocks.column("group")[0].as_py()], "labels": [to_bytes(labels)], "distances": [to_bytes(total[np.arange(len(total)), labels])]}, schema=merged)

    schema = pa.schema([("group", pa.int64()), ("n", pa.int32()), ("partial", pa.binary())])
    merged = pa.schema([("group", pa.int64()), ("labels", pa.binary()), ("distances", pa.binary())])
    both = with_centroids(slices.filter(F.col("block") != IDS), centroids).select("group", "n", "data", "centroids")
    return in_arrow(both, partial, "group long, n int, partial binary").groupBy("group").applyInArrow(nearest, "group long, labels binary, distances binary")


def updated(slices: DataFrame, labels: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(block, centroids): each shard's slice after replacing every centroid that has vectors by their floored mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, n, data, label in zip(*[batch.column(x).to_pylist() for x in ("block", "n", "data", "labels")], strict=True):
                total, count = sums_by(from_bytes(label), from_bytes(data).reshape(n, -1), k)
                old = held.get(block)
                held[block] = (total + old[0], count + old[1]) if old else (total, count)
        for block, (total, count) in held.items():
            c, at = np.nonzero(np.repeat((count > 0)[:, None], total.shape[1], axis=1))
            columns = [np.full(len(c), block, np.int32), c.astype(np.int32), at.astype(np.int32), total[c, at], count[c]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, old, means in zip(*[batch.column(x).to_pylist() for x in ("block", "centroids", "means")], strict=True):
                new = from_bytes(old).reshape(k, -1).copy()
                for m in means or []:
                    new[m["cluster"], m["at"]] = m["mean"]
                yield pa.RecordBatch.from_pydict({"block": [block], "centroids": [to_bytes(new)]}, schema=slice_schema)

    schema = pa.schema([("block", pa.int32()), ("cluster", pa.int32()), ("at", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
    slice_schema = pa.schema([("block", pa.int32()), ("centroids", pa.binary())])
    members = slices.filter(F.col("block") != IDS).join(labels.select("group", "labels"), "group").select("block", "n", "data", "labels")
    by_shard = in_arrow(members, sums, "block int, cluster int, at int, total long, n long").groupBy("block", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    means = by_shard.withColumn("mean", F.expr("(total - pmod(total, n)) div n")).groupBy("block").agg(F.collect_list(F.struct("cluster", "at", "mean")).alias("means"))
    return in_arrow(centroids.join(means, "block", "left").select("block", "centroids", "means"), replaced, "block int, centroids binary")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:", blocks: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = usable(vectors, dims, scale)
    first = first_centroids(rows, k, prefix)
    if not len(first):
        return spark.createDataFrame([], OUT)
    k, bounds = len(first), block_bounds(dims, blocks)
    slices = kept(sliced(rows, dims, blocks), "slices")
    centroids = spark.createDataFrame([(i, bytearray(to_bytes(first[:, a:b]))) for i, (a, b) in enumerate(bounds)], "block int, centroids binary")
    for _ in range(rounds):
        labels = kept(assigned(slices, centroids, k), "labels")
        centroids = kept(updated(slices, labels, centroids, k).coalesce(1), "centroids")
    return labelled(slices, kept(assigned(slices, centroids, k), "labels"), centroids, k)


def labelled(slices: DataFrame, labels: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """One row for each vector, from the groups' labels and what is known of its cluster."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, label, distance in zip(*[batch.column(x).to_pylist() for x in ("n", "data", "labels", "distances")], strict=True):
                vec_id, known = from_bytes(ids[:-n]), np.frombuffer(ids[-n:], np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(vec_id, mask=known == 0), pa.array(from_bytes(label).astype(np.int32)), pa.array(from_bytes(distance))], names=["vec_id", "cluster", "distance"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shards in batch.column("shards").to_pylist():
                c = np.hstack([from_bytes(s["centroids"]).reshape(k, -1) for s in sorted(shards, key=lambda s: s["block"])])
                sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sha)], names=["cluster", "centroid_sha256"])

    ids = slices.filter(F.col("block") == IDS).join(labels, "group").select("n", "data", "labels", "distances")
    out = kept(in_arrow(ids, opened, "vec_id long, cluster int, distance long"), "clustered")
    by_cluster = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    sha = in_arrow(centroids.agg(F.collect_list(F.struct("block", "centroids")).alias("shards")), hashed, "cluster int, centroid_sha256 string")
    about = by_cluster.crossJoin(F.broadcast(total)).join(F.broadcast(sha), "cluster")  # k rows, and one
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_dimension_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 40, 5, 64, 256, "2:")


def _rounds_sql(rounds: int) -> str:
    """CTEs ``a0`` (labels) and ``c1`` (centroids) up to the last assignment, from ``v`` and ``c0``; all sums are whole."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c{i}.c}}) AS best FROM v, c{i} GROUP BY r
)""")
        if i < rounds:
            out.append(f"""m{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i) GROUP BY c
), c{i + 1} AS MATERIALIZED (
  SELECT c, CAST(coalesce(m{i}.v, c{i}.v) AS BIGINT[]) AS v FROM c{i} LEFT JOIN m{i} USING (c)
)""")
    return ", ".join(out)


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 40
), {_rounds_sql(5)}, named AS (
  SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c5
)
SELECT vec_id, c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM (SELECT *, best.c AS c FROM a5) JOIN v USING (r) JOIN named USING (c)
"""
