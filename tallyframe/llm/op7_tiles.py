"""Nearest neighbours of a stated query set by a block matrix join.

Vectors are packed into blocks of rows: their components, and the same rounded
to int8 under one scale a block.  Query blocks and candidate blocks meet as the
tiles of a grid.  In a tile the int8 product gives every distance up to an
error that is known: by the triangle inequality a true distance differs from
the rounded vectors' distance by at most the sum of the two rounding errors,
whose lengths are kept with each vector.  Only pairs whose lower bound is
within the k-th smallest upper bound met so far are computed in double
precision.  Each task keeps one heap of k for each query through all its tiles,
and the tasks' heaps are merged by rank.  The answer is exact.

Cases: vectors that are null, empty or zero, or hold a null or a non-finite
component, take no part.  Rows that share a vec_id are vectors of their own, as
queries and as candidates.  Vectors are compared only with those of the same length.  Ties go to
the smaller vec_id.  A query with fewer than k candidates gets all of them.  A
null vec_id takes no part.  An empty table, or one without queries, gives no
rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import in_arrow, kept

BLOCK_ROWS = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v, dim) of every row whose vector takes part; ``row`` is a number of its own."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def blocks(vectors: DataFrame, n_blocks: int) -> DataFrame:
    """(dim, block, rows, ids, values): vectors packed under a hash of their row, at most BLOCK_ROWS a row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], list[int], list[np.ndarray]]] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            rows, ids, values = held.pop(key)
            return pa.RecordBatch.from_pydict({"dim": [key[0]], "block": [key[1]], "rows": [np.array(rows, "<i8").tobytes()], "ids": [np.array(ids, "<i8").tobytes()], "values": [np.concatenate(values).astype("<f8").tobytes()]}, schema=schema)

        for batch in batches:
            flat, offsets = np.asarray(batch.column("v").values), np.asarray(batch.column("v").offsets)
            for i, (number, vec_id, dim, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("row", "vec_id", "dim", "block")], strict=True)):
                rows, ids, values = held.setdefault((dim, block), ([], [], []))
                rows.append(number)
                ids.append(vec_id)
                values.append(flat[offsets[i] : offsets[i + 1]])
                if len(ids) >= BLOCK_ROWS:
                    yield row((dim, block))
        for key in list(held):
            yield row(key)

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("values", pa.binary())])
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    return in_arrow(keyed.repartition(n_blocks, "dim", "block").select("row", "vec_id", "v", "dim", "block"), step, "dim int, block int, rows binary, ids binary, values binary")


def rounded(values: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """int8 rows, their scale, the squared lengths of the rows they stand for, and the rounding errors' lengths."""
    scale = max(float(np.abs(values).max()) / 127, 1e-300)
    small = np.rint(values / scale).astype(np.int8)
    back = small.astype(np.float64) * scale
    return small, scale, (back * back).sum(axis=1), np.sqrt(((values - back) ** 2).sum(axis=1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed from the first component on."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - y[:, j]
        total += d * d
    return np.sqrt(total)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, query_blocks: int | None = None, candidate_blocks: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of every query."""
    rows = kept(usable(vectors), "vectors")
    n = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    across = candidate_blocks or max(1, -(-n[0] // (16 * BLOCK_ROWS)))
    down = query_blocks or max(1, -(-n[1] // BLOCK_ROWS))
    # The grid: each query block goes to every column of candidates, each candidate to every row of queries.
    q = blocks(rows.filter(is_query), down).withColumnsRenamed({"block": "down", "rows": "q_rows", "ids": "q_ids", "values": "q_values"}).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    c = blocks(rows, across).withColumnRenamed("block", "across").withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    tiles = q.join(c, ["dim", "down", "across"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}  # by a query block's rows and ids, its k best so far
        for batch in batches:
            for r in range(batch.num_rows):
                dim, q_rows, own_ids, q_values, rows_, ids, values = (batch.column(x)[r].as_py() for x in ("dim", "q_rows", "q_ids", "q_values", "rows", "ids", "values"))
                key = (q_rows, own_ids)
                x, y = np.frombuffer(q_values, "<f8").reshape(-1, dim), np.frombuffer(values, "<f8").reshape(-1, dim)
                q_ids, c_ids = np.frombuffer(own_ids, "<i8"), np.frombuffer(ids, "<i8")
                best_d, best_id = heaps.get(key, (np.full((len(q_ids), k), np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)))
                (a, sa, na, ea), (b, sb, nb, eb) = rounded(x), rounded(y)
                exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # whole numbers, so the product has no error
                dot = (a.astype(exact) @ b.astype(exact).T).astype(np.float64) * (sa * sb)
                about = np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2 * dot, 0))
                slack = ea[:, None] + eb[None, :] + 1e-7 * (1 + np.sqrt(na)[:, None] + np.sqrt(nb)[None, :])
                own = np.frombuffer(q_rows, "<i8")[:, None] == np.frombuffer(rows_, "<i8")[None, :]
                upper = np.where(own, np.inf, about + slack)
                limit = best_d[:, -1]
                if len(c_ids) > k:
                    limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero((about - slack <= limit[:, None]) & ~own)
                d = np.concatenate([best_d.ravel(), distances(x[i], y[j])])
                ids_ = np.concatenate([best_id.ravel(), c_ids[j]])
                who = np.concatenate([np.repeat(np.arange(len(q_ids)), k), i])
                order = np.lexsort((ids_, d, who))
                first = np.searchsorted(who[order], np.arange(len(q_ids)))
                top = order[first[:, None] + np.arange(k)]  # every query has at least its k old entries
                heaps[key] = (d[top], ids_[top])
        out = [np.concatenate(z) for z in zip(*[(*[np.repeat(np.frombuffer(x, "<i8"), k) for x in key], i.ravel(), d.ravel()) for key, (d, i) in heaps.items()], strict=True)] or [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        real = np.isfinite(out[3])
        yield pa.RecordBatch.from_arrays([*[pa.array(x[real], pa.int64()) for x in out[:3]], pa.array(out[3][real], pa.float64())], names=["query_row", "query_id", "vec_id", "score"])

    schema = "query_row long, query_id long, vec_id long, score double"
    found = in_arrow(tiles.select("dim", "q_rows", "q_ids", "q_values", "rows", "ids", "values"), product, schema)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
