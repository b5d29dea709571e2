"""Vector code compression: codebooks for the parts of vectors, by Lloyd iterations whose members stay where they are.

A vector is cut into equal parts, and the parts of each position have a
codebook of their own.  Parts live with their owner, a triple (position, entry,
salt): owners are keys of an RDD that is partitioned once and for all.  A round:

1. Owners add up their resident members; the sums of an entry's owners are
   reduced by key to its new value, parts * entries rows whatever the table.
2. Every owner assigns its members to the new entries.  Members that keep their
   entry stay in their partition; only those that change it migrate, in a
   shuffle of their own.  As both sides have the same partitioner, the union of
   residents and arrivals is made partition by partition, and no resident moves.

The salt spreads an entry over as many owners as the table's rows need for
``OWNER_ROWS`` members each, so an entry that holds all rows makes no large
group either.  Members are kept as arrays, not as records.

DataFrames have no narrow union that keeps a partitioning, which is why this
operator's state is an RDD.  It is persisted, with ``CHECKPOINT`` rounds between
checkpoints in the shared folder, so a lost executor costs a bounded lineage.

Cases: rows whose vector is null or empty, or holds a null or non-finite
component, take no part, and neither do vectors of another length than that of
the smallest vec_id.  If that length isn't a multiple of ``parts`` it is a
ValueError.  Rows that share a vec_id count each, also as first entries, in the
order of their components; a null vec_id comes last.  With fewer vectors than
``entries`` codebooks are smaller; with none there are no rows.  Equal parts
tie, and go to the lower index.  Null labels are one label.  Components so large
that a squared distance may not fit 64 bits raise OverflowError.  Other columns
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, kept, mixed, partitions, shared_dir
from tallyframe.llm.lloyd import all_finite, from_bytes, packed, squared_distances, to_bytes, whole

#: Members of an owner, about, and owners' members in a partition.
OWNER_ROWS, PARTITION_ROWS = 1 << 14, 1 << 18
#: Rounds between checkpoints.
CHECKPOINT = 3
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"

#: A block of an owner: its key, and the rows and parts of some members.
Block = tuple[int, tuple[np.ndarray, np.ndarray]]


def place(owner: int) -> int:
    """The partition of an owner: one function, so that all partitioners of a run are equal."""
    return owner


def _assigned(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part, the lower of two, and the squared distance."""
    d = squared_distances(parts, codebook)
    entry = d.argmin(axis=1)
    return entry, d[np.arange(len(d)), entry]


def gathered(blocks: Iterator[Block]) -> Iterator[Block]:
    """One block for each owner: what stayed and what arrived."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for owner, members in blocks:
        held.setdefault(owner, []).append(members)
    for owner in list(held):
        rows, parts = zip(*held.pop(owner), strict=True)
        yield owner, (np.concatenate(rows), np.concatenate(parts))


class Owners:
    """The owners of ``positions`` codebooks of ``entries`` entries, each in ``salts`` parts."""

    def __init__(self, entries: int, salts: int):
        self.entries, self.salts = entries, salts

    def position(self, owner: int) -> int:
        return owner // (self.entries * self.salts)

    def entry(self, owner: int) -> int:
        return owner // self.salts % self.entries

    def blocks(self, position: int, rows: np.ndarray, parts: np.ndarray, entry: np.ndarray) -> Iterator[Block]:
        """Members dealt out to the owners of their entries."""
        salt = (mixed(rows.astype(np.uint64)) % np.uint64(self.salts)).astype(np.int64)
        owner = (position * self.entries + entry) * self.salts + salt
        order = np.argsort(owner, kind="stable")
        ends = np.flatnonzero(np.diff(owner[order])) + 1
        for at in np.split(order, ends):
            if len(at):
                yield int(owner[at[0]]), (rows[at], packed(parts[at]))


def assigned_once(rows: DataFrame, codebooks: np.ndarray, owners: Owners) -> RDD:
    """Blocks of all parts, under the owners of their first entries."""
    n_parts, _, width = codebooks.shape

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, v = np.asarray(batch.column("row")), np.asarray(batch.column("v").flatten()).reshape(-1, n_parts, width)
            out = [block for p in range(n_parts) for block in owners.blocks(p, number, v[:, p], _assigned(v[:, p], codebooks[p])[0])]
            if out:
                yield pa.RecordBatch.from_pydict({"owner": [o for o, _ in out], "rows": [to_bytes(r) for _, (r, _) in out], "parts": [to_bytes(x) for _, (_, x) in out]}, schema=schema)

    schema = pa.schema([("owner", pa.int64()), ("rows", pa.binary()), ("parts", pa.binary())])
    dealt = in_arrow(rows.select("row", "v"), deal, "owner long, rows binary, parts binary")
    return dealt.rdd.map(lambda r: (r[0], (from_bytes(r[1]), packed(from_bytes(r[2]).reshape(-1, width)))))


def entry_sums(state: RDD, owners: Owners, width: int) -> list[tuple[tuple[int, int], tuple[np.ndarray, int]]]:
    """((position, entry), (sum, count)) of the entries that have members."""

    def sums(blocks: Iterator[Block]) -> Iterator[tuple[tuple[int, int], tuple[np.ndarray, int]]]:
        for owner, (rows, parts) in blocks:
            yield (owners.position(owner), owners.entry(owner)), (parts.sum(axis=0, dtype=np.int64), len(rows))

    return state.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(8, state.getNumPartitions())).collect()


def moved(state: RDD, codebooks: np.ndarray, owners: Owners) -> RDD:
    """(owner, (stays, members)): every owner's members that keep their entry, and the others under their new owners."""

    def step(blocks: Iterator[Block]) -> Iterator[tuple[int, tuple[bool, tuple[np.ndarray, np.ndarray]]]]:
        for owner, (rows, parts) in gathered(blocks):
            p, old = owners.position(owner), owners.entry(owner)
            entry, _ = _assigned(parts.astype(np.int64), codebooks[p])
            same = entry == old
            if same.any():
                yield owner, (True, (rows[same], parts[same]))
            for new, members in owners.blocks(p, rows[~same], parts[~same], entry[~same]):
                yield new, (False, members)

    return state.mapPartitions(step, preservesPartitioning=True)


def next_state(step: RDD) -> RDD:
    """Residents and arrivals, partition by partition: only those that move are shuffled."""
    residents = step.filter(lambda b: b[1][0]).mapValues(lambda b: b[1])
    # A plain map: what migrates isn't where its key says, so the partitioner must not be kept.
    arrivals = step.filter(lambda b: not b[1][0]).map(lambda b: (b[0], b[1][1])).partitionBy(step.getNumPartitions(), place)
    return residents.union(arrivals)


def codebooks_and_codes(rows: DataFrame, n: int, first: np.ndarray, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """The final codebooks, and (row, position, entry, error) of every part, from ``n`` numbered rows."""
    spark = rows.sparkSession
    shared_dir(spark)
    n_parts, entries, width = first.shape
    owners = Owners(entries, max(1, -(-n // OWNER_ROWS)))
    n_partitions = max(partitions(spark), -(-n * n_parts // PARTITION_ROWS))
    codebooks, held = first.copy(), []
    state = assigned_once(rows, codebooks, owners).partitionBy(n_partitions, place)
    for r in range(rounds):
        for (p, e), (total, count) in entry_sums(state, owners, width):
            codebooks[p, e] = total // count  # floors
        if r == rounds - 1:
            break
        step = moved(state, codebooks.copy(), owners).persist(StorageLevel.MEMORY_AND_DISK)
        if r % CHECKPOINT == CHECKPOINT - 1:
            step.checkpoint()
        held.append(step)
        state = next_state(step)
        if len(held) > 2:
            held.pop(0).unpersist()

    def final(blocks: Iterator[Block]) -> Iterator[tuple[int, bytearray, bytearray, bytearray]]:
        for owner, (number, parts) in gathered(blocks):
            p = owners.position(owner)
            entry, error = _assigned(parts.astype(np.int64), codebooks[p])
            yield p, bytearray(to_bytes(number)), bytearray(to_bytes(entry)), bytearray(to_bytes(error))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, number, entry, error in zip(*[batch.column(c).to_pylist() for c in ("position", "rows", "entries", "errors")], strict=True):
                number = from_bytes(number)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(number), p, np.int32)), pa.array(from_bytes(entry).astype(np.int32)), pa.array(from_bytes(error))], names=["row", "position", "entry", "error"])

    blocks = spark.createDataFrame(state.mapPartitions(final), "position int, rows binary, entries binary, errors binary", verifySchema=False)
    codes = kept(in_arrow(blocks, opened, "row long, position int, entry int, error long"), "codes")
    for step in held:
        step.unpersist()
    return codebooks, codes


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    fine = vectors.filter((F.size(v) > 0) & all_finite(v)).select(F.col("vec_id").cast("long"), "label", whole(v, scale).alias("v"))
    order = (F.asc_nulls_last("vec_id"), F.asc("v"))
    smallest = fine.orderBy(*order).limit(1).collect()
    if not smallest:
        return spark.createDataFrame([], OUT)
    dims = len(smallest[0].v)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    rows = kept(fine.filter(F.size("v") == dims).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)  # as many as a codebook has
    codebooks, codes = codebooks_and_codes(rows, rows.count(), first.reshape(len(first), parts, -1).transpose(1, 0, 2), rounds)
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry").cast("long"))))), 2, "0") for p in range(parts)]
    coded = codes.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    named = kept(rows.select("row", "vec_id", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("a_label")).join(coded, "row"), "coded")
    by_label = named.groupBy("no_label", "a_label").agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return named.join(by_label, ["no_label", "a_label"]).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, 16, 6, 4096)


def _rounds_sql(rounds: int) -> str:
    """CTEs ``a0`` (entries of parts) and ``c1`` (codebooks) up to the last assignment, from ``parts`` and ``c0``; all sums are whole."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, min({{'d': list_sum(list_transform(list_zip(x.v, c{i}.v), lambda y: (y[1] - y[2]) * (y[1] - y[2]))), 'e': c{i}.e}}) AS best FROM parts x JOIN c{i} USING (p) GROUP BY r, p
)""")
        if i < rounds:
            out.append(f"""m{i} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
    SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(v) AS y, unnest(range(len(v))) AS j FROM a{i} JOIN parts USING (r, p)) GROUP BY p, e, j) GROUP BY p, e
), c{i + 1} AS MATERIALIZED (
  SELECT p, e, CAST(coalesce(m{i}.v, c{i}.v) AS BIGINT[]) AS v FROM c{i} LEFT JOIN m{i} USING (p, e)
)""")
    return ", ".join(out)


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM v, (SELECT unnest(range(8)) AS p)
), c0 AS MATERIALIZED (
  SELECT p, CAST(r - 1 AS INTEGER) AS e, v FROM parts WHERE r <= 16
), {_rounds_sql(6)}, coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), books
"""
