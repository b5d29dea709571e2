"""Token ids in a binary format of shuffled planes.

The ids of all documents, in ascending doc_id order, are cut into blocks of a
fixed number of ids.  A block's little-endian 32-bit ids are transposed into 4
byte planes or 32 bit planes, and each plane is compressed with zstandard: the
high planes of small ids are nearly constant and take almost no room.

A dataset is a folder with two Parquet tables, written by Spark so that a lost
task is simply run again: ``blocks`` (planes and the documents that start in
each block) and ``index`` (shard, block, first id, sizes; no planes).  A shard
is one range of doc_ids; its blocks are numbered from 0.

Cases: a null or empty text holds the end id alone.  Repeated rows and rows
that share a doc_id are documents of their own, side by side.  A null doc_id
comes first.  An empty table makes an empty dataset.  Other columns are left
out.  A text longer than a block runs on through the next ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import crc32_combine, in_arrow, kept, partitions, scratch, slices
from tallyframe.llm.encoding import ENCODE_BYTES, ENCODE_ROWS, byte_level

BLOCK_IDS = 65_536

BLOCKS = (
    "shard int, block int, first_id long, n_ids int, plane_bits int, planes array<binary>, "
    "open_row long, open_doc long, open_before long, open_after long, "
    "docs array<struct<row: long, doc_id: long, at: int, n: long>>"
)
_DOC = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])
_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("plane_bits", pa.int32()), ("planes", pa.list_(pa.binary()))]
    + [(c, pa.int64()) for c in ("open_row", "open_doc", "open_before", "open_after")]
    + [("docs", pa.list_(_DOC))]
)


def to_planes(ids: np.ndarray, plane_bits: int = 8, level: int = 1) -> list[bytes]:
    """The compressed planes of one block; ``plane_bits`` is 8 for byte planes, 1 for bit planes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 1:
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
    elif plane_bits == 8:
        planes = np.ascontiguousarray(rows.T)
    else:
        raise ValueError("plane_bits is 1 or 8")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    return [squeeze(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, plane_bits: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(open_(p), np.uint8) for p in planes])
    if plane_bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n_ids].T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(rows.T)
    return rows.reshape(-1).view("<u4")


def write_planes(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    block_ids: int = BLOCK_IDS,
    plane_bits: int = 8,
    shards: int | None = None,
) -> None:
    """Write the token ids of ``docs`` (doc_id, text) as a dataset at ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, row, total = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []  # ids not yet in a block
        n_held = 0
        starts: list[dict] = []  # documents that start among them
        running: tuple[int, int | None, int, int] | None = None  # row, doc_id, ids before this block, ids from it on

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, starts, running, block, total
            ids = np.concatenate(held) if held else np.empty(0, "<u4")
            out, at = [], 0
            while n_held - at >= block_ids or (last and at < n_held):
                n = min(block_ids, n_held - at)
                mine = [d for d in starts if d["at"] < n]
                out.append(
                    {
                        "shard": shard, "block": block, "first_id": total, "n_ids": n, "plane_bits": plane_bits, "planes": to_planes(ids[at : at + n], plane_bits),
                        "open_row": running and running[0], "open_doc": running and running[1], "open_before": running and running[2], "open_after": running and min(running[3], n),
                        "docs": mine,
                    }
                )
                if mine:
                    x = mine[-1]
                    running = (x["row"], x["doc_id"], n - x["at"], x["n"] - (n - x["at"]))
                elif running:
                    running = (running[0], running[1], running[2] + n, running[3] - n)
                if running and running[3] <= 0:
                    running = None
                starts = [d | {"at": d["at"] - n} for d in starts[len(mine) :]]
                at, block, total = at + n, block + 1, total + n
            held, n_held = ([ids[at:]] if at < n_held else []), n_held - at
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)

        for batch in slices(batches, ENCODE_ROWS, ENCODE_BYTES):
            ids, bounds = byte_level(tokenizer).encode(batch.column("text"), end_id)
            held.append(ids)
            for doc_id, at, n in zip(batch.column("doc_id").to_pylist(), (n_held + bounds[:-1]).tolist(), np.diff(bounds).tolist(), strict=True):
                starts.append({"row": row, "doc_id": doc_id, "at": at, "n": n})
                row += 1
            n_held += len(ids)
            if n_held >= 4 * block_ids:
                yield from blocks(False)
        yield from blocks(True)

    spark = docs.sparkSession
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    in_arrow(sorted_docs, encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    index = blocks.select("shard", "block", "first_id", "n_ids", F.size("docs").alias("n_docs"), F.get("docs.doc_id", F.lit(0)).alias("first_doc_id"), F.transform("planes", F.octet_length).alias("plane_bytes"))
    index.write.parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: one row for each shard."""
    total = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


PIECES = "shard int, row long, doc_id long, in_shard long, before long, whole boolean, n long, ids binary"


def _pieces(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    """What each block holds of each document: its ids, or their crc32 as 4 bytes."""
    schema = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("in_shard", pa.int64()), ("before", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            out = []
            for b in batch.to_pylist():
                ids = from_planes(b["planes"], b["n_ids"], b["plane_bits"])
                parts = [] if b["open_row"] is None else [(b["open_row"], b["open_doc"], b["first_id"] - b["open_before"], b["open_before"], False, 0, b["open_after"])]
                parts += [(d["row"], d["doc_id"], b["first_id"] + d["at"], 0, d["at"] + d["n"] <= b["n_ids"], d["at"], min(d["at"] + d["n"], b["n_ids"])) for d in b["docs"]]
                for row, doc, start, before, whole, lo, hi in parts:
                    own = ids[lo:hi].tobytes()
                    out.append((b["shard"], row, doc, start, before, whole, hi - lo, zlib.crc32(own).to_bytes(4, "little") if digest else own))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return in_arrow(spark.read.parquet(f"{path}/blocks"), read, PIECES)


def _joined(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    pieces = kept(_pieces(spark, path, digest), "pieces")  # read twice below
    # Only documents that run over the end of a block (two a block at most) are shuffled.
    split = (
        pieces.filter(~F.col("whole"))
        .groupBy("shard", "row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("in_shard").alias("in_shard"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("before", "n", "ids"))).alias("parts"))
        .select("shard", "doc_id", "in_shard", "n_tokens", "parts")
    )
    whole = pieces.filter("whole").select("shard", "doc_id", "in_shard", F.col("n").alias("n_tokens"), "ids")
    # One row for each shard, of two numbers: small whatever the documents.
    return whole.unionByName((_combined if digest else _concatenated)(split)).join(F.broadcast(shard_starts(spark, path)), "shard").withColumn("start", F.col("shard_start") + F.col("in_shard"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit, as binary) of every document."""
    return _joined(spark, path, False).select("doc_id", "start", "n_tokens", "ids")


def _combined(split: DataFrame) -> DataFrame:
    """The rows of ``split`` with the crc32 of all their parts as ``ids``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                crc = 0
                for p in parts:
                    crc = crc32_combine(crc, int.from_bytes(p["ids"], "little"), 4 * p["n"])
                out.append(crc.to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("shard", "doc_id", "in_shard", "n_tokens")], pa.array(out, pa.binary())], names=["shard", "doc_id", "in_shard", "n_tokens", "ids"])

    return in_arrow(split, step, "shard int, doc_id long, in_shard long, n_tokens long, ids binary")


def _concatenated(split: DataFrame) -> DataFrame:
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return split.select("shard", "doc_id", "in_shard", "n_tokens", ids.alias("ids"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids in its blocks."""
    crc = F.conv(F.concat(*[F.lpad(F.hex(F.substring("ids", k, 1)), 2, "0") for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    return _joined(spark, path, True).select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-planes")
    write_planes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
