"""Helpers that several operators share: scratch tables, batches, checksums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` of the session names it.  Where it is unset, as in
    a local test, a temporary folder is made and set; on a cluster that is an
    error, as executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = known or Path(tempfile.mkdtemp(prefix="tallyframe-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a task takes up at once; a longer text is taken up alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Smaller batches, bounded in rows and in bytes of text."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += np.asarray(pc.fill_null(pc.binary_length(column), 0))
        total, at = np.concatenate(([0], np.cumsum(size))), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def row_key(*columns: str) -> list[Column]:
    """128 bits that tell rows apart by content, nulls included."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit(7), *parts).alias("key_b")]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=64)
def _zero_bytes(k: int) -> tuple[int, ...]:
    """The operator on a crc32 that 2**k zero bytes are."""
    if k:
        half = _zero_bytes(k - 1)
        return tuple(_times(half, x) for x in half)
    power = (0xEDB88320, *[1 << n for n in range(31)])  # one zero bit
    for _ in range(3):
        power = tuple(_times(power, x) for x in power)
    return power


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings joined, from their crc32s and the second's length."""
    for k in range(max(0, length).bit_length()):
        if length >> k & 1:
            first = _times(_zero_bytes(k), first)
    return first ^ second if length > 0 else first


def size_in_bytes(setting: str) -> int:
    """What a setting of Spark such as ``256MB`` or ``4m`` says in bytes; 0 if it says nothing."""
    said = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", setting.lower())
    return int(said[1]) << 10 * " kmgtp".index(said[2] or " ") if said else 0


#: Bytes of a batch between the JVM and Python; a longer row travels alone.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes: long texts count by their length, not as a row.

    The limit is a setting of the session; a smaller one of the user's stays.  At
    the end of a task the worker gives back what it no longer uses.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_in_bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
