"""Token counts through a cache of content digests.

Each text is reduced to a 128-bit digest of its normalised content (runs of
ASCII white space become one space, which the vocabularies meant here drop
anyway).  The digests are joined with the stored counts of the same tokenizer
version; the contents not found there are encoded once each, however many
copies there are, and appended to the cache.  A second run over the same
documents encodes nothing.

The cache is a Parquet folder (digest_a, digest_b, version, n_tokens); the
version is the SHA-256 of the tokenizer's file, so that a changed vocabulary
never meets old counts.

Cases: a null text counts as empty (0 tokens, 0 bytes).  Repeated rows keep a
row each.  An empty table gives no rows.  A digest that a broken run appended
twice is read once.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, kept, scratch, slices
from tallyframe.llm.encoding import ENCODE_BYTES, ENCODE_ROWS, word_counter

CACHE = "digest_a long, digest_b long, version string, n_tokens long"


def content() -> Column:
    """The text whose digest is taken: counts don't depend on how words are spaced."""
    return F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def tokenizer_version(tokenizer: str) -> str:
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer version; no rows where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    rows = rows.filter(F.col("version") == version)
    return rows.groupBy("digest_a", "digest_b").agg(F.max("n_tokens").alias("stored"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and hit (found in the cache) of every row of ``docs``."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ENCODE_ROWS, ENCODE_BYTES):
            n = word_counter(tokenizer).count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest_a"), batch.column("digest_b"), pa.array(n, pa.int64())], names=["digest_a", "digest_b", "n_tokens"])

    digested = docs.select(
        "doc_id",
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        F.xxhash64(content()).alias("digest_a"),
        F.xxhash64(F.lit(1), content()).alias("digest_b"),
    )
    rows = kept(digested, "digests")
    known = kept(stored_counts(spark, cache, version), "stored")
    # One row for each missing digest: the smallest doc_id that has it stands for its copies.
    missing = rows.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("doc_id")).join(known, ["digest_a", "digest_b"], "left_anti")
    named = docs.select("doc_id", "text", F.xxhash64(content()).alias("digest_a"), F.xxhash64(F.lit(1), content()).alias("digest_b"))
    wanted = named.alias("d").join(
        missing.alias("m"),
        (F.col("d.digest_a") == F.col("m.digest_a")) & (F.col("d.digest_b") == F.col("m.digest_b")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")),
        "left_semi",
    )
    encoded = in_arrow(wanted, encode, "digest_a long, digest_b long, n_tokens long").dropDuplicates(["digest_a", "digest_b"])
    encoded.withColumn("version", F.lit(version)).select("digest_a", "digest_b", "version", "n_tokens").write.mode("append").parquet(cache)
    # One small side and one join, so that Spark can split the rows of a digest that many copies share.
    hits = known.select("digest_a", "digest_b", F.lit(True).alias("hit"))
    counts = kept(stored_counts(spark, cache, version).join(hits, ["digest_a", "digest_b"], "left"), "counts")
    return rows.join(counts, ["digest_a", "digest_b"]).select(
        "doc_id", "n_bytes", F.col("stored").alias("n_tokens"), (F.col("stored") > limit).alias("over_limit"), F.coalesce("hit", F.lit(False)).alias("hit")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, scratch(spark, "count-cache"), public_tokenizers.path("word_bpe_49k.json"), 2048)
