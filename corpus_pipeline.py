"""A corpus for training: five stages, each one operator of ``tallyframe.llm``.

Each stage works on all rows that the one before it kept, and its decisions
take effect.  All but the last return the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import kept
from tallyframe.llm.op2_language import keep_identified
from tallyframe.llm.op4_string_tiling import remove_leaks
from tallyframe.llm.op5_line_spread import remove_spread_lines
from tallyframe.llm.op8_superminhash import keep_one_of_each
from tallyframe.llm.op10_best_fit import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; ``und`` and unsure rows go.

    Null, empty and letterless texts are ``und``.  Repeated rows, rows of one
    doc_id and rows without doc_id are judged each by its text, however long.  If
    nothing can be learned from, all rows go.  An empty table stays one.
    """
    return keep_identified(docs, 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five sites or more, short ones too, stay in one document; a document left without text goes.

    Null and empty texts stay as they are.  Rows of one doc_id keep what its first
    document keeps, so repeated rows stay alike.  ``n_chars``, where there is one,
    follows the text; columns called ``n_lines`` or ``n_removed`` are kept.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out, cut = remove_spread_lines(docs.withColumnsRenamed(own), 5, 1), F.col("n_removed") > 0
    out = out.filter(~F.coalesce(cut & (F.trim(F.col("text")) == ""), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    A row repeated in full is there once; of two texts under one doc_id each is
    judged by itself.  Null and blank texts, and rows without doc_id, all stay.
    """
    return keep_one_of_each(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Null and empty texts stay, as does everything if there are no items.  Equal
    rows stay or go together; a very long text is compared as a whole.
    """
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 5, 0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; a
    long text is cut into pieces; an empty table has no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language scores, shingle links, tiles and packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
