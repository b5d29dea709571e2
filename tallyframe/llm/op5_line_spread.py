"""Removal of lines that many sites share.

How many different sites (``source``) hold a line is estimated by one
HyperLogLog sketch for each line hash; sketches merge in the aggregation, so a
line that a third of all documents hold costs one small sketch a task.  Lines
whose estimate is near the threshold, within three standard errors, get an
exact count of distinct sites.  A line at or over the threshold is boilerplate:
it stays in the document with the smallest doc_id that has it and is removed
from all others.

Everything here is DataFrame functions.  Lines meet as 128-bit hashes, never
as texts, and texts are shuffled once, to meet their removed line numbers.

Cases: lines are compared without the white space around them; lines shorter
than ``min_chars`` then (blank ones too) never count.  A null source is no
site.  A null text stays null with 0 lines.  Copies within one document stay or
go together.  Rows that share a doc_id all keep what the first document keeps.
A text that loses all its lines becomes empty.  An empty table gives no rows.
All other columns are kept as they are, whatever their names; input columns
named ``n_lines`` or ``n_removed`` give way to the new ones.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import kept

#: Line hashes of at most so many rows are broadcast (some 10 MB); beyond it the join shuffles.
BROADCAST_LINES = 200_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _keys(first: str, second: str) -> list[Column]:
    """128 bits that a row is known by."""
    return [F.xxhash64(F.lit(n), F.col("doc_id").isNull(), "doc_id", "text").alias(c) for n, c in ((1, first), (2, second))]


def _lines(rows: DataFrame, min_chars: int, *more: str) -> DataFrame:
    """One row for each line that counts: its 128-bit hash and the named columns."""
    each = rows.select(*more, F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).withColumn("_line", _trimmed(F.col("_line")))
    each = each.filter(F.char_length("_line") >= min_chars)
    return each.select(F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(5), "_line").alias("_h2"), "_pos", *more)


def spread_lines(rows: DataFrame, min_sites: int, min_chars: int, lg_k: int = 12) -> DataFrame:
    """(_h1, _h2, _first) of every line that at least ``min_sites`` sites hold."""
    lines = _lines(rows, min_chars, "_site", "_doc")
    band = max(1.0, 3 * 1.04 / sqrt(2**lg_k) * min_sites)
    spread = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", lg_k)).alias("_sites"), F.min("_doc").alias("_first"))
    likely = kept(spread.filter(F.col("_sites") >= min_sites - band), "line-spread")
    near = likely.filter(F.col("_sites") <= min_sites + band).select("_h1", "_h2")
    sure = likely.filter(F.col("_sites") > min_sites + band)
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    exact = lines.join(near, ["_h1", "_h2"], "left_semi").filter(F.col("_site").isNotNull()).groupBy("_h1", "_h2", "_site").agg(F.min("_doc").alias("_d"))
    exact = exact.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_sites")).filter(F.col("_sites") >= min_sites)
    checked = likely.join(exact.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    return kept(sure.unionByName(checked).select("_h1", "_h2", "_first"), "boilerplate")


def remove_spread_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, lg_k: int = 12) -> DataFrame:
    """``docs`` with the removed lines gone from ``text``, and ``n_lines`` and ``n_removed`` beside it."""
    rows = docs.select(
        F.col("doc_id").alias("_doc"), F.col("source").cast("string").alias("_site"), F.col("text").alias("_text"), *_keys("_k1", "_k2")
    )
    boilerplate = spread_lines(rows, min_sites, min_chars, lg_k)
    if boilerplate.count() <= BROADCAST_LINES:
        boilerplate = F.broadcast(boilerplate)
    hits = _lines(rows, min_chars, "_doc", "_k1", "_k2").join(boilerplate, ["_h1", "_h2"]).filter(~F.col("_doc").eqNullSafe(F.col("_first")))
    gone = hits.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_gone"))
    text = F.col("row.text")
    parts = F.split(text, "\n")
    whole = docs.select(F.struct("*").alias("row"), *_keys("_k1", "_k2")).join(gone, ["_k1", "_k2"], "left").select("row", "_gone", parts.alias("_parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_parts"), i)), "\n"))
    return whole.select(
        *[cleaned.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(name) for c, name in (("_parts", "n_lines"), ("_gone", "n_removed"))],
    )


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_spread_lines(docs.select("doc_id", "source", "text"), 5, 1).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), counted AS (
  SELECT trim(line, chr(32) || chr(9) || chr(13)) AS line, count(DISTINCT source) AS sites, min(doc_id) AS first_doc
  FROM lines GROUP BY 1 HAVING length(trim(line, chr(32) || chr(9) || chr(13))) >= 1 AND count(DISTINCT source) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND l.doc_id <> c.first_doc AS gone
  FROM lines l LEFT JOIN counted c ON trim(l.line, chr(32) || chr(9) || chr(13)) = c.line
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(kept_text) END AS text_md5
FROM documents d LEFT JOIN done USING (doc_id)
"""
