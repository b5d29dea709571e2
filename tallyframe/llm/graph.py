"""Connected components of an edge table, without any part of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Union-find as alternating stars: in turn each node hands its larger, then its
    smaller neighbours to the smallest one it knows, until every node hangs on
    its root.  Each turn is two aggregations and joins on node ids, and writes
    its edges to the shared folder.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written by itself, so that Spark can split the edges of a node with very many neighbours in the join.
        root = kept(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root")), "roots")
        large = both.join(root, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        edges = kept(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
