"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` of the session names, set as the checkpoint folder too.

    Where it is unset, as in a local test, a temporary folder is made and set; on a
    cluster that is an error, as executors would each write to a disk of their own.
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


#: Scratch tables of this process that haven't been deleted.
_MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def kept(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition at most where more tasks are to be had.
SPREAD_ROWS = 1 << 16


def spread(df: DataFrame, n_rows: int, most: int = SPREAD_ROWS) -> DataFrame:
    """``df`` in more partitions if it has few for its rows, as a table of one small file has: one for ``most`` rows, up to the cluster's tasks."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // most))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def removed(spark: SparkSession, path: str | None) -> None:
    """Delete what is no longer needed in the shared folder."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleared(spark: SparkSession) -> int:
    """Delete the scratch tables made so far, once no DataFrame that reads them is needed; how many there were."""
    n = len(_MADE)
    while _MADE:
        removed(spark, _MADE.pop())
    return n
