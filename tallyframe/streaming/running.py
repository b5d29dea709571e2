"""Running statistics over a stream: an extension beside the batch operators.

Counts, means and spreads by window and key are sums, so they stream with a
watermark; late rows within it are added, later ones dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_statistics(events: DataFrame, time: str, key: str, value: str, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """window_start, key, n, mean and sd; works on a stream as on a table."""
    x = F.col(value).cast("double")
    if events.isStreaming:  # watermarks are for timestamps with a zone
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    out = events.withWatermark(time, watermark).groupBy(F.window(time, window), F.col(key)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "mean", "sd")
