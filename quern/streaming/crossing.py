"""Streaming counterparts: counts per key and window with a watermark, for feeds that the batch operators also read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Works on a stream or a batch; late rows beyond the watermark are dropped by the stream."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    return timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
