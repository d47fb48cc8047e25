"""Event-time windows. Give a stream a watermark first; a batch table needs none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, stamp: str = "ts", late: str = "14 days") -> DataFrame:
    """Events with a watermark on ``stamp`` as a timestamp; rows later than ``late`` may be dropped by the stream."""
    return events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)


def counts_by_window(events: DataFrame, length: str, by: list[str], slide: str | None = None, stamp: str = "ts", value: str = "value") -> DataFrame:
    """Events and their summed value in tumbling (or, with ``slide``, sliding) windows."""
    w = F.window(F.col(stamp).cast("timestamp") if dict(events.dtypes)[stamp] != "timestamp" else F.col(stamp), length, slide) if slide else F.window(F.col(stamp), length)
    out = events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "events", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, by: list[str], stamp: str = "ts") -> DataFrame:
    """Sessions of events less than ``gap`` apart."""
    out = events.groupBy(F.session_window(F.col(stamp), gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.max(stamp).alias("last_event"))
    return out.select(*by, F.col("w.start").alias("start"), "last_event", "events")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: state stays bounded."""
    return stream.dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
