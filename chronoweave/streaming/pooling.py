"""Pooling on a stream: fixed windows stand for bins; late spans count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_pool(events: DataFrame, time: str, by: list[str], value: str, width: str, late: str) -> DataFrame:
    """(window start, by..., value, n): mean of values in tumbling windows; time may be without a zone (taken as UTC)."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    pooled = stamped.groupBy(F.window("_t", width).alias("_w"), *by).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return pooled.select(F.col("_w.start").alias("start"), *by, "value", "n")
