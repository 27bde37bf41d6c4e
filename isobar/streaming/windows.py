"""Running means over streams: tumbling windows of fixed length, late rows by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_average(rows: DataFrame, time: str, value: str, keys: tuple[str, ...] = (), length: str = "1 day", late: str = "2 days", weight: str | None = None) -> DataFrame:
    """Weighted mean of value by window of time and keys: start, end, keys, value, n.

    Works on streams (state is dropped once late has gone by) and on tables.
    Null values count for nothing; a group of nulls has a null mean.
    """
    t = F.col(time).cast("timestamp")
    rows = rows.withColumn("_t", t)
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    x = F.col(value).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = F.try_divide(F.sum(F.when(x.isNotNull(), w * x)), F.sum(F.when(x.isNotNull(), w)))
    out = rows.groupBy(F.window("_t", length), *keys).agg(mean.alias(value), F.count(x).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, value, "n")
