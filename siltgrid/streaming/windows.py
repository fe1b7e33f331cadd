"""Windowed means that run alike on a table and on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, key: Sequence[str], value: str, late: str = "2 hours") -> DataFrame:
    """(start, key, n, mean) per window. On a stream, rows later than `late` behind the newest are dropped and a window is given once it is past; a table drops none."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(F.window(ts, width).alias("w"), *key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *key, "n", "mean")


def first_seen(df: DataFrame, key: Sequence[str], ts: str, late: str = "2 hours") -> DataFrame:
    """One row per key: repeated rows of a stream go, as long as they come within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key)) if df.isStreaming else df.dropDuplicates(list(key))
