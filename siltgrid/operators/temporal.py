"""Time series operators: gaps, stages, as-of lookups, hourly means, extrema.

Ranges are joined by equality on time buckets where either side can grow; the stage table of an event is
a handful of rows and its size is checked before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, for either kind of timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def gaps(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """Each row but a key's first, with the time before it and the days between."""
    w = Window.partitionBy(*key).orderBy(ts)
    out = df.withColumn("previous", F.lag(ts).over(w)).filter(F.col("previous").isNotNull())
    return out.withColumn("gap_days", (seconds(F.col(ts)) - seconds(F.col("previous"))) / 86400)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def in_intervals(df: DataFrame, ts: str, intervals: DataFrame, start: str, end: str, bucket_seconds: float) -> DataFrame:
    """Rows with each half-open interval that holds their time. Both sides meet in time buckets: an equi-join of any size."""
    size = F.lit(float(bucket_seconds))
    spans = intervals.withColumn("_b", F.explode(F.sequence(F.floor(seconds(F.col(start)) / size), F.floor(seconds(F.col(end)) / size))))
    rows = df.withColumn("_b", F.floor(seconds(F.col(ts)) / size))
    return rows.join(spans, "_b").filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str]) -> DataFrame:
    """Left rows with the right values of the latest time that is not after theirs: one union and one window, no pairs."""
    rows = left.select(*key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(None).cast(right.schema[right_ts].dataType).alias("_rt"))
    known = right.select(*key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *values, F.col(right_ts).alias("_rt"))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_rt", *values)), ignorenulls=True).over(w).alias("_seen")
    both = rows.unionByName(known).select("_side", "_row", seen)
    return both.filter("_side = 1").select("_row.*", F.col("_seen._rt").alias("as_of"), *(F.col(f"_seen.{v}").alias(v) for v in values))


def hourly(df: DataFrame, key: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mean per key and hour, with a null for each hour without a reading between a key's first and last."""
    hours = df.groupBy(*key, F.date_trunc("hour", ts).alias("hour")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    span = hours.groupBy(*key).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = span.select(*key, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(hours, [*key, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def extremum(df: DataFrame, key: Sequence[str], value: str, ts: str, trough: Column) -> DataFrame:
    """A key's row of least value where trough holds, else of greatest; the earliest on ties."""
    order = F.when(trough, F.col(value)).otherwise(-F.col(value))
    return first_per_key(df, key, [order, F.col(ts)])
