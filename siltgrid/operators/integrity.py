"""Contract checks: uniqueness, hashes, agreement within tolerance, frozen results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table itself, or a ValueError that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def verify(actual: DataFrame, stated: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): ok, mismatched, missing (not stated) or absent (stated only)."""
    a, s = actual.select(key, F.col(digest).alias("_a")), stated.select(key, F.col(digest).alias("_s"))
    status = F.when(F.col("_s").isNull(), "missing").when(F.col("_a").isNull(), "absent").when(F.col("_a") != F.col("_s"), "mismatched").otherwise("ok")
    return a.join(s, key, "full").select(key, status.alias("status"))


def against_first(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per field, the greatest absolute difference from the row of least key."""
    first = df.agg(*(F.min_by(f, key).alias(f"_{f}") for f in fields))  # one row
    wide = df.crossJoin(F.broadcast(first)).agg(*(F.max(F.abs(F.col(f) - F.col(f"_{f}"))).alias(f) for f in fields))
    return wide.unpivot([], list(fields), "field", "most_off")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_once(df: DataFrame, path: str) -> None:
    """Write a frozen result; an existing one is never touched."""
    df.write.mode("errorifexists").parquet(path)
