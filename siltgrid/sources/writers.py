"""Writers: ordered CSV, strict JSON, GeoJSON features and pixel tables with nodata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Columns in the given order, with a header, as one file for each of the table's partitions."""
    df.select(*columns).write.option("header", True).mode("errorifexists").csv(path)


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with fields by name; a NaN or infinity raises when the row is made."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for n in doubles:
        bad = bad | F.isnan(n) | (F.abs(F.col(n)) == float("inf"))
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number is not finite"))).otherwise(text).alias("value"))


def features(df: DataFrame, properties: Sequence[str], kind: str, coordinates: Column) -> DataFrame:
    """GeoJSON feature texts."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("value"))


def pixels(df: DataFrame, path: str, nodata: dict[str, float], scene: str = "scene") -> None:
    """A pixel table by scene, nulls as each band's nodata value, rows in row-major order within files."""
    out = df.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in nodata.items()})
    out.repartition(scene).sortWithinPartitions(scene, "r", "c").write.partitionBy(scene).mode("errorifexists").parquet(path)


def changed(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of new that old lacks or has with another digest: what staging has to copy."""
    return new.join(old.select(key, digest), [key, digest], "left_anti")
