"""A store of pixel tables in tiles: Parquet folders by tile row and column, so that a window reads only the tiles it meets.

Values are written with a nodata value in place of nulls, next to one row of metadata for each scene: its extent, its number of
pixels and the tile size. Reading gives the nulls back. The check after writing compares what is there with the metadata.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, nodata: Mapping[str, float], tile: int = 256, scene: str = "scene") -> None:
    """Pixels (scene, r, c, bands); an existing store is not touched. A tile of all scenes is one folder, and tasks write whole tiles."""
    bands = df.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(float(v))) for k, v in nodata.items()})
    at = bands.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))
    at.repartition("tr", "tc", scene).sortWithinPartitions("tr", "tc", scene, "r", "c").write.partitionBy("tr", "tc").mode("errorifexists").parquet(f"{path}/pixels")
    extent = df.groupBy(scene).agg(F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right"), F.count("*").alias("pixels"))
    marks = F.create_map(*(x for k, v in nodata.items() for x in (F.lit(k), F.lit(float(v))))).alias("nodata")
    extent.select("*", F.lit(tile).alias("tile"), marks).write.mode("errorifexists").parquet(f"{path}/scenes")


def window(spark: SparkSession, path: str, top: int, left: int, bottom: int, right: int, scene: str = "scene") -> DataFrame:
    """The pixels of rows top to bottom and columns left to right (both included) of all scenes, nodata as null."""
    about = spark.read.parquet(f"{path}/scenes").select("tile", "nodata").first()
    px = spark.read.parquet(f"{path}/pixels")
    if about is None:
        return px.drop("tr", "tc")
    tile = about["tile"]
    px = px.filter(F.col("tr").between(top // tile, bottom // tile) & F.col("tc").between(left // tile, right // tile) & F.col("r").between(top, bottom) & F.col("c").between(left, right))
    return px.withColumns({k: F.when(F.col(k) != v, F.col(k)) for k, v in about["nodata"].items()}).drop("tr", "tc")


def check(spark: SparkSession, path: str, scene: str = "scene") -> DataFrame:
    """(scene, whole): whether the pixels that are there have the extent, the number and the distinct places that the metadata state, and no more scenes."""
    stated = spark.read.parquet(f"{path}/scenes").drop("tile", "nodata")
    px = spark.read.parquet(f"{path}/pixels")
    real = px.groupBy(scene).agg(F.min("r").alias("_t"), F.min("c").alias("_l"), F.max("r").alias("_b"), F.max("c").alias("_r"), F.count("*").alias("_n"), F.countDistinct("r", "c").alias("_d"))
    same = (F.col("_t") == F.col("top")) & (F.col("_l") == F.col("left")) & (F.col("_b") == F.col("bottom")) & (F.col("_r") == F.col("right")) & (F.col("_n") == F.col("pixels")) & (F.col("_d") == F.col("pixels"))
    return stated.join(real, scene, "full").select(scene, F.coalesce(same, F.lit(False)).alias("whole"))
