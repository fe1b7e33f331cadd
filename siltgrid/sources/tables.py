"""Typed views of the standard tables: pixel scenes, gauge readings and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a square scene and the area of its pixels in hectares.
SIDE, PIXEL_HA = 8, 0.04


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel: (scene, r, c, v, label); scenes are vectors laid out in rows of SIDE."""
    return (
        read(spark, sf_dir, "embeddings")
        .select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
        .select(F.col("vec_id").alias("scene"), F.floor(F.col("pos") / SIDE).cast("int").alias("r"), (F.col("pos") % SIDE).cast("int").alias("c"), F.col("x").cast("double").alias("v"), "label")
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a prediction, a reference, permanent water, validity, elevation and distance to water, all by rule from place and value."""
    px = pixels(spark, sf_dir)
    spot = F.col("r") * SIDE + F.col("c")
    return px.select(
        "*",
        (F.col("v") < 0.0).alias("pred"),
        (F.col("v") + 0.02 * ((spot * 7 + F.col("scene")) % 5 - 2) < 0.0).alias("ref"),
        ((spot + F.col("scene")) % 11 == 0).alias("permanent"),
        ((spot * 3 + F.col("scene")) % 17 != 0).alias("valid"),
        ((spot * 5 + F.col("scene")) % 13).cast("double").alias("elev"),
        (((spot * 11 + F.col("scene")) % 9) * 15).cast("double").alias("dist"),
    )


#: The same views for DuckDB, to stand in a WITH clause.
PIXELS_SQL = "px AS (SELECT vec_id AS scene, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) AS v, label FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
MASKS_SQL = PIXELS_SQL + """, mk AS (SELECT *, v < 0.0 AS pred, v + 0.02::DOUBLE * ((((r * 8 + c) * 7 + scene) % 5) - 2) < 0.0 AS ref, ((r * 8 + c) + scene) % 11 = 0 AS permanent,
  ((r * 8 + c) * 3 + scene) % 17 <> 0 AS valid, CAST(((r * 8 + c) * 5 + scene) % 13 AS DOUBLE) AS elev, CAST((((r * 8 + c) * 11 + scene) % 9) * 15 AS DOUBLE) AS dist FROM px)"""
