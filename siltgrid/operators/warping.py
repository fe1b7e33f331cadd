"""Inverse projection, and resampling of tiles onto places of another coordinate system.

A target place finds its source place; it asks the four pixels around it, which are found by an equi-join on their row and column, so
neither the targets nor the source are held whole anywhere. Tiles that overlap are averaged where they do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import FALSE_EASTING, FLATTENING, SCALE, SEMI_MAJOR

#: Rounds of the two fixed points; each gains two digits at least.
ROUNDS = 7


def lonlat(df: DataFrame, easting: str, northing: str, zone: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The rows with longitude and latitude of UTM coordinates (northern hemisphere): the exact inverse of geometry.utm, to rounding.

    The series of the projection is undone by a fixed point, as is the step from the conformal to the geodetic latitude.
    Rounds are columns of their own, so that no expression is computed twice.
    """
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    keep = df.columns
    rows = df.withColumn("_e", (F.col(easting) - FALSE_EASTING) / (SCALE * a)).withColumn("_n", F.col(northing) / (SCALE * a))
    rows = rows.withColumn("_x", F.col("_e")).withColumn("_y", F.col("_n"))
    for _ in range(ROUNDS):
        x, y = F.col("_e"), F.col("_n")
        for j, c in enumerate(alpha, 1):
            x = x - c * F.cos(2 * j * F.col("_y")) * F.sinh(2 * j * F.col("_x"))
            y = y - c * F.sin(2 * j * F.col("_y")) * F.cosh(2 * j * F.col("_x"))
        rows = rows.select(*keep, "_e", "_n", x.alias("_x"), y.alias("_y"))
    # the tangent of the conformal latitude, and asinh of it
    t = F.sin("_y") / F.hypot(F.sinh("_x"), F.cos("_y"))
    rows = rows.select(*keep, F.atan2(F.sinh("_x"), F.cos("_y")).alias("_l"), F.log(t + F.sqrt(t * t + 1)).alias("_q")).withColumn("_s", F.tanh("_q"))
    for _ in range(ROUNDS):
        q = F.col("_q") + e / 2 * F.log((1 + e * F.col("_s")) / (1 - e * F.col("_s")))
        rows = rows.select(*keep, "_l", "_q", F.tanh(q).alias("_s"))
    return rows.select(*keep, (F.degrees("_l") + (6 * zone - 183)).alias(lon), F.degrees(F.asin("_s")).alias(lat))


def mosaic(tiles: DataFrame, row: Column, column: Column, value: str) -> DataFrame:
    """(r, c, v): pixels of all tiles on one grid, averaged where tiles overlap; nulls don't count."""
    return tiles.filter(F.col(value).isNotNull()).groupBy(row.alias("r"), column.alias("c")).agg(F.avg(value).alias("v"))


def bilinear(grid: DataFrame, targets: DataFrame, key: str, fx: Column, fy: Column) -> DataFrame:
    """(key, value): values of a grid (r, c, v) at places given in pixels, whole numbers being centres; where one of the pixels that count lacks, there is no row."""
    at = targets.select(key, fx.alias("_x"), fy.alias("_y")).withColumn("_c", F.floor("_x")).withColumn("_r", F.floor("_y"))
    at = at.withColumn("_x", F.col("_x") - F.col("_c")).withColumn("_y", F.col("_y") - F.col("_r"))
    corner = lambda down, right: F.struct((F.col("_r") + down).alias("r"), (F.col("_c") + right).alias("c"), ((F.col("_y") if down else 1 - F.col("_y")) * (F.col("_x") if right else 1 - F.col("_x"))).alias("w"))
    asked = at.select(key, F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("k")).select(key, "k.*").filter("w > 0")
    met = asked.join(grid.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v"), ["r", "c"])
    return met.groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("value"), F.sum("w").alias("_w")).filter(F.col("_w") > 1 - 1e-9).select(key, "value")
