"""Queries of polygons traced out of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltgrid.operators import raster, tracing
from siltgrid.sources.tables import masks

from .raster_queries import FOUR, cc, rounded
from .registry import query

#: Of four-connected zones: sides towards other pixels, holes by the Euler number, corners by how many of the four pixels at a corner are the zone's.
TRACED_SQL = """, si AS (SELECT scene, component, count(*) AS pixels, 4 * count(*) - 2 * sum(rt + dn) AS sides, 1 - (count(*) - sum(rt + dn) + sum(sq)) AS holes FROM (
  SELECT a.*, (b.component = a.component)::INT AS rt, (d.component = a.component)::INT AS dn, (b.component = a.component AND d.component = a.component AND e.component = a.component)::INT AS sq FROM
  (SELECT * FROM cc) a LEFT JOIN cc b ON b.scene = a.scene AND b.r = a.r AND b.c = a.c + 1 AND b.component = a.component LEFT JOIN cc d ON d.scene = a.scene AND d.r = a.r + 1 AND d.c = a.c AND d.component = a.component
  LEFT JOIN cc e ON e.scene = a.scene AND e.r = a.r + 1 AND e.c = a.c + 1 AND e.component = a.component) GROUP BY ALL),
co AS (SELECT scene, component, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND diagonal THEN 2 ELSE 0 END)::BIGINT AS corners FROM (
  SELECT scene, component, vr, vc, count(*) AS n, min((r + c) % 2) = max((r + c) % 2) AS diagonal FROM (SELECT *, r + i AS vr, c + j AS vc FROM cc, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""


@query("r16_zone_polygons", cc("pred AND NOT ref", FOUR).replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + TRACED_SQL.replace("sum(rt + dn)", "sum(coalesce(rt, 0) + coalesce(dn, 0))").replace("sum(sq)", "sum(coalesce(sq, 0))") + " SELECT scene, component, pixels::DOUBLE AS area_px, sides::BIGINT AS sides, holes::BIGINT AS holes, corners, round(pixels * 0.04::DOUBLE, 6) AS area_ha FROM si JOIN co USING (scene, component)")
def zone_polygons(spark, sf):
    """Rings of each gain zone: its area is the outline's less the holes'."""
    lab = raster.components(masks(spark, sf).withColumn("m", F.col("pred") & ~F.col("ref")), "m", eight=False)
    rings = tracing.trace(lab)
    out = rings.groupBy("scene", "component").agg(F.sum("signed_area").alias("area_px"), F.sum("sides").alias("sides"), F.count_if(F.col("signed_area") < 0).alias("holes"), F.sum("corners").alias("corners"))
    return rounded(out.withColumn("area_ha", F.col("area_px") * 0.04), "area_ha")


@query("r16_polygons_back_to_pixels", cc("pred", FOUR) + " SELECT scene, r, c, component FROM cc")
def polygons_back(spark, sf):
    """Zones become polygons, and the pixels whose centres lie in a polygon are those of its zone."""
    from siltgrid.operators import geometry

    polygons = tracing.zone_polygons(raster.components(masks(spark, sf), "pred", eight=False))
    rings = polygons.select("scene", "component", F.explode("rings").alias("ring"))
    cells = geometry.rasterize_centres(rings, ["scene", "component"], "ring", 1.0)
    return cells.select("scene", (-F.col("gy") - 1).cast("int").alias("r"), F.col("gx").cast("int").alias("c"), "component")
