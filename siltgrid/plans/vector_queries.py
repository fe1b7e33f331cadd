"""Queries of clipping, overlap, unions, distances and rasterizing of vector features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.operators import geometry, nearest, raster
from siltgrid.sources.tables import MASKS_SQL, PIXELS_SQL, masks, pixels, read

from . import registry
from .raster_queries import ERODE_SQL, FOUR, cc, rounded
from .registry import query
from .spatial_queries import BOXES_SQL, CELL, DISTANCE, LINES_SQL, POINTS_SQL, boxes, length_in_boxes, lines, points

#: The area of interest, and a second set of boxes that overlaps the first.
AOI = (500.0, 400.0, 3800.0, 2900.0)
SHIFTED_SQL = f"{BOXES_SQL}, sh AS (SELECT box AS other, l + 150 AS l2, b + 100 AS b2, r + 150 AS r2, t + 100 AS t2 FROM bx)"


def shifted(spark, sf):
    return boxes(spark, sf).select(F.col("box").alias("other"), (F.col("l") + 150).alias("l2"), (F.col("b") + 100).alias("b2"), (F.col("r") + 150).alias("r2"), (F.col("t") + 100).alias("t2"))


def ring_of(left, bottom, right, top):
    p = lambda x, y: geometry.point(F.col(x), F.col(y))
    return F.array(p(left, bottom), p(right, bottom), p(right, top), p(left, top), p(left, bottom))


def triangle():
    p = lambda x, y: geometry.point(F.col(x), F.col(y))
    return F.array(p("l", "b"), p("r", "b"), p("l", "t"), p("l", "b"))


@query("j17_points_in_polygons", f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id, box FROM pt JOIN bx ON x >= l AND y >= b AND y < t AND x < (l - r) * (y - b) / (t - b) + r")
def points_in_polygons(spark, sf):
    tri = boxes(spark, sf).select("box", triangle().alias("ring"))
    return geometry.points_in_rings(points(spark, sf), tri, "ring", 250.0).select("id", "box")


@query("j21_overlap_area", f"WITH {SHIFTED_SQL} SELECT box, other, round((least(r, r2) - greatest(l, l2)) * (least(t, t2) - greatest(b, b2)), 6) AS overlap FROM bx, sh WHERE least(r, r2) > greatest(l, l2) AND least(t, t2) > greatest(b, b2)")
def overlap_area(spark, sf):
    """Polygons clipped by the boxes that they meet in a grid cell; of several shared cells the one of their common corner counts."""
    a = geometry.spread(boxes(spark, sf).withColumn("ring", ring_of("l", "b", "r", "t")), F.col("l"), F.col("b"), F.col("r"), F.col("t"), 500.0)
    b = geometry.spread(shifted(spark, sf), F.col("l2"), F.col("b2"), F.col("r2"), F.col("t2"), 500.0)
    corner = (F.floor(F.greatest("l", "l2") / 500) == F.col("gx")) & (F.floor(F.greatest("b", "b2") / 500) == F.col("gy"))
    overlaps = (F.greatest("l", "l2") < F.least("r", "r2")) & (F.greatest("b", "b2") < F.least("t", "t2"))
    met = geometry.clip_ring(a.join(b, ["gx", "gy"]).filter(corner & overlaps).select("box", "other", "ring", "l2", "b2", "r2", "t2"), "ring", "l2", "b2", "r2", "t2")
    return rounded(met.select("box", "other", F.when(F.size("ring") >= 4, geometry.ring_area("ring")).otherwise(0.0).alias("overlap")), "overlap")


@query("g06_polygon_intersection", f"WITH {BOXES_SQL}, k AS (SELECT box, greatest(l, 500) AS l, greatest(b, 400) AS b, least(r, 3800) AS r, least(t, 2900) AS t FROM bx) SELECT box, round(greatest(r - l, 0) * greatest(t - b, 0), 6) AS inside FROM k")
def polygon_intersection(spark, sf):
    """Area of each polygon inside the area of interest."""
    rows = boxes(spark, sf).withColumn("ring", ring_of("l", "b", "r", "t"))
    rows = rows.select("box", "ring", *(F.lit(v).alias(n) for n, v in zip(("al", "ab", "ar", "at"), AOI)))
    cut = geometry.clip_ring(rows, "ring", "al", "ab", "ar", "at")
    return rounded(cut.select("box", F.when(F.size("ring") >= 4, geometry.ring_area("ring")).otherwise(0.0).alias("inside")), "inside")


SPAN_SQL = """s AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM ln),
k AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN 500 AND 3800 THEN 0 ELSE 2 END ELSE least((500 - x1) / dx, (3800 - x1) / dx) END,
  CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN 400 AND 2900 THEN 0 ELSE 2 END ELSE least((400 - y1) / dy, (2900 - y1) / dy) END) AS e,
 least(1, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN 500 AND 3800 THEN 1 ELSE -1 END ELSE greatest((500 - x1) / dx, (3800 - x1) / dx) END,
  CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN 400 AND 2900 THEN 1 ELSE -1 END ELSE greatest((400 - y1) / dy, (2900 - y1) / dy) END) AS f FROM s)"""


@query("g02_clip_lines", f"WITH {LINES_SQL}, {SPAN_SQL} SELECT id, round(x1 + e * dx, 6) AS x1, round(y1 + e * dy, 6) AS y1, round(x1 + f * dx, 6) AS x2, round(y1 + f * dy, 6) AS y2 FROM k WHERE f > e")
def clip_lines(spark, sf):
    """The parts of lines inside the area of interest; what is empty goes."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    e, f = geometry.inside_box(x1, y1, x2, y2, *(F.lit(v) for v in AOI))
    at = lambda a, b, t: a + t * (b - a)
    cut = lines(spark, sf).withColumn("e", e).withColumn("f", f).filter("f > e")
    return rounded(cut.select("id", *(at(a, b, F.col(t)).alias(n) for a, b, t, n in ((x1, x2, "e", "x1"), (y1, y2, "e", "y1"), (x1, x2, "f", "x2"), (y1, y2, "f", "y2")))), "x1", "y1", "x2", "y2")


@query("g07_distance_to_union", f"WITH {POINTS_SQL}, {BOXES_SQL}, d AS (SELECT id, min({DISTANCE}) AS d FROM pt, bx GROUP BY id) SELECT id, round(d, 6) AS distance_m FROM d")
def distance_to_union(spark, sf):
    """Distance of points to the union of all boxes, at any distance."""
    p = points(spark, sf).select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    b = boxes(spark, sf).select(F.array(ring_of("l", "b", "r", "t")).alias("rings"))
    return rounded(nearest.distance_to_union(p, b, "id", "rings", 250.0).withColumnRenamed("distance", "distance_m"), "distance_m")


@query("g09_direct_flags", f"SELECT ln.id, coalesce(max(inside_m), 0) > 0 AS direct, count(box) AS boxes FROM (WITH {LINES_SQL} SELECT id FROM ln) ln LEFT JOIN ({registry._ORACLES['g05_length_in_boxes']}) g ON g.id = ln.id GROUP BY 1")
def direct_flags(spark, sf):
    hit = length_in_boxes(spark, sf).groupBy("id").agg(F.max("inside_m").alias("most"), F.count("*").alias("boxes"))
    out = lines(spark, sf).select("id").join(hit, "id", "left")
    return out.select("id", (F.coalesce("most", F.lit(0.0)) > 0).alias("direct"), F.coalesce("boxes", F.lit(0)).cast("long").alias("boxes"))


GRID_SQL = f"{SHIFTED_SQL}, g AS (SELECT unnest(range(0, 110)) AS k), ca AS (SELECT box, x.k AS gx, y.k AS gy FROM bx, g x, g y WHERE (x.k + 0.5) * 50 >= l AND (x.k + 0.5) * 50 < r AND (y.k + 0.5) * 50 >= b AND (y.k + 0.5) * 50 < t), cb AS (SELECT other, x.k AS gx, y.k AS gy FROM sh, g x, g y WHERE (x.k + 0.5) * 50 >= l2 AND (x.k + 0.5) * 50 < r2 AND (y.k + 0.5) * 50 >= b2 AND (y.k + 0.5) * 50 < t2)"


def cell_sets(spark, sf):
    """The cells of both sets of boxes on a 50 m grid."""
    a = geometry.rasterize_centres(boxes(spark, sf).select("box", ring_of("l", "b", "r", "t").alias("ring")), "box", "ring", 50.0)
    b = geometry.rasterize_centres(shifted(spark, sf).select("other", ring_of("l2", "b2", "r2", "t2").alias("ring")), "other", "ring", 50.0)
    return a, b


@query("g10_union_cells", f"WITH {GRID_SQL} SELECT gx, gy, count(*) AS layers FROM (SELECT gx, gy FROM ca UNION ALL SELECT gx, gy FROM cb) GROUP BY 1, 2")
def union_cells(spark, sf):
    a, b = cell_sets(spark, sf)
    return a.select("gx", "gy").unionByName(b.select("gx", "gy")).groupBy("gx", "gy").agg(F.count("*").alias("layers"))


@query("a30_union_area", f"WITH {GRID_SQL}, u AS (SELECT box, gx, gy FROM ca UNION SELECT other, gx, gy FROM cb) SELECT box, round(count(*) * 0.25::DOUBLE, 6) AS union_ha FROM u GROUP BY box")
def union_area(spark, sf):
    """Area of the union of each box and its shifted copy."""
    a, b = cell_sets(spark, sf)
    both = a.unionByName(b.withColumnRenamed("other", "box")).distinct()
    return rounded(both.groupBy("box").agg((F.count("*") * 0.25).alias("union_ha")), "union_ha")


@query("g11_differences", f"WITH {GRID_SQL}, s AS (SELECT coalesce(ca.box, cb.other) AS box, ca.box IS NOT NULL AS a, cb.other IS NOT NULL AS b FROM ca FULL JOIN cb ON ca.box = cb.other AND ca.gx = cb.gx AND ca.gy = cb.gy) SELECT box, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (a <> b) AS differing FROM s GROUP BY box")
def differences(spark, sf):
    a, b = cell_sets(spark, sf)
    first, second = a.withColumn("a", F.lit(True)), b.withColumnRenamed("other", "box").withColumn("b", F.lit(True))
    s = first.join(second, ["box", "gx", "gy"], "full").fillna(False, ["a", "b"])
    x, y = F.col("a"), F.col("b")
    return s.groupBy("box").agg(F.count_if(x & ~y).alias("only_first"), F.count_if(y & ~x).alias("only_second"), F.count_if(x != y).alias("differing"))


@query("u07_difference_empty", f"WITH {GRID_SQL} SELECT (SELECT count(*) FROM (SELECT gx, gy FROM ca EXCEPT SELECT gx, gy FROM cb)) = 0 AS covered, (SELECT count(*) FROM (SELECT box, gx, gy FROM ca EXCEPT SELECT box, gx, gy FROM ca)) = 0 AS same")
def difference_empty(spark, sf):
    """Emptiness of differences of cell sets."""
    a, b = cell_sets(spark, sf)
    a, b = a.select("gx", "gy"), b.select("gx", "gy")
    empty = lambda left, right, name: left.exceptAll(right).agg((F.count("*") == 0).alias(name))
    return empty(a.distinct(), b.distinct(), "covered").crossJoin(empty(a, a, "same"))  # one row each


@query("g12_representative_points", f"WITH {BOXES_SQL}, w AS (SELECT min(l) AS west, max(t) AS north FROM bx) SELECT box, round((2 * l + r) / 3, 6) AS cx, round((2 * b + t) / 3, 6) AS cy, round((l + r) / 2, 6) AS mx, round((b + t) / 2, 6) AS my, west, north FROM bx, w")
def representative_points(spark, sf):
    """Centroid of a triangle by its edges, the middle of its longest side, and the bounds of all."""
    tri = boxes(spark, sf).select("box", "l", "b", "r", "t", triangle().alias("ring"))
    part = geometry.edges(F.col("ring"), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("k"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + f(p))
    k = total(lambda p: p["k"])
    all_ = boxes(spark, sf).agg(F.min("l").alias("west"), F.max("t").alias("north"))  # one row
    rows = tri.withColumn("parts", part).crossJoin(F.broadcast(all_))
    centre = {c: total(lambda p, c=c: p["k"] * p[c]) / (3 * k) for c in "xy"}
    return rounded(rows.select("box", centre["x"].alias("cx"), centre["y"].alias("cy"), ((F.col("l") + F.col("r")) / 2).alias("mx"), ((F.col("b") + F.col("t")) / 2).alias("my"), "west", "north"), "cx", "cy", "mx", "my")


@query("g13_points_from_columns", f"WITH {POINTS_SQL} SELECT id, x, y, 'POINT (' || x::BIGINT || ' ' || y::BIGINT || ')' AS wkt FROM pt")
def points_from_columns(spark, sf):
    p = points(spark, sf).select("id", geometry.point(F.col("x"), F.col("y")).alias("p"))
    whole = [F.col(c).cast("long").cast("string") for c in ("p.x", "p.y")]
    return p.select("id", "p.x", "p.y", F.concat(F.lit("POINT ("), F.concat_ws(" ", *whole), F.lit(")")).alias("wkt"))


@query("g14_validity", f"WITH {BOXES_SQL} SELECT box, box % 4 <> 1 OR box % 5 = 2 AS closed, box % 5 <> 2 AS has_area, box % 4 <> 1 AND box % 5 <> 2 AS valid FROM bx")
def validity(spark, sf):
    """Rings must be closed and have an area; some here are left open or flattened."""
    b = boxes(spark, sf).withColumn("t", F.when(F.col("box") % 5 == 2, F.col("b")).otherwise(F.col("t")))
    rows = b.withColumn("ring", ring_of("l", "b", "r", "t"))
    rows = rows.withColumn("ring", F.when(F.col("box") % 4 == 1, F.slice("ring", 1, 4)).otherwise(F.col("ring")))
    closed = F.element_at("ring", 1) == F.element_at("ring", -1)
    left, bottom, right, top = geometry.bounds(F.col("ring"))
    has_area = (right > left) & (top > bottom)
    return rows.select("box", closed.alias("closed"), has_area.alias("has_area"), (closed & has_area).alias("valid"))


ZONES_SQL = cc("pred AND NOT ref AND valid", FOUR) + ", z AS (SELECT scene, component AS zone, count(*) AS pixels, count(*) FILTER (permanent) AS overlap, min(dist) AS nearest, count(*) FILTER ((r * 8 + c + scene) % 13 = 0) AS places, avg(r) AS mr, avg(c) AS mc FROM cc JOIN mk USING (scene, r, c) GROUP BY 1, 2)"


def zone_table(spark, sf):
    """Contiguous gains with their size, what they overlap, how near the next water is and how many places they hold."""
    px = masks(spark, sf)
    lab = raster.components(px.withColumn("m", F.col("pred") & ~F.col("ref") & F.col("valid")), "m", eight=False)
    place = (F.col("r") * 8 + F.col("c") + F.col("scene")) % 13 == 0
    return lab.join(px, ["scene", "r", "c"]).groupBy("scene", F.col("component").alias("zone")).agg(
        F.count("*").alias("pixels"), F.count_if("permanent").alias("overlap"), F.min("dist").alias("nearest"), F.count_if(place).alias("places"), F.avg("r").alias("mr"), F.avg("c").alias("mc")
    )


@query("g15_zone_table", ZONES_SQL + " SELECT scene, zone, pixels, round(pixels * 0.04::DOUBLE, 6) AS area_ha, overlap, nearest, places, round(mr, 6) AS mr, round(mc, 6) AS mc FROM z")
def zones(spark, sf):
    return rounded(zone_table(spark, sf).withColumn("area_ha", F.col("pixels") * 0.04), "area_ha", "mr", "mc")


@query(
    "r04_all_touched",
    f"""WITH {LINES_SQL}, c AS (SELECT *, unnest(range(floor(least(x1, x2) / 100)::BIGINT, floor(greatest(x1, x2) / 100)::BIGINT + 1)) AS gx FROM ln),
e AS (SELECT *, y1 + (greatest(least(x1, x2), gx * 100) - x1) / nullif(x2 - x1, 0) * (y2 - y1) AS ya, y1 + (least(greatest(x1, x2), (gx + 1) * 100) - x1) / nullif(x2 - x1, 0) * (y2 - y1) AS yb FROM c),
f AS (SELECT id, gx, CASE WHEN x1 = x2 THEN least(y1, y2) ELSE least(ya, yb) END AS lo, CASE WHEN x1 = x2 THEN greatest(y1, y2) ELSE greatest(ya, yb) END AS hi FROM e)
SELECT DISTINCT id, gx, unnest(range(floor(lo / 100)::BIGINT, floor(hi / 100)::BIGINT + 1)) AS gy FROM f""",
)
def all_touched(spark, sf):
    cells = lines(spark, sf).select("id", F.explode(geometry.touched_cells(CELL)).alias("k"))
    return cells.select("id", "k.gx", "k.gy").distinct()


@query("r07_area_mask", f"WITH {PIXELS_SQL} SELECT scene, count(*) FILTER (c * 30 + 15 >= 45 AND c * 30 + 15 < 200 AND r * 30 + 15 >= 60) AS inside, count(*) FILTER (NOT (c * 30 + 15 >= 45 AND c * 30 + 15 < 200 AND r * 30 + 15 >= 60)) AS outside FROM px GROUP BY scene")
def area_mask(spark, sf):
    """Pixels by their centres inside an area, and the inverse."""
    x, y = F.col("c") * 30 + 15, F.col("r") * 30 + 15
    inside = (x >= 45) & (x < 200) & (y >= 60)
    return pixels(spark, sf).groupBy("scene").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query(
    "r15_boundary_distances",
    f"""WITH {MASKS_SQL}, {ERODE_SQL.format(m='pred')}, {ERODE_SQL.format(m='ref').replace('er AS', 'er2 AS', 1)}, pe AS (SELECT scene, r, c FROM er WHERE m AND NOT eroded), re AS (SELECT scene, r, c FROM er2 WHERE m AND NOT eroded),
d AS (SELECT pe.scene, pe.r, pe.c, 'p' AS side, min(sqrt(power(re.r - pe.r, 2) + power(re.c - pe.c, 2))) AS d FROM pe JOIN re USING (scene) GROUP BY 1, 2, 3 UNION ALL
 SELECT re.scene, re.r, re.c, 'r', min(sqrt(power(re.r - pe.r, 2) + power(re.c - pe.c, 2))) FROM re JOIN pe USING (scene) GROUP BY 1, 2, 3),
s AS (SELECT scene, round(median(d), 6) AS median_px, round(quantile_cont(d, 0.95), 6) AS p95_px, round(max(d), 6) AS most_px FROM d GROUP BY scene),
n AS (SELECT scene, count(*) FILTER (p) AS pred_edge, count(*) FILTER (NOT p) AS ref_edge FROM (SELECT scene, true AS p FROM pe UNION ALL SELECT scene, false FROM re) GROUP BY scene)
SELECT scene, coalesce(pred_edge, 0) AS pred_edge, coalesce(ref_edge, 0) AS ref_edge, coalesce(median_px, 'Infinity'::DOUBLE) AS median_px, coalesce(p95_px, 'Infinity'::DOUBLE) AS p95_px, coalesce(most_px, 'Infinity'::DOUBLE) AS most_px
FROM (SELECT DISTINCT scene FROM mk) LEFT JOIN n USING (scene) LEFT JOIN s USING (scene)""",
)
def boundary_distances(spark, sf):
    return rounded(raster.boundary_distances(masks(spark, sf), "pred", "ref"), "median_px", "p95_px", "most_px")


@query("r18_window_snap", f"WITH {BOXES_SQL} SELECT box, floor(l / 30 + 0.5)::BIGINT AS col_off, floor((4000 - t) / 30 + 0.5)::BIGINT AS row_off, floor((r - l) / 30 + 0.5)::BIGINT AS width, floor((t - b) / 30 + 0.5)::BIGINT AS height FROM bx")
def window_snap(spark, sf):
    """Pixel windows of boxes, offsets and lengths to the nearest whole pixel."""
    snap = lambda x: F.floor(x / 30 + 0.5)
    size = {"col_off": F.col("l"), "row_off": 4000 - F.col("t"), "width": F.col("r") - F.col("l"), "height": F.col("t") - F.col("b")}
    return boxes(spark, sf).select("box", *(snap(v).alias(n) for n, v in size.items()))


@query("f22_buffered_wkt", f"WITH {BOXES_SQL}, k AS (SELECT box, (l - 50)::BIGINT::VARCHAR AS w, (b - 50)::BIGINT::VARCHAR AS s, (r + 50)::BIGINT::VARCHAR AS e, (t + 50)::BIGINT::VARCHAR AS n FROM bx) SELECT box, 'POLYGON ((' || w || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', ' || w || ' ' || n || ', ' || w || ' ' || s || '))' AS wkt FROM k")
def buffered_wkt(spark, sf):
    side = lambda c, by: (F.col(c) + by).cast("long").cast("string").alias(c)
    k = boxes(spark, sf).select("box", side("l", -50), side("b", -50), side("r", 50), side("t", 50))
    corners = [F.concat_ws(" ", x, y) for x, y in (("l", "b"), ("r", "b"), ("r", "t"), ("l", "t"), ("l", "b"))]
    return k.select("box", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))")).alias("wkt"))


@query("t08_nearest_first", f"WITH {POINTS_SQL} SELECT id, name, round(sqrt(power(x - 2500, 2) + power(y - 2000, 2)), 6) AS away FROM pt ORDER BY power(x - 2500, 2) + power(y - 2000, 2), id LIMIT 25")
def nearest_first(spark, sf):
    """The 25 places nearest to a point: the limit is the question."""
    square = (F.col("x") - 2500) * (F.col("x") - 2500) + (F.col("y") - 2000) * (F.col("y") - 2000)
    p = points(spark, sf).withColumn("square", square).orderBy("square", "id").limit(25)
    return rounded(p.select("id", "name", F.sqrt("square").alias("away")), "away")
