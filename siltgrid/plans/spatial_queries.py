"""Queries on vector features and model fitting. Coordinates come from keys by fixed rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.operators import forest, geometry, metrics, nearest, raster
from siltgrid.sources.tables import MASKS_SQL, SIDE, masks, read

from .raster_queries import rounded
from .registry import query

CELL = 100.0
POINTS_SQL = "pt AS (SELECT c_custkey AS id, c_name AS name, ((c_custkey * 37) % 5000)::DOUBLE AS x, ((c_custkey * 91) % 4000)::DOUBLE AS y FROM customer)"
LINES_SQL = "ln AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 5000)::DOUBLE AS x1, ((s_suppkey * 29) % 4000)::DOUBLE AS y1, ((s_suppkey * 53) % 5000 + (s_suppkey * 7) % 300)::DOUBLE AS x2, ((s_suppkey * 29) % 4000 + (s_suppkey * 11) % 250)::DOUBLE AS y2 FROM supplier)"
BOXES_SQL = "bx AS (SELECT n_nationkey AS box, n_name, (n_nationkey % 5) * 1000.0::DOUBLE AS l, (n_nationkey // 5) * 800.0::DOUBLE AS b, (n_nationkey % 5) * 1000.0::DOUBLE + 400 AS r, (n_nationkey // 5) * 800.0::DOUBLE + 300 AS t FROM nation)"


def points(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), ((F.col("c_custkey") * 37) % 5000).cast("double").alias("x"), ((F.col("c_custkey") * 91) % 4000).cast("double").alias("y"))


def lines(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k * 53) % 5000, (k * 29) % 4000
    return read(spark, sf, "supplier").select(k.alias("id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + (k * 7) % 300).cast("double").alias("x2"), (y + (k * 11) % 250).cast("double").alias("y2"))


def boxes(spark, sf):
    """One box per nation: 25 rows at any scale."""
    k = F.col("n_nationkey")
    left, bottom = (k % 5) * 1000.0, F.floor(k / 5) * 800.0
    return read(spark, sf, "nation").select(k.alias("box"), "n_name", left.alias("l"), bottom.alias("b"), (left + 400).alias("r"), (bottom + 300).alias("t"))


def _utm_sql() -> str:
    """The third-order series on WGS 84, zone 10, spelt out for x (lon) and y (lat) in radians."""
    n = "(1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE)"
    return f"""c AS (SELECT {n} AS n), k AS (SELECT n, 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * 0.9996 AS a, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1,
  13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM c),
p AS (SELECT id, radians(x / 1000 - 125) - radians(-123.0::DOUBLE) AS lam, sin(radians(y / 1000 + 47)) AS s FROM pt),
t AS (SELECT p.*, k.*, sinh(ln((1 + s) / (1 - s)) / 2 - e * ln((1 + e * s) / (1 - e * s)) / 2) AS t FROM p, k),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) / 2 AS eta FROM t)"""


@query(
    "g01_projection",
    f"""WITH {POINTS_SQL}, {_utm_sql()} SELECT id, round(500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
  round(a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM u""",
)
def projection(spark, sf):
    """UTM coordinates of points; their series is held against published pairs in the tests."""
    p = points(spark, sf).select("id", (F.col("x") / 1000 - 125).alias("lon"), (F.col("y") / 1000 + 47).alias("lat"))
    e, n = geometry.utm(F.col("lon"), F.col("lat"), 10)
    return p.select("id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("g08_points_in_boxes", f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id, box FROM pt JOIN bx ON x >= l AND x < r AND y >= b AND y < t")
def points_in_boxes(spark, sf):
    """Points and boxes of any layout meet in grid cells."""
    b = geometry.spread(boxes(spark, sf), F.col("l"), F.col("b"), F.col("r"), F.col("t"), 250.0)
    p = points(spark, sf).withColumn("gx", F.floor(F.col("x") / 250).cast("long")).withColumn("gy", F.floor(F.col("y") / 250).cast("long"))
    inside = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r")) & (F.col("y") >= F.col("b")) & (F.col("y") < F.col("t"))
    return p.join(b, ["gx", "gy"]).filter(inside).select("id", "box")


@query(
    "g05_length_in_boxes",
    f"""WITH {LINES_SQL}, {BOXES_SQL}, s AS (SELECT id, box, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, l, b, r, t FROM ln, bx),
 k AS (SELECT id, box, sqrt(dx * dx + dy * dy) AS len, greatest(0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN l AND r THEN 0 ELSE 2 END ELSE least((l - x1) / dx, (r - x1) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN b AND t THEN 0 ELSE 2 END ELSE least((b - y1) / dy, (t - y1) / dy) END) AS e,
 least(1, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN l AND r THEN 1 ELSE -1 END ELSE greatest((l - x1) / dx, (r - x1) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN b AND t THEN 1 ELSE -1 END ELSE greatest((b - y1) / dy, (t - y1) / dy) END) AS f FROM s)
 SELECT id, box, round(greatest(f - e, 0) * len, 6) AS inside_m FROM k WHERE f > e AND len > 0""",
)
def length_in_boxes(spark, sf):
    """Segments and boxes of any extent meet in cells."""
    met = geometry.lengths_in_boxes(lines(spark, sf), boxes(spark, sf).select("box", "l", "b", "r", "t"), 500.0)
    return rounded(met.select("id", "box", "inside_m"), "inside_m")


@query("g03_line_lengths", f"WITH {LINES_SQL} SELECT id, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS length_m, round((x1 + x2) / 2, 6) AS mx, round((y1 + y2) / 2, 6) AS my FROM ln")
def line_lengths(spark, sf):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = lines(spark, sf).withColumn("line", F.array(p("x1", "y1"), p("x2", "y2")))
    return rounded(rows.select("id", geometry.length("line").alias("length_m"), ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my")), "length_m", "mx", "my")


@query("g04_ring_areas", f"WITH {BOXES_SQL} SELECT box, round((r - l) * (t - b) / 2, 6) AS triangle_m2, round((r - l) * (t - b), 6) AS box_m2 FROM bx")
def ring_areas(spark, sf):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = boxes(spark, sf).withColumn("tri", F.array(p("l", "b"), p("r", "b"), p("l", "t"), p("l", "b"))).withColumn("sq", F.array(p("l", "b"), p("r", "b"), p("r", "t"), p("l", "t"), p("l", "b")))
    return rounded(rows.select("box", geometry.ring_area("tri").alias("triangle_m2"), geometry.ring_area("sq").alias("box_m2")), "triangle_m2", "box_m2")


DISTANCE = "sqrt(power(greatest(l - x, 0, x - r), 2) + power(greatest(b - y, 0, y - t), 2))"


@query("j19_distance_bands", f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id, box, round({DISTANCE}, 6) AS distance_m, {DISTANCE} <= 50 AS within_50m, {DISTANCE} <= 100 AS within_100m FROM pt JOIN bx ON {DISTANCE} <= 250")
def distance_bands(spark, sf):
    """Points meet boxes in grid cells widened by the greatest distance."""
    reach = 250.0
    cells = lambda lo, hi: F.sequence(F.floor((F.col(lo) - reach) / CELL).cast("long"), F.floor((F.col(hi) + reach) / CELL).cast("long"))
    b = boxes(spark, sf).select("*", F.explode(cells("l", "r")).alias("gx")).select("*", F.explode(cells("b", "t")).alias("gy"))
    p = points(spark, sf).withColumn("gx", F.floor(F.col("x") / CELL).cast("long")).withColumn("gy", F.floor(F.col("y") / CELL).cast("long"))
    d = geometry.box_distance(*(F.col(c) for c in ("x", "y", "l", "b", "r", "t")))
    out = p.join(b, ["gx", "gy"]).withColumn("distance_m", d).filter(F.col("distance_m") <= reach)
    return rounded(out.select("id", "box", "distance_m", (F.col("distance_m") <= 50).alias("within_50m"), (F.col("distance_m") <= 100).alias("within_100m")), "distance_m")


@query("j20_nearest_box", f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT id, n_name AS nearest, round({DISTANCE}, 6) AS distance_m FROM pt, bx QUALIFY row_number() OVER (PARTITION BY id ORDER BY {DISTANCE}, n_name) = 1")
def nearest_box(spark, sf):
    """Points go down a tree of the boxes' cells."""
    p = points(spark, sf).select("id", "x", "y", F.col("x").alias("l"), F.col("y").alias("b"), F.col("x").alias("r"), F.col("y").alias("t"))
    b = boxes(spark, sf).select(F.col("n_name").alias("nearest"), *(F.col(c).alias(f"{c}2") for c in "lbrt"))
    d = geometry.box_distance(*(F.col(c) for c in ("x", "y", "l2", "b2", "r2", "t2")))
    return rounded(nearest.nearest(p, b, "id", "nearest", d).withColumnRenamed("distance", "distance_m"), "distance_m")


@query("j18_exposure_by_box", f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT box, count(id) AS places, count(id) > 0 AS exposed FROM bx LEFT JOIN pt ON x >= l AND x < r AND y >= b AND y < t GROUP BY box")
def exposure(spark, sf):
    hit = points_in_boxes(spark, sf).groupBy("box").agg(F.count("*").alias("places"))
    return boxes(spark, sf).join(hit, "box", "left").select("box", F.coalesce("places", F.lit(0)).cast("long").alias("places"), (F.coalesce("places", F.lit(0)) > 0).alias("exposed"))


@query("r03_rasterize_centres", f"WITH {BOXES_SQL}, g AS (SELECT unnest(range(0, 200)) AS k) SELECT box, gx.k AS gx, gy.k AS gy FROM bx, g gx, g gy WHERE (gx.k + 0.5) * 30 >= l AND (gy.k + 0.5) * 30 >= b AND ((gx.k + 0.5) * 30 - l) / (r - l) + ((gy.k + 0.5) * 30 - b) / (t - b) < 1")
def rasterize(spark, sf):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    tri = boxes(spark, sf).select("box", F.array(p("l", "b"), p("r", "b"), p("l", "t"), p("l", "b")).alias("ring"))
    return geometry.rasterize_centres(tri, "box", "ring", 30.0)


@query("r21_grid_ids", f"WITH {POINTS_SQL}, c AS (SELECT DISTINCT floor(x / 1000)::BIGINT AS gx, floor(y / 1000)::BIGINT AS gy FROM pt) SELECT gx, gy, printf('G%03d', row_number() OVER (ORDER BY gx, gy)) AS grid_id FROM c")
def grid_ids(spark, sf):
    cells = points(spark, sf).select(F.floor(F.col("x") / 1000).alias("gx"), F.floor(F.col("y") / 1000).alias("gy")).distinct()  # twenty cells of a fixed area
    return cells.select("gx", "gy", F.format_string("G%03d", F.row_number().over(Window.orderBy("gx", "gy"))).alias("grid_id"))


@query("m08_block_sample", f"""WITH {MASKS_SQL}, h AS (SELECT scene, r, c, ref, md5(concat_ws('|', 'block', scene, r, c)) AS h FROM mk), k AS (SELECT *, row_number() OVER (PARTITION BY scene, r // 4, c // 4, ref ORDER BY h) AS k FROM h), s AS (SELECT * FROM k WHERE k <= 3), x AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY h) AS q FROM s) SELECT scene, r, c, ref FROM x WHERE q <= (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY ref))""")
def block_sample(spark, sf):
    px = masks(spark, sf).withColumn("br", F.floor(F.col("r") / 4)).withColumn("bc", F.floor(F.col("c") / 4))
    return forest.block_sample(px, "ref", ["scene", "br", "bc"], 3).select("scene", "r", "c", "ref")


FEATURES = ["v", "mean", "texture", "elev"]


def model_input(spark, sf):
    px = masks(spark, sf)
    rest = [c for c in px.columns if c not in ("scene", "r", "c")]
    m = raster.focal(px, "v", 1, SIDE, SIDE, keep=rest)
    return m.select("scene", "r", "c", *rest, "mean", raster.local_std(m).alias("texture"))


@query("m09_random_forest")
def random_forest(spark, sf):
    """Fit on a hash-ordered sample of blocks of even scenes, score every pixel of the odd ones: counts per label."""
    px = model_input(spark, sf)
    train = px.filter("scene % 2 = 0").withColumn("br", F.floor(F.col("r") / 4)).withColumn("bc", F.floor(F.col("c") / 4))
    fitted = forest.fit(forest.block_sample(train, "ref", ["scene", "br", "bc"], 3), FEATURES, "ref", trees=20, depth=6)
    scored = forest.predict(fitted, px.filter("scene % 2 = 1"), "valid").withColumn("said", F.coalesce("water", F.lit(False)))
    return metrics.confusion(scored, ["label"], pred="said", valid="valid").select("label", "tp", "fp", "fn", "tn", "iou", "f1")
