"""Queries on pixel scenes: thresholds, masks, neighbourhoods, components, accuracy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.operators import metrics, raster
from siltgrid.operators.quantiles import percentiles
from siltgrid.sources.tables import MASKS_SQL, PIXELS_SQL, SIDE, masks, pixels

from .registry import query

R = 6  # decimals of reported doubles


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, R) + F.lit(0.0))  # no negative zero
    return df


OTSU_SQL = """span AS (SELECT label % 2 AS g, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
hist AS (SELECT g, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 256)), 255) ELSE 0 END::INT AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM px JOIN span ON px.label % 2 = g GROUP BY 1, 2),
hx AS (SELECT g, bin, n, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) AS x FROM hist),
run AS (SELECT g, bin, x, sum(n) OVER o AS w0, sum(n * x) OVER o AS s0, sum(n) OVER (PARTITION BY g) AS w, sum(n * x) OVER (PARTITION BY g) AS s FROM hx WINDOW o AS (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING)),
sc AS (SELECT g, bin, x, coalesce(w0 * (w - w0) * power(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 0) AS score FROM run),
otsu AS (SELECT g, bin, x AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, bin) AS k FROM sc) WHERE k = 1)"""


@query("m01_otsu_by_mode", f"WITH {PIXELS_SQL}, {OTSU_SQL} SELECT g AS mode, bin, round(threshold, 6) AS threshold FROM otsu")
def otsu_by_mode(spark, sf):
    px = pixels(spark, sf).withColumn("mode", F.col("label") % 2)
    return rounded(raster.otsu(px, "v", ["mode"]), "threshold").select("mode", "bin", "threshold")


@query("a31_histogram", f"WITH {PIXELS_SQL}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM px) SELECT least(floor((v - lo) / ((hi - lo) / 64)), 63)::INT AS bin, count(*) AS n FROM px, s GROUP BY 1")
def histogram(spark, sf):
    px = pixels(spark, sf)
    span = px.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return px.crossJoin(F.broadcast(span)).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 64)), F.lit(63)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


CONFUSION = """count(*) FILTER (pred AND ref AND valid) AS tp, count(*) FILTER (pred AND NOT ref AND valid) AS fp, count(*) FILTER (NOT pred AND ref AND valid) AS fn, count(*) FILTER (NOT pred AND NOT ref AND valid) AS tn"""
DERIVED = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou, round((tp + fp) * 0.04::DOUBLE, 6) AS pred_ha, round((tp + fn) * 0.04::DOUBLE, 6) AS ref_ha, round((fp - fn) * 0.04::DOUBLE, 6) AS bias_ha,
 round(coalesce(100::DOUBLE * (fp - fn) / nullif(tp + fn, 0), 0), 6) AS bias_pct, round(fp * 0.04::DOUBLE, 6) AS fp_ha, round(fn * 0.04::DOUBLE, 6) AS fn_ha"""
NAMES = ("precision", "recall", "f1", "iou", "pred_ha", "ref_ha", "bias_ha", "bias_pct", "fp_ha", "fn_ha")


@query("a01_confusion_by_scene", f"WITH {MASKS_SQL}, k AS (SELECT scene, {CONFUSION} FROM mk GROUP BY scene) SELECT *, {DERIVED} FROM k")
def confusion_by_scene(spark, sf):
    return rounded(metrics.confusion(masks(spark, sf), ["scene"], valid="valid"), *NAMES)


@query("a02_agreement_by_label", f"WITH {MASKS_SQL}, k AS (SELECT label, {CONFUSION} FROM mk WHERE valid GROUP BY label) SELECT label, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(100::DOUBLE * (fp - fn) / nullif(tp + fn, 0), 6) AS area_error_pct FROM k")
def agreement(spark, sf):
    out = metrics.confusion(masks(spark, sf).filter("valid"), ["label"], valid="valid", empty=None)
    return rounded(out.select("label", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "iou", F.col("bias_pct").alias("area_error_pct")), "precision", "recall", "f1", "iou", "area_error_pct")


POOLED_SQL = f"WITH {MASKS_SQL}, k AS (SELECT label % 5 AS scene5, label % 2 AS mode, {CONFUSION} FROM mk GROUP BY 1, 2), d AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(100::DOUBLE * (fp - fn) / nullif(tp + fn, 0), 0) AS bias_pct FROM k)"


def by_fold(spark, sf):
    px = masks(spark, sf).withColumn("scene5", F.col("label") % 5).withColumn("mode", F.col("label") % 2)
    return metrics.confusion(px, ["scene5", "mode"], valid="valid")


@query(
    "a16_pooled_summary",
    POOLED_SQL
    + """ SELECT mode, count(*) AS scenes, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(quantile_cont(f1, 0.5), 6) AS median_f1, round(quantile_cont(iou, 0.75) - quantile_cont(iou, 0.25), 6) AS iqr_iou, round(quantile_cont(abs(bias_pct), 0.5), 6) AS median_abs_bias, round(min(iou), 6) AS worst_iou,
 sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(sum(tp) / sum(tp + fp + fn), 6) AS pooled_iou, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS pooled_f1 FROM d GROUP BY mode""",
)
def pooled_summary(spark, sf):
    return rounded(metrics.pooled(by_fold(spark, sf), ["mode"]), "median_iou", "median_f1", "iqr_iou", "median_abs_bias", "worst_iou", "pooled_iou", "pooled_f1")


@query(
    "m13_gate",
    f"WITH {MASKS_SQL}, k AS (SELECT label % 5 AS scene5, {CONFUSION} FROM mk GROUP BY 1), d AS (SELECT scene5, scene5 % 2 AS mode, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, abs(coalesce(100::DOUBLE * (fp - fn) / nullif(tp + fn, 0), 0)) AS bias FROM k),"
    """ m AS (SELECT count(*) AS modes, min(x) AS least_mode FROM (SELECT mode, quantile_cont(iou, 0.5) AS x FROM d GROUP BY mode)), a AS (SELECT count(*) AS n, quantile_cont(iou, 0.5) AS iou, quantile_cont(f1, 0.5) AS f1, count(*) FILTER (iou < 0.25) AS poor, min(iou) AS li, min(f1) AS lf, quantile_cont(bias, 0.5) AS b, max(bias) AS mb FROM d)
 SELECT CASE WHEN n <> 5 OR modes <> 2 OR iou < 0.35 OR poor >= 2 THEN 'FAIL' WHEN iou < 0.5 OR f1 < 0.67 OR li < 0.35 OR lf < 0.52 OR b > 25 OR mb > 50 OR least_mode < 0.45 THEN 'REFINE' ELSE 'GO' END AS status,
 concat_ws('; ', CASE WHEN n <> 5 OR modes <> 2 THEN 'rows or modes' END, CASE WHEN iou < 0.35 THEN 'median iou below the floor' END, CASE WHEN poor >= 2 THEN 'poor scenes' END, CASE WHEN iou < 0.5 THEN 'median iou' END, CASE WHEN f1 < 0.67 THEN 'median f1' END, CASE WHEN li < 0.35 THEN 'scene iou' END, CASE WHEN lf < 0.52 THEN 'scene f1' END, CASE WHEN b > 25 THEN 'median bias' END, CASE WHEN mb > 50 THEN 'scene bias' END, CASE WHEN least_mode < 0.45 THEN 'mode median' END) AS reasons,
 n, modes, round(iou, 6) AS median_iou, round(f1, 6) AS median_f1 FROM a, m""",
)
def gate(spark, sf):
    px = masks(spark, sf).withColumn("scene5", F.col("label") % 5)
    scores = metrics.confusion(px, ["scene5"], valid="valid").withColumn("mode", F.col("scene5") % 2)
    return rounded(metrics.gate(scores, "mode", {"geometry": "passed", "calibration": "pass", "artifact": None}), "median_iou", "median_f1")


@query("a05_distribution", f"WITH {PIXELS_SQL} SELECT label, count(v) AS n, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(min(v), 6) AS least, round(max(v), 6) AS most FROM px GROUP BY label")
def distribution(spark, sf):
    return rounded(metrics.distribution(pixels(spark, sf), ["label"], "v"), "p1", "p5", "median", "p95", "p99", "least", "most")


def sides(q):
    """Quartiles of both sides of a mask (label, ref, q1, q2, q3) in one row of a label."""
    of = lambda water, c: F.max(F.when(F.col("ref") == F.lit(water), F.col(c)))
    return q.groupBy("label").agg(*(of(water, c).alias(f"{name}_{c}") for name, water in (("water", True), ("land", False)) for c in ("q1", "q2", "q3")))


@query("a06_sample_description", f"WITH {MASKS_SQL} SELECT label, ref, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3 FROM mk GROUP BY label, ref")
def sample_description(spark, sf):
    px = masks(spark, sf)
    out = px.groupBy("label", "ref").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    out = out.join(percentiles(px, ["label", "ref"], "v", {"median": 0.5, "q1": 0.25, "q3": 0.75}), ["label", "ref"]).select("label", "ref", "n", "mean", "median", "std", "q1", "q3")
    return rounded(out, "mean", "median", "std", "q1", "q3")


@query("a07_separation", f"WITH {MASKS_SQL} SELECT label, round(median(v) FILTER (NOT ref) - median(v) FILTER (ref), 6) AS gap, round((avg(v) FILTER (NOT ref) - avg(v) FILTER (ref)) / sqrt((var_samp(v) FILTER (ref) + var_samp(v) FILTER (NOT ref)) / 2), 6) AS separation, round((quantile_cont(v, 0.75) FILTER (ref) + quantile_cont(v, 0.25) FILTER (NOT ref)) / 2, 6) AS quartile_threshold FROM mk GROUP BY label")
def separation(spark, sf):
    w, d = F.when(F.col("ref"), F.col("v")), F.when(~F.col("ref"), F.col("v"))
    px = masks(spark, sf)
    out = px.groupBy("label").agg(((F.avg(d) - F.avg(w)) / F.sqrt((F.var_samp(w) + F.var_samp(d)) / 2)).alias("separation"))
    q = sides(percentiles(px, ["label", "ref"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    out = out.join(q, "label").select("label", (F.col("land_q2") - F.col("water_q2")).alias("gap"), "separation", ((F.col("water_q3") + F.col("land_q1")) / 2).alias("quartile_threshold"))
    return rounded(out, "gap", "separation", "quartile_threshold")


@query("a04_mask_areas", f"WITH {MASKS_SQL}, k AS (SELECT scene, count(*) FILTER (pred) AS pred, count(*) FILTER (ref) AS ref, count(*) FILTER (permanent) AS permanent, count(*) FILTER (valid) AS valid FROM mk GROUP BY scene) SELECT scene, mask, pixels, round(pixels * 0.04::DOUBLE, 6) AS area_ha, round(100.0::DOUBLE * pixels / v, 6) AS pct_of_valid FROM (SELECT scene, valid AS v, unnest(['pred', 'ref', 'permanent', 'valid']) AS mask, unnest([pred, ref, permanent, valid]) AS pixels FROM k)")
def mask_areas(spark, sf):
    names = ["pred", "ref", "permanent", "valid"]
    wide = masks(spark, sf).groupBy("scene").agg(*(F.count_if(n).alias(n) for n in names))
    long = wide.withColumn("v", F.col("valid")).unpivot(["scene", "v"], names, "mask", "pixels")
    return rounded(long.select("scene", "mask", "pixels", (F.col("pixels") * 0.04).alias("area_ha"), (100.0 * F.col("pixels") / F.col("v")).alias("pct_of_valid")), "area_ha", "pct_of_valid")


#: Sums along rows, then along columns; a pixel at an edge stands once more beyond it.
FOCAL_SQL = """rw AS (SELECT scene, r, c, v, sum(v) OVER w + CASE WHEN c IN (0, 7) THEN v ELSE 0 END AS s1, sum(v * v) OVER w + CASE WHEN c IN (0, 7) THEN v * v ELSE 0 END AS s2 FROM px WINDOW w AS (PARTITION BY scene, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
mo AS (SELECT scene, r, c, v, (sum(s1) OVER w + CASE WHEN r IN (0, 7) THEN s1 ELSE 0 END) / 9 AS mean, (sum(s2) OVER w + CASE WHEN r IN (0, 7) THEN s2 ELSE 0 END) / 9 AS mean_sq, 9::BIGINT AS n FROM rw WINDOW w AS (PARTITION BY scene, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query("w10_focal_std", f"WITH {PIXELS_SQL}, {FOCAL_SQL} SELECT scene, r, c, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(sqrt(greatest(mean_sq - mean * mean, 0)), 6) AS std FROM mo")
def focal_std(spark, sf):
    m = raster.focal(pixels(spark, sf), "v", 1, SIDE, SIDE)
    return rounded(m.select("scene", "r", "c", "n", "mean", raster.local_std(m).alias("std")), "mean", "std")


@query("w11_lee_filter", f"WITH {PIXELS_SQL}, {FOCAL_SQL}, va AS (SELECT *, greatest(mean_sq - mean * mean, 0) AS var FROM mo), no AS (SELECT scene, median(var) AS noise FROM va GROUP BY scene) SELECT scene, r, c, round(mean + CASE WHEN var + noise > 0 THEN var / (var + noise) ELSE 0 END * (v - mean), 6) + 0.0::DOUBLE AS filtered FROM va JOIN no USING (scene)")
def lee_filter(spark, sf):
    return rounded(raster.lee(pixels(spark, sf), "v", 1, SIDE, SIDE), "filtered")


@query("w12_slope", f"""WITH {PIXELS_SQL}, g AS (SELECT scene, r, c, v, lag(v) OVER a AS up, lead(v) OVER a AS down, lag(v) OVER b AS l, lead(v) OVER b AS rt FROM px WINDOW a AS (PARTITION BY scene, c ORDER BY r), b AS (PARTITION BY scene, r ORDER BY c)),
d AS (SELECT scene, r, c, CASE WHEN up IS NULL THEN down - v WHEN down IS NULL THEN v - up ELSE (down - up) / 2 END / 30.0::DOUBLE AS dr, CASE WHEN l IS NULL THEN rt - v WHEN rt IS NULL THEN v - l ELSE (rt - l) / 2 END / 30.0::DOUBLE AS dc FROM g)
SELECT scene, r, c, round(dr, 6) + 0.0::DOUBLE AS dr, round(dc, 6) + 0.0::DOUBLE AS dc, round(degrees(atan(sqrt(dr * dr + dc * dc))), 6) AS slope FROM d""")
def slope(spark, sf):
    return rounded(raster.slope(pixels(spark, sf), "v", 30.0), "dr", "dc", "slope")


ERODE_SQL = "er AS (SELECT scene, r, c, {m} AS m, {m} AND coalesce(lag({m}) OVER a, false) AND coalesce(lead({m}) OVER a, false) AND coalesce(lag({m}) OVER b, false) AND coalesce(lead({m}) OVER b, false) AS eroded FROM mk WINDOW a AS (PARTITION BY scene, c ORDER BY r), b AS (PARTITION BY scene, r ORDER BY c))"


@query("w13_erosion_edges", f"WITH {MASKS_SQL}, {ERODE_SQL.format(m='pred')} SELECT scene, r, c, m AS mask, eroded, m AND NOT eroded AS edge FROM er")
def erosion(spark, sf):
    return raster.erode(masks(spark, sf), "pred")


@query("r13_distance_transform", f"WITH {MASKS_SQL} SELECT p.scene, p.r, p.c, coalesce(round(min(sqrt(power(p.r - q.r, 2) + power(p.c - q.c, 2))) * 30, 6), 'Infinity'::DOUBLE) AS distance FROM mk p LEFT JOIN (SELECT * FROM mk WHERE pred AND ref) q ON q.scene = p.scene GROUP BY 1, 2, 3")
def distance_transform(spark, sf):
    return rounded(raster.distance(masks(spark, sf).withColumn("m", F.col("pred") & F.col("ref")), "m", 30.0), "distance")


def _boundary_sql(name: str, square: int) -> str:
    """Edges of either mask within a distance of the other's, and the score; a scene without edges scores 0."""
    near = lambda a, b: f"EXISTS (SELECT 1 FROM {b} WHERE {b}.scene = {a}.scene AND power({b}.r - {a}.r, 2) + power({b}.c - {a}.c, 2) <= {square})"
    side = lambda a, b: f"SELECT scene, count(*) AS n, count(*) FILTER ({near(a, b)}) AS hit FROM {a} GROUP BY scene"
    return f"""{name} AS (SELECT s.scene, coalesce(p.n, 0) AS pred_edge, coalesce(q.n, 0) AS ref_edge,
  round(coalesce(2 * (p.hit / p.n) * (q.hit / q.n) / nullif(p.hit / p.n + q.hit / q.n, 0), 0), 6) AS f1
 FROM (SELECT DISTINCT scene FROM mk) s LEFT JOIN ({side('pe', 're')}) p USING (scene) LEFT JOIN ({side('re', 'pe')}) q USING (scene))"""


@query(
    "r14_boundary_f1",
    f"WITH {MASKS_SQL}, {ERODE_SQL.format(m='pred')}, {ERODE_SQL.format(m='ref').replace('er AS', 'er2 AS', 1)}, pe AS (SELECT scene, r, c FROM er WHERE m AND NOT eroded), re AS (SELECT scene, r, c FROM er2 WHERE m AND NOT eroded),"
    f" {_boundary_sql('one', 1)}, {_boundary_sql('two', 4)} SELECT one.scene, one.pred_edge, one.ref_edge, one.f1 AS boundary_f1_1px, two.f1 AS boundary_f1_2px FROM one JOIN two USING (scene)",
)
def boundary_f1(spark, sf):
    """At one and at two pixels."""
    return rounded(raster.boundary_f1(masks(spark, sf), "pred", "ref", (1, 2)), "boundary_f1_1px", "boundary_f1_2px")


CC_SQL = """fg AS (SELECT scene, r, c, r * 8 + c AS id FROM mk WHERE {m}),
reach(scene, id, r, c) AS (SELECT scene, id, r, c FROM fg UNION SELECT reach.scene, reach.id, f.r, f.c FROM reach JOIN fg f ON f.scene = reach.scene AND {near}),
cc AS (SELECT scene, r, c, min(id)::BIGINT AS component FROM reach GROUP BY 1, 2, 3)"""
EIGHT, FOUR = "abs(f.r - reach.r) <= 1 AND abs(f.c - reach.c) <= 1", "abs(f.r - reach.r) + abs(f.c - reach.c) <= 1"


def cc(m: str, near: str = EIGHT) -> str:
    return f"WITH RECURSIVE {MASKS_SQL}, {CC_SQL.format(m=m, near=near)}"


@query("r08_components", cc("pred") + " SELECT * FROM cc")
def components(spark, sf):
    return raster.components(masks(spark, sf), "pred")


MOSAIC_SQL = """mo AS (SELECT scene // 4 AS scene, CAST(r + 8 * (scene % 4 // 2) AS INTEGER) AS r, CAST(c + 8 * (scene % 2) AS INTEGER) AS c, pred FROM mk),
fg AS (SELECT scene, r, c, r * 16 + c AS id FROM (SELECT *, max(c) OVER (PARTITION BY scene) AS last FROM mo) WHERE pred AND last = 15),"""


@query("r08_components_of_mosaics", cc("pred").replace("fg AS (SELECT scene, r, c, r * 8 + c AS id FROM mk WHERE pred),", MOSAIC_SQL) + " SELECT * FROM cc")
def components_of_mosaics(spark, sf):
    """Scenes of four vectors, labelled in tiles that do not follow the vectors' borders."""
    k = F.col("scene") % 4
    place = ((F.col("r") + SIDE * F.floor(k / 2)).cast("int").alias("r"), (F.col("c") + SIDE * (k % 2)).cast("int").alias("c"))
    px = masks(spark, sf).select(F.floor(F.col("scene") / 4).alias("scene"), *place, "pred")
    whole = px.groupBy("scene").agg(F.max("c").alias("last")).filter(F.col("last") == 2 * SIDE - 1).select("scene")
    return raster.components(px.join(whole, "scene"), "pred", tile=5)


@query("r16_zones_four", cc("pred AND NOT ref", FOUR) + ", s AS (SELECT scene, component, count(*) AS pixels, min(r) AS top, min(c) AS lft, max(r) AS bottom, max(c) AS rgt FROM cc GROUP BY 1, 2) SELECT scene, component, pixels, top, lft, bottom, rgt, round(pixels * 0.04::DOUBLE, 6) AS area_ha FROM s")
def zones(spark, sf):
    lab = raster.components(masks(spark, sf).withColumn("m", F.col("pred") & ~F.col("ref")), "m", eight=False)
    out = lab.groupBy("scene", "component").agg(F.count("*").alias("pixels"), F.min("r").alias("top"), F.min("c").alias("lft"), F.max("r").alias("bottom"), F.max("c").alias("rgt"))
    return rounded(out.withColumn("area_ha", F.col("pixels") * 0.04), "area_ha")


@query("r10_minimum_size", cc("pred") + " SELECT scene, r, c, component, count(*) OVER (PARTITION BY scene, component) AS size FROM cc QUALIFY size >= 4")
def minimum_size(spark, sf):
    return raster.at_least(raster.components(masks(spark, sf), "pred"), 4).select("scene", "r", "c", "component", "size")


@query("r09_seeded_fill", cc("pred") + " SELECT scene, r, c, component FROM cc WHERE (scene, component) IN (SELECT scene, component FROM cc JOIN mk USING (scene, r, c) WHERE permanent)")
def seeded(spark, sf):
    px = masks(spark, sf)
    return raster.touching(raster.components(px, "pred"), px.filter("permanent").select("scene", "r", "c")).select("scene", "r", "c", "component")


@query(
    "r11_hole_fill",
    cc("NOT pred") + """, h AS (SELECT scene, component, count(*) AS n FROM cc GROUP BY 1, 2 HAVING min(r) > 0 AND max(r) < 7 AND min(c) > 0 AND max(c) < 7 AND count(*) = 1)
 SELECT mk.scene, mk.r, mk.c, pred OR h.n IS NOT NULL AS filled FROM mk LEFT JOIN cc USING (scene, r, c) LEFT JOIN h ON h.scene = cc.scene AND h.component = cc.component""",
)
def hole_fill(spark, sf):
    px = masks(spark, sf).select("scene", "r", "c", "pred")
    back = raster.components(px.withColumn("m", ~F.col("pred")), "m")
    w = Window.partitionBy("scene", "component")
    inner = back.withColumn("hole", (F.count("*").over(w) == 1) & (F.min("r").over(w) > 0) & (F.max("r").over(w) < SIDE - 1) & (F.min("c").over(w) > 0) & (F.max("c").over(w) < SIDE - 1)).filter("hole")
    return px.join(inner.select("scene", "r", "c", "hole"), ["scene", "r", "c"], "left").select("scene", "r", "c", (F.col("pred") | F.coalesce("hole", F.lit(False))).alias("filled"))


@query(
    "r12_small_exception",
    cc("pred AND elev > 5") + """, a AS (SELECT scene, component, count(*) AS n, avg(-v) AS score, bool_and(dist <= 60) AS near FROM cc JOIN mk USING (scene, r, c) GROUP BY 1, 2)
 SELECT cc.scene, cc.r, cc.c, component, n AS size, (n > 3 OR (score >= 0.05 AND near)) AS kept FROM cc JOIN a USING (scene, component)""",
)
def small_exception(spark, sf):
    px = masks(spark, sf)
    lab = raster.components(px.withColumn("m", F.col("pred") & (F.col("elev") > 5)), "m").join(px.select("scene", "r", "c", "v", "dist"), ["scene", "r", "c"])
    w = Window.partitionBy("scene", "component")
    n = F.count("*").over(w)
    return lab.select("scene", "r", "c", "component", n.alias("size"), ((n > 3) | ((F.avg(-F.col("v")).over(w) >= 0.05) & F.every(F.col("dist") <= 60).over(w))).alias("kept"))


@query("r01_resample_nearest", f"WITH {PIXELS_SQL}, t AS (SELECT unnest(range(5)) AS k) SELECT scene, a.k::INT AS tr, b.k::INT AS tc, round(v, 6) AS value FROM t a, t b, px WHERE r = floor((a.k + 0.5) * 1.6) AND c = floor((b.k + 0.5) * 1.6)")
def resample(spark, sf):
    return rounded(raster.resample_nearest(pixels(spark, sf), "v", 1.6, 5), "value")


@query("r05_area_average", f"WITH {MASKS_SQL} SELECT scene, r // 2 AS tr, c // 2 AS tc, round(avg(v) FILTER (valid), 6) AS value, round(count(*) FILTER (valid) / count(*), 6) AS coverage, count(*) FILTER (valid) / count(*) >= 0.95 - 1e-7 AS valid FROM mk GROUP BY 1, 2, 3")
def area_average(spark, sf):
    return rounded(raster.block_mean(masks(spark, sf), "v", "valid", 2, 0.95), "value", "coverage")


@query("r06_block_mode", f"WITH {MASKS_SQL}, k AS (SELECT scene, r // 4 AS tr, c // 4 AS tc, elev::INT % 4 AS value, count(*) AS n FROM mk GROUP BY 1, 2, 3, 4) SELECT scene, tr, tc, value, n FROM k QUALIFY row_number() OVER (PARTITION BY scene, tr, tc ORDER BY n DESC, value) = 1")
def block_mode(spark, sf):
    return raster.block_mode(masks(spark, sf).withColumn("k", F.col("elev").cast("int") % 4), "k", 4)


@query("r17_pixel_centres", f"WITH {PIXELS_SQL} SELECT scene, r, c, 563960.0::DOUBLE + (c + 0.5) * 30 AS x, 5449240.0::DOUBLE - (r + 0.5) * 30 AS y FROM px")
def pixel_centres(spark, sf):
    return pixels(spark, sf).select("scene", "r", "c", (563960.0 + (F.col("c") + 0.5) * 30).alias("x"), (5449240.0 - (F.col("r") + 0.5) * 30).alias("y"))


@query("r20_disagreement", f"WITH {MASKS_SQL} SELECT scene, r, c, CASE WHEN valid THEN pred::INT + 2 * ref::INT ELSE 255 END AS code FROM mk")
def disagreement(spark, sf):
    return masks(spark, sf).select("scene", "r", "c", F.when(F.col("valid"), F.col("pred").cast("int") + 2 * F.col("ref").cast("int")).otherwise(255).alias("code"))


@query("r22_feature_stack", f"WITH {PIXELS_SQL}, {FOCAL_SQL} SELECT scene, r, c, round(v, 6) + 0.0::DOUBLE AS hh, round(v - 3, 6) AS hv, 3.0::DOUBLE AS diff, round(sqrt(greatest(mean_sq - mean * mean, 0)), 6) AS texture FROM mo")
def feature_stack(spark, sf):
    m = raster.focal(pixels(spark, sf), "v", 1, SIDE, SIDE, keep=["v"])
    out = m.select("scene", "r", "c", F.col("v").alias("hh"), (F.col("v") - 3).alias("hv"), F.lit(3.0).alias("diff"), raster.local_std(m).alias("texture"))
    return rounded(out, "hh", "hv", "texture")


@query("a23_zonal_grid", f"WITH {MASKS_SQL} SELECT scene % 10 AS event, floor(r / 4)::INT AS gr, floor(c / 4)::INT AS gc, count(*) AS pixels, round(100 * avg(CASE WHEN valid THEN pred::INT END), 6) AS ratio_pct, round(0.04::DOUBLE * count(*) FILTER (valid AND pred AND NOT ref), 6) AS gain_ha, round(0.04::DOUBLE * count(*) FILTER (valid AND ref AND NOT pred), 6) AS loss_ha FROM mk GROUP BY 1, 2, 3")
def zonal_grid(spark, sf):
    ok = F.col("valid")
    out = masks(spark, sf).groupBy((F.col("scene") % 10).alias("event"), F.floor(F.col("r") / 4).cast("int").alias("gr"), F.floor(F.col("c") / 4).cast("int").alias("gc")).agg(
        F.count("*").alias("pixels"),
        (100 * F.avg(F.when(ok, F.col("pred").cast("int")))).alias("ratio_pct"),
        (0.04 * F.count_if(ok & F.col("pred") & ~F.col("ref"))).alias("gain_ha"),
        (0.04 * F.count_if(ok & F.col("ref") & ~F.col("pred"))).alias("loss_ha"),
    )
    return rounded(out, "ratio_pct", "gain_ha", "loss_ha")


@query("a22_object_detection", cc("ref") + ", o AS (SELECT scene, component, count(*) AS n, count(*) FILTER (pred) AS hit FROM cc JOIN mk USING (scene, r, c) GROUP BY 1, 2) SELECT scene, count(*) AS objects, count(*) FILTER (hit > 0) AS any_hit, count(*) FILTER (4 * hit >= n) AS quarter_hit, round(count(*) FILTER (4 * hit >= n) / count(*), 6) AS rate FROM o GROUP BY scene")
def object_detection(spark, sf):
    px = masks(spark, sf)
    o = raster.components(px, "ref").join(px.select("scene", "r", "c", "pred"), ["scene", "r", "c"]).groupBy("scene", "component").agg(F.count("*").alias("n"), F.count_if("pred").alias("hit"))
    quarter = F.count_if(4 * F.col("hit") >= F.col("n"))
    return rounded(o.groupBy("scene").agg(F.count("*").alias("objects"), F.count_if(F.col("hit") > 0).alias("any_hit"), quarter.alias("quarter_hit"), (quarter / F.count("*")).alias("rate")), "rate")


@query("p13_dual_band_rule", f"WITH {MASKS_SQL}, u AS (SELECT *, v < 0.02 AS hh, isfinite(v * 2) AND v * 2 >= -0.3 + 0.003 AS usable FROM mk), t AS (SELECT label, median(v * 2) FILTER (usable) AS thr FROM u GROUP BY label) SELECT scene, r, c, hh AND (NOT usable OR v * 2 < thr) AND valid AND NOT permanent AS water FROM u JOIN t USING (label)")
def dual_band(spark, sf):
    px = masks(spark, sf).withColumn("hv", F.col("v") * 2).withColumn("usable", ~F.isnan("hv") & (F.abs("hv") < float("inf")) & (F.col("hv") >= -0.3 + 0.003))
    thr = percentiles(px, ["label"], F.when(F.col("usable"), F.col("hv")), {"thr": 0.5})
    return px.join(thr.select("label", "thr"), "label").select("scene", "r", "c", ((F.col("v") < 0.02) & (~F.col("usable") | (F.col("hv") < F.col("thr"))) & F.col("valid") & ~F.col("permanent")).alias("water"))


@query("p16_terrain_policy", f"WITH {MASKS_SQL} SELECT scene, r, c, pred AND elev <= 5 AS normal, pred AND elev > 5 AND (0.5::FLOAT - v::FLOAT) >= 0.55::FLOAT AND dist <= 60 AS exception, CASE WHEN pred THEN 1 ELSE 0 END + CASE WHEN elev > 5 THEN 2 ELSE 0 END + CASE WHEN dist > 60 THEN 4 ELSE 0 END + CASE WHEN permanent THEN 8 ELSE 0 END + CASE WHEN NOT valid THEN 16 ELSE 0 END AS reason_bits FROM mk")
def terrain_policy(spark, sf):
    # probabilities are single precision: the bound is cast too, or 0.9 as float would lie below 0.9
    p = F.lit(0.5).cast("float") - F.col("v").cast("float")
    bit = lambda c, k: F.when(c, k).otherwise(0)
    bits = bit(F.col("pred"), 1) + bit(F.col("elev") > 5, 2) + bit(F.col("dist") > 60, 4) + bit(F.col("permanent"), 8) + bit(~F.col("valid"), 16)
    return masks(spark, sf).select("scene", "r", "c", (F.col("pred") & (F.col("elev") <= 5)).alias("normal"), (F.col("pred") & (F.col("elev") > 5) & (p >= F.lit(0.55).cast("float")) & (F.col("dist") <= 60)).alias("exception"), bits.alias("reason_bits"))


@query("p18_reason_decode", f"WITH {MASKS_SQL}, b AS (SELECT CASE WHEN pred THEN 1 ELSE 0 END + CASE WHEN elev > 5 THEN 2 ELSE 0 END + CASE WHEN dist > 60 THEN 4 ELSE 0 END AS bits FROM mk) SELECT count(*) FILTER (bits & 1 > 0) AS water, count(*) FILTER (bits & 2 > 0) AS high, count(*) FILTER (bits & 4 > 0) AS far, bit_or(bits) AS seen FROM b")
def reason_decode(spark, sf):
    bits = terrain_policy(spark, sf).select(F.col("reason_bits").bitwiseAND(7).alias("bits"))
    return bits.agg(*(F.count_if(F.col("bits").bitwiseAND(k) > 0).alias(n) for k, n in ((1, "water"), (2, "high"), (4, "far"))), F.bit_or("bits").alias("seen"))


@query("p19_change_categories", f"WITH {MASKS_SQL} SELECT label, CASE WHEN NOT valid THEN 0 WHEN pred AND ref THEN 1 WHEN ref THEN 2 WHEN pred THEN 3 ELSE 4 END AS category, count(*) AS pixels, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS pct FROM mk GROUP BY 1, 2")
def change_categories(spark, sf):
    k = F.when(~F.col("valid"), 0).when(F.col("pred") & F.col("ref"), 1).when(F.col("ref"), 2).when(F.col("pred"), 3).otherwise(4)
    out = masks(spark, sf).groupBy("label", k.alias("category")).agg(F.count("*").alias("pixels"))
    return rounded(out.withColumn("pct", 100.0 * F.col("pixels") / F.sum("pixels").over(Window.partitionBy("label"))), "pct")


@query("p28_error_bands", f"WITH {MASKS_SQL}, e AS (SELECT CASE WHEN pred AND NOT ref THEN 'FP' ELSE 'FN' END AS kind, CASE WHEN elev <= 2 THEN '(,2]' WHEN elev <= 5 THEN '(2,5]' WHEN elev <= 10 THEN '(5,10]' ELSE '(10,)' END AS band FROM mk WHERE pred <> ref AND valid), n AS (SELECT kind, band, count(*) AS pixels FROM e GROUP BY 1, 2), d AS (SELECT * FROM (VALUES ('FP'), ('FN')) k(kind), (VALUES ('(,2]'), ('(2,5]'), ('(5,10]'), ('(10,)')) b(band)) SELECT kind, band, coalesce(pixels, 0)::BIGINT AS pixels, round(100.0::DOUBLE * coalesce(pixels, 0) / greatest(sum(coalesce(pixels, 0)) OVER (PARTITION BY kind), 1), 6) AS pct_of_kind FROM d LEFT JOIN n USING (kind, band)")
def error_bands(spark, sf):
    band = F.when(F.col("elev") <= 2, "(,2]").when(F.col("elev") <= 5, "(2,5]").when(F.col("elev") <= 10, "(5,10]").otherwise("(10,)")
    n = masks(spark, sf).filter((F.col("pred") != F.col("ref")) & F.col("valid")).groupBy(F.when(F.col("pred"), "FP").otherwise("FN").alias("kind"), band.alias("band")).agg(F.count("*").alias("pixels"))
    every = spark.createDataFrame([(k, b) for k in ("FP", "FN") for b in ("(,2]", "(2,5]", "(5,10]", "(10,)")], "kind string, band string")
    out = every.join(n, ["kind", "band"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))
    return rounded(out.withColumn("pct_of_kind", 100.0 * F.col("pixels") / F.greatest(F.sum("pixels").over(Window.partitionBy("kind")), F.lit(1))), "pct_of_kind")


@query("u03_mask_transitions", f"WITH {MASKS_SQL} SELECT scene, round(0.04::DOUBLE * count(*) FILTER (pred AND ref), 6) AS persistent_ha, round(0.04::DOUBLE * count(*) FILTER (pred AND NOT ref), 6) AS gross_ha, round(0.04::DOUBLE * count(*) FILTER (ref AND NOT pred), 6) AS final_only_ha, round(0.04::DOUBLE * (count(*) FILTER (pred) - count(*) FILTER (ref)), 6) AS net_ha, round(coalesce(count(*) FILTER (pred AND ref) / nullif(count(*) FILTER (pred OR ref), 0), 0), 6) AS jaccard, count(*) FILTER (pred) = count(*) FILTER (pred AND ref) + count(*) FILTER (pred AND NOT ref) AS identity FROM mk GROUP BY scene")
def transitions(spark, sf):
    p, r = F.col("pred"), F.col("ref")
    both, either = F.count_if(p & r), F.count_if(p | r)
    out = masks(spark, sf).groupBy("scene").agg(
        (0.04 * both).alias("persistent_ha"), (0.04 * F.count_if(p & ~r)).alias("gross_ha"), (0.04 * F.count_if(r & ~p)).alias("final_only_ha"), (0.04 * (F.count_if(p) - F.count_if(r))).alias("net_ha"),
        metrics.ratio(both, either).alias("jaccard"), (F.count_if(p) == both + F.count_if(p & ~r)).alias("identity"),
    )
    return rounded(out, "persistent_ha", "gross_ha", "final_only_ha", "net_ha", "jaccard")


@query("j13_adjacent_scenes", f"WITH {MASKS_SQL}, s AS (SELECT scene, lead(scene) OVER (ORDER BY scene) AS nxt FROM (SELECT DISTINCT scene FROM mk)) SELECT a.scene AS from_scene, b.scene AS to_scene, count(*) FILTER (a.pred AND b.pred) AS overlap, count(*) FILTER (a.pred AND NOT b.pred) AS lost, count(*) FILTER (b.pred AND NOT a.pred) AS new, round(coalesce(count(*) FILTER (a.pred AND b.pred) / nullif(count(*) FILTER (a.pred OR b.pred), 0), 0), 6) AS jaccard FROM s JOIN mk a ON a.scene = s.scene JOIN mk b ON b.scene = s.nxt AND a.r = b.r AND a.c = b.c GROUP BY 1, 2")
def adjacent_scenes(spark, sf):
    # one row per scene: the order of scenes is a window over ids, not over pixels
    px = masks(spark, sf).select("scene", "r", "c", "pred")
    ids = pixels(spark, sf).select("scene").distinct()
    order = ids.select("scene", F.lead("scene").over(Window.orderBy("scene")).alias("nxt")).filter("nxt is not null")
    a, b = px.withColumnRenamed("pred", "a"), px.select(F.col("scene").alias("nxt"), "r", "c", F.col("pred").alias("b"))
    pair = a.join(order, "scene").join(b, ["nxt", "r", "c"])
    A, B = F.col("a"), F.col("b")
    out = pair.groupBy(F.col("scene").alias("from_scene"), F.col("nxt").alias("to_scene")).agg(F.count_if(A & B).alias("overlap"), F.count_if(A & ~B).alias("lost"), F.count_if(B & ~A).alias("new"), metrics.ratio(F.count_if(A & B), F.count_if(A | B)).alias("jaccard"))
    return rounded(out, "jaccard")


@query("m05_leave_one_out", f"""WITH {MASKS_SQL}, t AS (SELECT -0.06::DOUBLE + 0.02::DOUBLE * k AS thr, k FROM (SELECT unnest(range(7)) AS k)), x AS (SELECT label % 5 AS fold, k, thr, count(*) FILTER (v < thr AND ref) AS tp, count(*) FILTER (v < thr AND NOT ref) AS fp, count(*) FILTER (NOT v < thr AND ref) AS fn FROM mk, t WHERE valid GROUP BY 1, 2, 3),
tr AS (SELECT h.fold AS heldout, k, thr, avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)) AS iou, avg(abs(fp - fn)) AS bias FROM x JOIN (SELECT DISTINCT fold FROM x) h ON h.fold <> x.fold GROUP BY 1, 2, 3),
pick AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY heldout ORDER BY round(iou, 9) DESC, round(bias, 9), k) = 1) SELECT heldout, pick.k AS candidate, round(pick.iou, 6) AS train_iou, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS heldout_iou FROM pick JOIN x ON x.fold = heldout AND x.k = pick.k""")
def leave_one_out(spark, sf):
    """Every candidate threshold is counted once on every fold; training scores are sums over the other folds' counts."""
    px = masks(spark, sf).filter("valid").select((F.col("label") % 5).alias("fold"), "v", "ref")

    def counts(k):
        said, ref = F.col("v") < -0.06 + 0.02 * k, F.col("ref")
        return F.struct(F.lit(k).cast("long").alias("k"), F.count_if(said & ref).alias("tp"), F.count_if(said & ~ref).alias("fp"), F.count_if(~said & ref).alias("fn"))

    every = px.groupBy("fold").agg(F.array(*map(counts, range(7))).alias("x"))
    x = every.select("fold", F.explode("x").alias("x")).select("fold", "x.*")
    x = x.withColumn("iou", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))
    held = x.select(F.col("fold").alias("heldout")).distinct()
    train = x.join(held, F.col("fold") != F.col("heldout")).groupBy("heldout", "k").agg(F.avg("iou").alias("iou"), F.avg(F.abs(F.col("fp") - F.col("fn"))).alias("bias"))
    w = Window.partitionBy("heldout").orderBy(F.desc(F.round("iou", 9)), F.round("bias", 9), "k")
    pick = train.withColumn("i", F.row_number().over(w)).filter("i = 1").select("heldout", "k", F.col("iou").alias("train_iou"))
    out = pick.join(x.select(F.col("fold").alias("heldout"), "k", F.col("iou").alias("heldout_iou")), ["heldout", "k"])
    return rounded(out.select("heldout", F.col("k").alias("candidate"), "train_iou", "heldout_iou"), "train_iou", "heldout_iou")


@query("flagship_scene_accuracy", f"WITH RECURSIVE {MASKS_SQL}, {OTSU_SQL}, wt AS (SELECT mk.scene, r, c, label, ref, v < threshold AS water FROM mk JOIN otsu ON label % 2 = g), {CC_SQL.format(m='water', near=EIGHT).replace('FROM mk', 'FROM wt')}, z AS (SELECT scene, r, c, count(*) OVER (PARTITION BY scene, component) AS n FROM cc), q AS (SELECT wt.*, coalesce(z.n, 0) >= 2 AS said FROM wt LEFT JOIN z USING (scene, r, c)) SELECT label, count(*) FILTER (said AND ref) AS tp, count(*) FILTER (said AND NOT ref) AS fp, count(*) FILTER (NOT said AND ref) AS fn, count(*) FILTER (NOT said AND NOT ref) AS tn, round(count(*) FILTER (said AND ref) / count(*) FILTER (said OR ref), 6) AS iou FROM q GROUP BY label")
def flagship(spark, sf):
    """Otsu threshold per mode, water mask, cleanup of single pixels, accuracy per label."""
    px = masks(spark, sf).withColumn("mode", F.col("label") % 2)
    thr = raster.otsu(px, "v", ["mode"]).select("mode", "threshold")
    water = px.join(F.broadcast(thr), "mode").withColumn("water", F.col("v") < F.col("threshold"))
    kept = raster.at_least(raster.components(water, "water"), 2).select("scene", "r", "c", F.lit(True).alias("said"))
    q = water.join(kept, ["scene", "r", "c"], "left").withColumn("said", F.coalesce("said", F.lit(False)))
    return rounded(metrics.confusion(q, ["label"], pred="said").select("label", "tp", "fp", "fn", "tn", "iou"), "iou")
