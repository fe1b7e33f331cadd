"""Queries of parameter search, mosaics, sampling, shortlists and their rechecks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.functions import expressions as X
from siltgrid.operators import metrics, raster
from siltgrid.operators.quantiles import percentiles
from siltgrid.sources.tables import MASKS_SQL, PIXELS_SQL, SIDE, masks, pixels, read

from .raster_queries import rounded
from .registry import query


@query("a28_mosaic_mean", f"WITH {MASKS_SQL} SELECT label, r, c, round(avg(v) FILTER (valid), 6) AS mean, count(*) FILTER (valid) AS scenes, bool_and(valid) AS all_valid FROM mk GROUP BY 1, 2, 3")
def mosaic(spark, sf):
    ok = F.col("valid")
    out = masks(spark, sf).groupBy("label", "r", "c").agg(F.avg(F.when(ok, F.col("v"))).alias("mean"), F.count_if(ok).alias("scenes"), F.every(ok).alias("all_valid"))
    return rounded(out, "mean")


@query("a24_probability_summary", f"WITH {MASKS_SQL} SELECT label, permanent, count(*) AS n, round(avg(0.5 - v), 6) AS mean, round(quantile_cont(0.5 - v, 0.05), 6) AS p05, round(quantile_cont(0.5 - v, 0.5), 6) AS p50, round(quantile_cont(0.5 - v, 0.95), 6) AS p95 FROM mk GROUP BY 1, 2")
def probability_summary(spark, sf):
    p = 0.5 - F.col("v")
    px = masks(spark, sf)
    out = px.groupBy("label", "permanent").agg(F.avg(p).alias("mean")).join(percentiles(px, ["label", "permanent"], p, {"p05": 0.05, "p50": 0.5, "p95": 0.95}), ["label", "permanent"])
    out = out.select("label", "permanent", "n", "mean", "p05", "p50", "p95")
    return rounded(out, "mean", "p05", "p50", "p95")


@query("a20_error_by_reason", f"WITH {MASKS_SQL}, u AS (SELECT pred, ref, unnest(['high', 'far', 'permanent']) AS reason, unnest([elev > 5, dist > 60, permanent]) AS flag FROM mk WHERE valid) SELECT reason, count(*) FILTER (flag) AS pixels, count(*) FILTER (flag AND pred AND ref) AS tp, count(*) FILTER (flag AND pred AND NOT ref) AS fp, count(*) FILTER (NOT flag AND pred AND ref) AS surviving_tp FROM u GROUP BY reason")
def error_by_reason(spark, sf):
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("reason"), c.alias("flag")) for n, c in (("high", F.col("elev") > 5), ("far", F.col("dist") > 60), ("permanent", F.col("permanent"))))))
    u = masks(spark, sf).filter("valid").select("pred", "ref", rows.alias("x")).select("pred", "ref", "x.*")
    f, p, r = F.col("flag"), F.col("pred"), F.col("ref")
    return u.groupBy("reason").agg(F.count_if(f).alias("pixels"), F.count_if(f & p & r).alias("tp"), F.count_if(f & p & ~r).alias("fp"), F.count_if(~f & p & r).alias("surviving_tp"))


@query("a21_contribution_audit", f"WITH {MASKS_SQL}, p AS (SELECT label, pred AND elev <= 5 AS base, pred AND (elev <= 5 OR dist <= 60) AS now FROM mk) SELECT label, count(*) FILTER (now AND NOT base) AS added, count(*) FILTER (base AND NOT now) AS removed, count(*) FILTER (now) - count(*) FILTER (base) AS net FROM p GROUP BY label")
def contribution_audit(spark, sf):
    base, now = F.col("pred") & (F.col("elev") <= 5), F.col("pred") & ((F.col("elev") <= 5) | (F.col("dist") <= 60))
    return masks(spark, sf).groupBy("label").agg(F.count_if(now & ~base).alias("added"), F.count_if(base & ~now).alias("removed"), (F.count_if(now) - F.count_if(base)).alias("net"))


@query("p20_agreement_categories", f"WITH {MASKS_SQL} SELECT scene, CASE WHEN NOT valid THEN 'no data' WHEN pred AND ref THEN 'both' WHEN pred THEN 'prediction only' WHEN ref THEN 'reference only' ELSE 'neither' END AS category, count(*) AS pixels FROM mk GROUP BY 1, 2")
def agreement_categories(spark, sf):
    k = F.when(~F.col("valid"), "no data").when(F.col("pred") & F.col("ref"), "both").when(F.col("pred"), "prediction only").when(F.col("ref"), "reference only").otherwise("neither")
    return masks(spark, sf).groupBy("scene", k.alias("category")).agg(F.count("*").alias("pixels"))


@query("p22_cell_composition", f"WITH {MASKS_SQL}, z AS (SELECT scene, floor(r / 4)::INT AS gr, floor(c / 4)::INT AS gc, 100.0::DOUBLE * count(*) FILTER (valid) / count(*) AS valid_pct, 100.0::DOUBLE * count(*) FILTER (valid AND pred) / greatest(count(*) FILTER (valid), 1) AS p, 100.0::DOUBLE * count(*) FILTER (valid AND ref) / greatest(count(*) FILTER (valid), 1) AS q FROM mk GROUP BY 1, 2, 3) SELECT scene, gr, gc, CASE WHEN valid_pct < 80 THEN 'unresolved' WHEN abs(p - q) <= 1e-8 THEN 'stable' WHEN p > q THEN 'gain' ELSE 'loss' END AS class FROM z")
def cell_composition(spark, sf):
    ok = F.col("valid")
    n = F.greatest(F.count_if(ok), F.lit(1))
    z = masks(spark, sf).groupBy("scene", F.floor(F.col("r") / 4).cast("int").alias("gr"), F.floor(F.col("c") / 4).cast("int").alias("gc")).agg((100.0 * F.count_if(ok) / F.count("*")).alias("share"), (100.0 * F.count_if(ok & F.col("pred")) / n).alias("p"), (100.0 * F.count_if(ok & F.col("ref")) / n).alias("q"))
    return z.select("scene", "gr", "gc", F.when(F.col("share") < 80, "unresolved").when(F.abs(F.col("p") - F.col("q")) <= 1e-8, "stable").when(F.col("p") > F.col("q"), "gain").otherwise("loss").alias("class"))


@query("j22_components_touching", f"WITH RECURSIVE {MASKS_SQL}, fg AS (SELECT scene, r, c, r * 8 + c AS id FROM mk WHERE pred), reach(scene, id, r, c) AS (SELECT scene, id, r, c FROM fg UNION SELECT reach.scene, reach.id, f.r, f.c FROM reach JOIN fg f ON f.scene = reach.scene AND abs(f.r - reach.r) <= 1 AND abs(f.c - reach.c) <= 1), cc AS (SELECT scene, r, c, min(id)::BIGINT AS component FROM reach GROUP BY 1, 2, 3) SELECT scene, component, count(*) AS pixels, bool_or(dist <= 30) AS touches, round(100.0::DOUBLE * count(*) FILTER (dist <= 90) / count(*), 6) AS near_pct FROM cc JOIN mk USING (scene, r, c) GROUP BY 1, 2")
def components_touching(spark, sf):
    px = masks(spark, sf)
    lab = raster.components(px, "pred").join(px.select("scene", "r", "c", "dist"), ["scene", "r", "c"])
    return rounded(lab.groupBy("scene", "component").agg(F.count("*").alias("pixels"), F.some(F.col("dist") <= 30).alias("touches"), (100.0 * F.count_if(F.col("dist") <= 90) / F.count("*")).alias("near_pct")), "near_pct")


@query("r02_resample_bilinear", f"WITH {PIXELS_SQL}, t AS (SELECT k, greatest(0, least(6, floor((k + 0.5) * 1.6 - 0.5)))::INT AS a, least(1, greatest(0, (k + 0.5) * 1.6 - 0.5 - greatest(0, least(6, floor((k + 0.5) * 1.6 - 0.5)))))::DOUBLE AS w FROM (SELECT unnest(range(5)) AS k)) SELECT scene, y.k::INT AS tr, x.k::INT AS tc, round(sum(v * CASE WHEN r = y.a THEN 1 - y.w ELSE y.w END * CASE WHEN c = x.a THEN 1 - x.w ELSE x.w END), 6) + 0.0::DOUBLE AS value FROM t y, t x, px WHERE r IN (y.a, y.a + 1) AND c IN (x.a, x.a + 1) GROUP BY 1, 2, 3")
def bilinear(spark, sf):
    """Each target cell weighs four source cells; the weights are a table of a hundred rows."""
    taps = []
    for k in range(5):
        at = (k + 0.5) * 1.6 - 0.5
        a = max(0, min(SIDE - 2, int(at // 1)))
        w = min(1.0, max(0.0, at - a))
        taps += [(k, a, 1 - w), (k, a + 1, w)]
    rows, cols = spark.createDataFrame(taps, "tr int, r int, wr double"), spark.createDataFrame(taps, "tc int, c int, wc double")
    out = pixels(spark, sf).join(F.broadcast(rows), "r").join(F.broadcast(cols), "c").groupBy("scene", "tr", "tc").agg(F.sum(F.col("v") * F.col("wr") * F.col("wc")).alias("value"))
    return rounded(out, "value")


@query("r24_point_samples", f"WITH {PIXELS_SQL}, p(r, c) AS (VALUES (0, 0), (3, 4), (7, 7)) SELECT scene, px.r, px.c, round(v, 6) AS v FROM px JOIN p ON p.r = px.r AND p.c = px.c")
def point_samples(spark, sf):
    at = spark.createDataFrame([(0, 0), (3, 4), (7, 7)], "r int, c int")
    return rounded(pixels(spark, sf).join(F.broadcast(at), ["r", "c"]).select("scene", "r", "c", "v"), "v")


@query("r19_interior_sample", f"WITH {MASKS_SQL} SELECT scene, r, c FROM mk WHERE valid AND v < 0.2 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY greatest(abs(r - 4), abs(c - 4)), r, c) = 1")
def interior_sample(spark, sf):
    w = Window.partitionBy("scene").orderBy(F.greatest(F.abs(F.col("r") - 4), F.abs(F.col("c") - 4)), "r", "c")
    return masks(spark, sf).filter(F.col("valid") & (F.col("v") < 0.2)).withColumn("k", F.row_number().over(w)).filter("k = 1").select("scene", "r", "c")


@query("m06_constraint_grid", f"WITH {MASKS_SQL}, g AS (SELECT e, m FROM (VALUES (3), (5), (8), (99)) a(e), (VALUES (0.0::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) b(m)), k AS (SELECT label % 5 AS fold, e, m, count(*) FILTER (v < -m AND elev <= e AND ref) AS tp, count(*) FILTER (v < -m AND elev <= e AND NOT ref) AS fp, count(*) FILTER (NOT (v < -m AND elev <= e) AND ref) AS fn FROM mk, g WHERE valid GROUP BY 1, 2, 3) SELECT fold, e AS elevation_max, m AS margin, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM k QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 9) DESC, abs(e - 5), m) = 1")
def constraint_grid(spark, sf):
    """Twelve candidates, all counted in one pass over the pixels."""
    ref = F.col("ref")

    def counts(elevation, margin):
        said = (F.col("v") < -margin) & (F.col("elev") <= elevation)
        parts = {"tp": said & ref, "fp": said & ~ref, "fn": ~said & ref}
        return F.struct(F.lit(elevation).alias("elevation_max"), F.lit(margin).alias("margin"), *(F.count_if(c).alias(n) for n, c in parts.items()))

    every = F.array(*(counts(e, m) for e in (3, 5, 8, 99) for m in (0.0, 0.02, 0.05)))
    k = masks(spark, sf).filter("valid").groupBy((F.col("label") % 5).alias("fold")).agg(every.alias("x"))
    k = k.select("fold", F.explode("x").alias("x")).select("fold", "x.*")
    k = k.withColumn("iou", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("iou", 9)), F.abs(F.col("elevation_max") - 5), "margin")
    return rounded(k.withColumn("i", F.row_number().over(w)).filter("i = 1").select("fold", "elevation_max", "margin", "iou"), "iou")


@query("m14_named_checks", f"WITH {MASKS_SQL}, k AS (SELECT label, count(*) FILTER (pred AND ref) / nullif(count(*) FILTER (pred OR ref), 0) AS iou, 100.0::DOUBLE * (count(*) FILTER (pred) - count(*) FILTER (ref)) / count(*) FILTER (ref) AS bias FROM mk WHERE valid GROUP BY label), a AS (SELECT count(*) AS n, median(iou) AS mi, min(iou) AS li, median(abs(bias)) AS mb, max(abs(bias)) AS xb FROM k) SELECT unnest(['rows', 'median iou', 'worst iou', 'median bias', 'worst bias']) AS name, unnest([n = 10, mi >= 0.45, li >= 0.35, mb <= 25, xb <= 50]) AS passed FROM a")
def named_checks(spark, sf):
    k = metrics.confusion(masks(spark, sf), ["label"], valid="valid")
    b = F.abs(F.col("bias_pct"))
    a = k.agg((F.count("*") == 10).alias("rows"), (F.percentile("iou", F.lit(0.5)) >= 0.45).alias("median iou"), (F.min("iou") >= 0.35).alias("worst iou"), (F.percentile(b, F.lit(0.5)) <= 25).alias("median bias"), (F.max(b) <= 50).alias("worst bias"))
    return a.unpivot([], a.columns, "name", "passed")


@query("m15_adoption_rule", f"WITH {MASKS_SQL}, k AS (SELECT label, count(*) FILTER (pred AND ref) / count(*) FILTER (pred OR ref) AS a, count(*) FILTER (pred AND elev <= 8 AND ref) / count(*) FILTER ((pred AND elev <= 8) OR ref) AS b FROM mk WHERE valid GROUP BY label) SELECT round(median(b) - median(a), 6) + 0.0::DOUBLE AS gain, round(min(b - a), 6) + 0.0::DOUBLE AS worst, median(b) - median(a) >= 0.03 AND min(b - a) >= -0.02 AS adopt FROM k")
def adoption(spark, sf):
    px = masks(spark, sf).withColumn("tight", F.col("pred") & (F.col("elev") <= 8))
    a = metrics.confusion(px, ["label"], valid="valid").select("label", F.col("iou").alias("a"))
    b = metrics.confusion(px, ["label"], pred="tight", valid="valid").select("label", F.col("iou").alias("b"))
    k = a.join(b, "label")
    gain, worst = F.percentile("b", F.lit(0.5)) - F.percentile("a", F.lit(0.5)), F.min(F.col("b") - F.col("a"))
    return rounded(k.agg(gain.alias("gain"), worst.alias("worst"), ((gain >= 0.03) & (worst >= -0.02)).alias("adopt")), "gain", "worst")


@query("m18_false_positive_reduction", f"WITH {MASKS_SQL} SELECT label, count(*) FILTER (pred AND NOT ref) AS before, count(*) FILTER (pred AND elev <= 5 AND NOT ref) AS after, round(1 - count(*) FILTER (pred AND elev <= 5 AND NOT ref) / nullif(count(*) FILTER (pred AND NOT ref), 0), 6) AS reduction FROM mk GROUP BY label")
def fp_reduction(spark, sf):
    fp = F.col("pred") & ~F.col("ref")
    out = masks(spark, sf).groupBy("label").agg(F.count_if(fp).alias("before"), F.count_if(fp & (F.col("elev") <= 5)).alias("after"))
    return rounded(out.withColumn("reduction", 1 - metrics.ratio(F.col("after"), F.col("before"), None)), "reduction")


@query("v05_shortlist_recheck", "WITH s AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY most DESC, o_custkey) AS place FROM s WHERE n >= 5 ORDER BY place LIMIT 25) SELECT place, o_custkey, n, most, coalesce(most <= lag(most) OVER (ORDER BY place), true) AS in_order FROM k")
def shortlist(spark, sf):
    """The twenty-five largest, then ranked and rechecked: the windows see twenty-five rows."""
    s = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")).filter("n >= 5")
    w = Window.orderBy(F.desc("most"), "o_custkey")
    return s.orderBy(F.desc("most"), "o_custkey").limit(25).select(F.row_number().over(w).alias("place"), "o_custkey", "n", "most", F.coalesce(F.col("most") <= F.lag("most").over(w), F.lit(True)).alias("in_order"))


@query("v14_scene_consistency", f"WITH {PIXELS_SQL}, s AS (SELECT scene, count(*) AS n, max(r) AS r1, max(c) AS c1, min(r) AS r0 FROM px GROUP BY scene) SELECT scene, n = 64 AND r1 = 7 AND c1 = 7 AND r0 = 0 AS matches FROM s")
def consistency(spark, sf):
    s = pixels(spark, sf).groupBy("scene").agg(F.count("*").alias("n"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.min("r").alias("r0"))
    return s.select("scene", ((F.col("n") == SIDE * SIDE) & (F.col("r1") == SIDE - 1) & (F.col("c1") == SIDE - 1) & (F.col("r0") == 0)).alias("matches"))


@query("f10_expressions", "SELECT event_id, isfinite(value) AS finite, CASE WHEN value > 0 THEN round(10 * log10(greatest(value, 1e-8)), 6) END AS db, round(value / cos(radians(30.0)), 6) AS gamma, (CASE WHEN value > 50 THEN 1 ELSE 0 END) + (CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END) AS bits FROM events")
def expressions(spark, sf):
    v = F.col("value")
    out = read(spark, sf, "events").select("event_id", X.finite(v).alias("finite"), X.decibels(v, 1e-8).alias("db"), X.slant(v, F.lit(30.0)).alias("gamma"), X.flags(v > 50, F.col("user_id") % 2 == 0).alias("bits"))
    return rounded(out, "db", "gamma")
