"""Composite results, put together from the operators: observation, change, exposure and comparison tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.functions import expressions as X
from siltgrid.operators import geometry, metrics, raster, temporal
from siltgrid.operators.quantiles import percentiles
from siltgrid.sources.tables import MASKS_SQL, PIXEL_HA, masks, read

from .fitting_queries import FINAL_SQL, final_masks
from .raster_queries import CONFUSION, FOCAL_SQL, rounded, sides
from .registry import query
from .spatial_queries import BOXES_SQL, DISTANCE, POINTS_SQL, boxes, points
from .temporal_queries import STAGES_SQL, stages
from .vector_queries import ZONES_SQL, zone_table

PIXEL = ["scene", "r", "c"]


@query(
    "c01_event_observations",
    f"""WITH {MASKS_SQL} SELECT scene, any_value(CASE WHEN label % 2 = 0 THEN 'strip' ELSE 'scan' END) AS beam, count(*) FILTER (valid) AS valid_pixels, round(100.0::DOUBLE * count(*) FILTER (valid) / count(*), 6) AS valid_pct,
  round(count(*) FILTER (valid AND permanent AND pred) * 0.04::DOUBLE, 6) AS permanent_ha, round(count(*) FILTER (valid AND pred AND NOT permanent) * 0.04::DOUBLE, 6) AS flood_ha,
  any_value(CASE WHEN label % 2 = 0 THEN 'direct' ELSE 'limited' END) AS comparability FROM mk GROUP BY scene""",
)
def event_observations(spark, sf):
    """One row for each observation: its mode, validity, areas and what it can be compared with."""
    ok, p, perm = F.col("valid"), F.col("pred"), F.col("permanent")
    even = F.first("label") % 2 == 0
    out = masks(spark, sf).groupBy("scene").agg(
        F.when(even, "strip").otherwise("scan").alias("beam"),
        F.count_if(ok).alias("valid_pixels"),
        (100.0 * F.count_if(ok) / F.count("*")).alias("valid_pct"),
        (F.count_if(ok & perm & p) * PIXEL_HA).alias("permanent_ha"),
        (F.count_if(ok & p & ~perm) * PIXEL_HA).alias("flood_ha"),
        F.when(even, "direct").otherwise("limited").alias("comparability"),
    )
    return rounded(out, "valid_pct", "permanent_ha", "flood_ha")


ENDS_SQL = f"{MASKS_SQL}, en AS (SELECT label, min(scene) AS a, max(scene) AS z FROM mk GROUP BY label), ep AS (SELECT en.label, x.r, x.c, x.pred AS p, y.pred AS q FROM en JOIN mk x ON x.scene = a JOIN mk y ON y.scene = z AND y.r = x.r AND y.c = x.c)"


def endpoints(px):
    """The first and the last scene of each label, pixel by pixel. Only their two ids for each label are broadcast or shuffled."""
    ends = px.groupBy("label").agg(F.min("scene").alias("first"), F.max("scene").alias("last"))
    at = px.join(ends, "label").filter("scene = first or scene = last")
    both = at.groupBy("label", "r", "c").agg(F.max(F.when(F.col("scene") == F.col("first"), F.col("pred"))).alias("p"), F.max(F.when(F.col("scene") == F.col("last"), F.col("pred"))).alias("q"))
    return both


@query("c02_endpoint_transition", f"WITH {ENDS_SQL}, k AS (SELECT label, count(*) FILTER (p AND q) AS kept, count(*) FILTER (p AND NOT q) AS lost, count(*) FILTER (q AND NOT p) AS gained, count(*) FILTER (p) AS first, count(*) FILTER (q) AS last FROM ep GROUP BY label) SELECT label, kept, lost, gained, lost - gained AS net, first = kept + lost AND last = kept + gained AND first - last = lost - gained AS identities FROM k")
def endpoint_transition(spark, sf):
    p, q = F.col("p"), F.col("q")
    k = endpoints(masks(spark, sf)).groupBy("label").agg(F.count_if(p & q).alias("kept"), F.count_if(p & ~q).alias("lost"), F.count_if(q & ~p).alias("gained"), F.count_if(p).alias("first"), F.count_if(q).alias("last"))
    net = F.col("lost") - F.col("gained")
    same = (F.col("first") == F.col("kept") + F.col("lost")) & (F.col("last") == F.col("kept") + F.col("gained")) & (F.col("first") - F.col("last") == net)
    return k.select("label", "kept", "lost", "gained", net.alias("net"), same.alias("identities"))


PAIRS_SQL = """s AS (SELECT DISTINCT label, scene FROM mk), pr AS (SELECT label, scene AS a, lead(scene) OVER (PARTITION BY label ORDER BY scene) AS b, 'adjacent' AS kind FROM s
  UNION ALL SELECT label, min(scene), max(scene), 'family' FROM s GROUP BY label HAVING min(scene) < max(scene))"""


@query("c03_pair_comparisons", f"WITH {MASKS_SQL}, {PAIRS_SQL} SELECT kind, pr.label, a AS from_scene, b AS to_scene, count(*) FILTER (x.pred AND y.pred) AS overlap, count(*) FILTER (x.pred AND NOT y.pred) AS lost, count(*) FILTER (y.pred AND NOT x.pred) AS gained, round(coalesce(count(*) FILTER (x.pred AND y.pred) / nullif(count(*) FILTER (x.pred OR y.pred), 0), 0), 6) AS jaccard FROM pr JOIN mk x ON x.scene = a JOIN mk y ON y.scene = b AND y.r = x.r AND y.c = x.c GROUP BY 1, 2, 3, 4")
def pair_comparisons(spark, sf):
    """Neighbouring scenes of a label, and its first with its last."""
    px = masks(spark, sf)
    s = px.select("label", "scene").distinct()
    near = s.select("label", F.col("scene").alias("a"), F.lead("scene").over(Window.partitionBy("label").orderBy("scene")).alias("b"), F.lit("adjacent").alias("kind")).filter("b is not null")
    family = s.groupBy("label").agg(F.min("scene").alias("a"), F.max("scene").alias("b")).filter("a < b").withColumn("kind", F.lit("family"))
    left = px.select(F.col("scene").alias("a"), "r", "c", F.col("pred").alias("p"))
    right = px.select(F.col("scene").alias("b"), "r", "c", F.col("pred").alias("q"))
    met = near.unionByName(family).join(left, "a").join(right, ["b", "r", "c"])
    p, q = F.col("p"), F.col("q")
    out = met.groupBy("kind", "label", F.col("a").alias("from_scene"), F.col("b").alias("to_scene")).agg(
        F.count_if(p & q).alias("overlap"), F.count_if(p & ~q).alias("lost"), F.count_if(q & ~p).alias("gained"), metrics.ratio(F.count_if(p & q), F.count_if(p | q)).alias("jaccard")
    )
    return rounded(out, "jaccard")


@query(
    "c04_stage_summary",
    f"""WITH {STAGES_SQL}, j AS (SELECT stage, kind, event_type, ts, value, event_id FROM events JOIN st ON ts >= a AND ts < b),
n AS (SELECT stage, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM j GROUP BY 1, 2),
x AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY stage, event_type ORDER BY CASE WHEN kind = 'trough' THEN value ELSE -value END, ts, event_id) = 1)
SELECT stage, event_type, n, mean, round(value, 6) AS extreme, ts AS anchor, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 3600e6, 2) AS offset_hours FROM n JOIN x USING (stage, event_type)""",
)
def stage_summary(spark, sf):
    """Mean and extreme reading of each stage, with the extreme's time as the anchor."""
    joined = temporal.in_intervals(read(spark, sf, "events").select("ts", "event_type", "value", "event_id"), "ts", stages(spark), "a", "b", 86400)
    sign = F.when(F.col("kind") == "trough", F.col("value")).otherwise(-F.col("value"))
    first = F.min(F.struct(sign.alias("s"), "ts", "event_id", "value"))
    k = joined.groupBy("stage", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), first.alias("x"))
    away = temporal.seconds(F.col("x.ts")) - temporal.seconds(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return rounded(k.select("stage", "event_type", "n", "mean", F.col("x.value").alias("extreme"), F.col("x.ts").alias("anchor"), F.round(away / 3600, 2).alias("offset_hours")), "mean", "extreme")


CELLS_SQL = f"{ENDS_SQL}, gc AS (SELECT label, r // 4 AS gr, c // 4 AS gc, 100.0::DOUBLE * count(*) FILTER (p) / count(*) AS before, 100.0::DOUBLE * count(*) FILTER (q) / count(*) AS after, count(*) FILTER (q AND NOT p) AS gain FROM ep GROUP BY 1, 2, 3)"


def grid_change(px):
    """Water shares of the first and last scene of a label by cells of four by four pixels."""
    n = F.count("*")
    cell = [F.floor(F.col(x) / 4).cast("int").alias(f"g{x}") for x in ("r", "c")]
    return endpoints(px).groupBy("label", *cell).agg((100.0 * F.count_if("p") / n).alias("before"), (100.0 * F.count_if("q") / n).alias("after"), F.count_if(F.col("q") & ~F.col("p")).alias("gain"))


@query("c05_grid_change", f"WITH {CELLS_SQL} SELECT label, gr::INT AS gr, gc::INT AS gc, before, after, after - before AS points, after - before > 5.88 AS above_context, CASE WHEN after - before > 5.88 THEN 'high' WHEN after - before >= 2 THEN 'moderate' WHEN after - before > 0 THEN 'low' ELSE 'none' END AS interpretation FROM gc")
def grid_change_table(spark, sf):
    d = F.col("after") - F.col("before")
    level = F.when(d > 5.88, "high").when(d >= 2, "moderate").when(d > 0, "low").otherwise("none")
    return grid_change(masks(spark, sf)).select("label", "gr", "gc", "before", "after", d.alias("points"), (d > 5.88).alias("above_context"), level.alias("interpretation"))


@query("c06_noise_comparison", f"WITH {MASKS_SQL} SELECT label, round(median(v), 6) + 0.0::DOUBLE AS middle, round(median(v) + 0.4, 6) AS above_floor, round(100.0::DOUBLE * count(*) FILTER (v < -0.1) / count(*), 6) AS below_pct, median(v) + 0.4 >= 0.03 AS usable FROM mk WHERE valid GROUP BY label")
def noise_comparison(spark, sf):
    """Values against a noise floor of -0.4."""
    px = masks(spark, sf).filter("valid")
    out = px.groupBy("label").agg((100.0 * F.count_if(F.col("v") < -0.1) / F.count("*")).alias("below_pct")).join(percentiles(px, ["label"], "v", {"middle": 0.5}), "label")
    above = F.col("middle") + 0.4
    out = out.select("label", "middle", above.alias("above_floor"), "below_pct", (above >= 0.03).alias("usable"))
    return rounded(out, "middle", "above_floor", "below_pct")


@query("c07_source_agreement", f"WITH {MASKS_SQL}, k AS (SELECT label, {CONFUSION}, count(*) FILTER (NOT valid) AS no_data FROM mk GROUP BY label) SELECT label, tp AS both, fp AS first_only, fn AS second_only, tn AS neither, no_data, round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS agreement FROM k")
def source_agreement(spark, sf):
    px = masks(spark, sf)
    k = metrics.confusion(px, ["label"], valid="valid", empty=None).join(px.groupBy("label").agg(F.count_if(~F.col("valid")).alias("no_data")), "label")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rounded(k.select("label", tp.alias("both"), fp.alias("first_only"), fn.alias("second_only"), tn.alias("neither"), "no_data", "iou", ((tp + tn) / (tp + fp + fn + tn)).alias("agreement")), "iou", "agreement")


BANDS_SQL = f"{POINTS_SQL}, {BOXES_SQL}, d AS (SELECT id, min({DISTANCE}) AS d FROM pt, bx GROUP BY id)"


@query("c08_exposure_matrix", f"WITH {BANDS_SQL} SELECT unnest(['inside', '50 m', '100 m', '250 m']) AS band, unnest([count(*) FILTER (d = 0), count(*) FILTER (d <= 50), count(*) FILTER (d <= 100), count(*) FILTER (d <= 250)]) AS places FROM d")
def exposure_matrix(spark, sf):
    """Places by their distance to the nearest box, in bands that include the nearer ones."""
    reach = 250.0
    b = geometry.spread(boxes(spark, sf), F.col("l") - reach, F.col("b") - reach, F.col("r") + reach, F.col("t") + reach, reach)
    p = points(spark, sf).withColumn("gx", F.floor(F.col("x") / reach).cast("long")).withColumn("gy", F.floor(F.col("y") / reach).cast("long"))
    d = geometry.box_distance(*(F.col(c) for c in ("x", "y", "l", "b", "r", "t")))
    near = p.join(b, ["gx", "gy"]).groupBy("id").agg(F.min(d).alias("d"))
    bands = {"inside": 0, "50 m": 50, "100 m": 100, "250 m": 250}
    return near.agg(*(F.count_if(F.col("d") <= v).alias(k) for k, v in bands.items())).unpivot([], list(bands), "band", "places")


@query("c09_priority_cells", f"WITH {CELLS_SQL} SELECT label, gr::INT AS gr, gc::INT AS gc, after - before AS points, concat_ws('; ', CASE WHEN after - before > 5.88 THEN 'above context' END, CASE WHEN gain >= 4 THEN 'large gain' END, CASE WHEN before = 0 THEN 'dry before' END) AS notes FROM gc WHERE after > before ORDER BY after - before DESC, gain DESC, label, gr, gc LIMIT 9")
def priority_cells(spark, sf):
    """The nine cells of greatest increase, with the evidence for each: the limit is the question."""
    d = F.col("after") - F.col("before")
    notes = F.concat_ws("; ", F.when(d > 5.88, "above context"), F.when(F.col("gain") >= 4, "large gain"), F.when(F.col("before") == 0, "dry before"))
    top = grid_change(masks(spark, sf)).withColumn("points", d).filter("points > 0").withColumn("notes", notes)
    return top.orderBy(F.desc("points"), F.desc("gain"), "label", "gr", "gc").limit(9).select("label", "gr", "gc", "points", "notes")


@query("c10_important_zones", ZONES_SQL + ", a AS (SELECT scene, zone, 'large' AS why FROM z QUALIFY row_number() OVER (PARTITION BY scene ORDER BY pixels DESC, zone) = 1 UNION SELECT scene, zone, 'place' FROM z WHERE places > 0) SELECT scene, zone, min(why) AS why, count(*) AS reasons, any_value(pixels) AS pixels FROM a JOIN z USING (scene, zone) GROUP BY 1, 2")
def important_zones(spark, sf):
    """The largest zone of each scene and every zone with a place, once each."""
    z = zone_table(spark, sf)
    w = Window.partitionBy("scene").orderBy(F.desc("pixels"), "zone")
    large = F.when(F.row_number().over(w) == 1, "large")
    place = F.when(F.col("places") > 0, "place")
    why = z.withColumn("whys", F.array_compact(F.array(large, place))).filter(F.size("whys") > 0)
    return why.select("scene", "zone", F.array_min("whys").alias("why"), F.size("whys").cast("long").alias("reasons"), "pixels")


@query("c11_final_metrics", f"WITH {MASKS_SQL}, m AS (SELECT count(DISTINCT scene)::DOUBLE AS scenes, round(count(*) FILTER (pred AND valid) * 0.04::DOUBLE, 6) AS water_ha, round(100.0::DOUBLE * count(*) FILTER (valid) / count(*), 6) AS valid_pct FROM mk), u AS (UNPIVOT m ON scenes, water_ha, valid_pct INTO NAME metric VALUE value) SELECT metric, value, CASE metric WHEN 'scenes' THEN 'count' WHEN 'water_ha' THEN 'ha' ELSE '%' END AS unit, metric <> 'valid_pct' AS claim FROM u")
def final_metrics(spark, sf):
    m = masks(spark, sf).agg(F.countDistinct("scene").cast("double").alias("scenes"), (F.count_if(F.col("pred") & F.col("valid")) * PIXEL_HA).alias("water_ha"), (100.0 * F.count_if("valid") / F.count("*")).alias("valid_pct"))
    units = spark.createDataFrame([("scenes", "count", True), ("water_ha", "ha", True), ("valid_pct", "%", False)], "metric string, unit string, claim boolean")
    rows = rounded(m, "scenes", "water_ha", "valid_pct").unpivot([], m.columns, "metric", "value")
    return rows.join(F.broadcast(units), "metric")


@query("c12_trajectory", f"WITH {MASKS_SQL}, s AS (SELECT label, scene, count(*) FILTER (pred AND valid) AS water FROM mk GROUP BY 1, 2) SELECT label, scene, row_number() OVER w AS place, water, water - first_value(water) OVER w AS from_first, max(water) OVER (PARTITION BY label) = water AS peak FROM s WINDOW w AS (PARTITION BY label ORDER BY scene)")
def trajectory(spark, sf):
    """Each label's water over its scenes; the windows run over scenes."""
    s = masks(spark, sf).groupBy("label", "scene").agg(F.count_if(F.col("pred") & F.col("valid")).alias("water"))
    w = Window.partitionBy("label").orderBy("scene")
    return s.select("label", "scene", F.row_number().over(w).cast("long").alias("place"), "water", (F.col("water") - F.first("water").over(w)).alias("from_first"), (F.max("water").over(Window.partitionBy("label")) == F.col("water")).alias("peak"))


@query("c13_feasibility", "WITH g AS (SELECT o_custkey, o_orderdate, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400e6 AS gap FROM orders) SELECT o_custkey, count(*) AS acquisitions, count(DISTINCT year(o_orderdate)) AS years, round(max(gap), 6) AS longest_gap, round(avg(gap), 6) AS mean_gap, coalesce(max(gap) > 365, true) AS sparse FROM g GROUP BY 1")
def feasibility(spark, sf):
    """Coverage by key: how many, over how many years, with what gaps."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = temporal.seconds(F.col("o_orderdate")) / 86400
    g = read(spark, sf, "orders").select("o_custkey", "o_orderdate", (day - F.lag(day).over(w)).alias("gap"))
    out = g.groupBy("o_custkey").agg(F.count("*").alias("acquisitions"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.max("gap").alias("longest_gap"), F.avg("gap").alias("mean_gap"), F.coalesce(F.max("gap") > 365, F.lit(True)).alias("sparse"))
    return rounded(out, "longest_gap", "mean_gap")


@query(
    "c14_separation_sensitivity",
    f"""WITH {MASKS_SQL}, t AS (SELECT label, round((quantile_cont(v, 0.75) FILTER (ref) + quantile_cont(v, 0.25) FILTER (NOT ref)) / 2, 6) AS threshold FROM mk WHERE valid GROUP BY label)
SELECT mk.label, any_value(threshold) AS threshold, round(median(v) FILTER (NOT ref) - median(v) FILTER (ref), 6) AS gap, count(*) FILTER (v < threshold - 0.01) AS lower, count(*) FILTER (v < threshold) AS own, count(*) FILTER (v < threshold + 0.01) AS higher
FROM mk JOIN t USING (label) WHERE valid GROUP BY mk.label""",
)
def separation_sensitivity(spark, sf):
    """Quartile-gap threshold of each label, the gap of its medians, and the water that a step to either side changes."""
    px = masks(spark, sf).filter("valid")
    q = sides(percentiles(px, ["label", "ref"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    t = q.select("label", F.round((F.col("water_q3") + F.col("land_q1")) / 2, 6).alias("threshold"), (F.col("land_q2") - F.col("water_q2")).alias("gap"))
    below = lambda by: F.count_if(F.col("v") < F.col("threshold") + by)
    out = px.join(t, "label").groupBy("label", "threshold", "gap").agg(below(-0.01).alias("lower"), below(0.0).alias("own"), below(0.01).alias("higher"))
    return rounded(out, "gap")


@query("c15_platform_audit", f"WITH {MASKS_SQL}, s AS (SELECT scene, any_value(label % 2) AS platform, count(*) = 64 AS whole, count(*) FILTER (valid) / 64.0::DOUBLE AS good, avg(v) AS mean FROM mk GROUP BY scene) SELECT platform, count(*) AS scenes, bool_and(whole) AS all_whole, round(avg(good), 6) AS mean_valid, round(avg(mean), 6) + 0.0::DOUBLE AS mean_value, round(stddev_samp(mean), 6) AS spread FROM s GROUP BY platform")
def platform_audit(spark, sf):
    s = masks(spark, sf).groupBy("scene").agg((F.first("label") % 2).alias("platform"), (F.count("*") == 64).alias("whole"), (F.count_if("valid") / 64).alias("good"), F.avg("v").alias("mean"))
    out = s.groupBy("platform").agg(F.count("*").alias("scenes"), F.every("whole").alias("all_whole"), F.avg("good").alias("mean_valid"), F.avg("mean").alias("mean_value"), F.stddev_samp("mean").alias("spread"))
    return rounded(out, "mean_valid", "mean_value", "spread")


TWO_SQL = "u AS (SELECT label, pred, valid, unnest(['reference', 'permanent']) AS against, unnest([ref, permanent]) AS ref FROM mk)"


@query("c16_optical_validation", f"WITH {MASKS_SQL}, {TWO_SQL}, k AS (SELECT against, label, {CONFUSION} FROM u GROUP BY 1, 2) SELECT against, label, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM k")
def optical_validation(spark, sf):
    """One prediction against two references, in one pass."""
    two = F.explode(F.array(*(F.struct(F.lit(n).alias("against"), F.col(c).alias("ref")) for n, c in (("reference", "ref"), ("permanent", "permanent")))))
    u = masks(spark, sf).select("label", "pred", "valid", two.alias("x")).select("label", "pred", "valid", "x.*")
    return rounded(metrics.confusion(u, ["against", "label"], valid="valid").select("against", "label", "tp", "fp", "fn", "tn", "precision", "recall", "iou"), "precision", "recall", "iou")


@query(
    "c17_method_ladder",
    f"""WITH RECURSIVE {FINAL_SQL}, l AS (SELECT label, ref, valid, unnest(['1 simple', '2 lowland', '3 terrain', '4 policy']) AS method, unnest([pred, pred AND elev <= 5, normal OR exception, ordinary OR small]) AS pred FROM f),
k AS (SELECT method, label, {CONFUSION} FROM l GROUP BY 1, 2), s AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)
SELECT method, count(*) AS scenes, round(median(iou), 6) AS median_iou, round(median(f1), 6) AS median_f1, round(min(iou), 6) AS worst_iou, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY method""",
)
def method_ladder(spark, sf):
    """Methods of growing care, side by side."""
    said = {"1 simple": F.col("pred"), "2 lowland": F.col("pred") & (F.col("elev") <= 5), "3 terrain": F.col("terrain"), "4 policy": F.col("flood")}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), c.alias("said")) for n, c in said.items())))
    px = final_masks(masks(spark, sf)).select("label", "ref", "valid", rows.alias("x")).select("label", "ref", "valid", "x.*")
    s = metrics.pooled(metrics.confusion(px, ["method", "label"], pred="said", valid="valid"), ["method"])
    return rounded(s.select("method", "scenes", "median_iou", "median_f1", "worst_iou", "tp", "fp", "fn"), "median_iou", "median_f1", "worst_iou")


@query("c19_calibration_qa", "SELECT l_orderkey, l_linenumber, round((l_quantity * l_quantity + 2) / gain, 6) AS direct, round(abs(l_extendedprice - l_extendedprice * (1 + 1e-6 * l_linenumber)) / l_extendedprice, 9) AS error, abs(l_extendedprice - l_extendedprice * (1 + 1e-6 * l_linenumber)) / l_extendedprice <= 5e-6 AS passed FROM lineitem JOIN (SELECT unnest(range(1, 8)) AS n, unnest([1.5::DOUBLE, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]) AS gain) g ON n = l_linenumber")
def calibration_qa(spark, sf):
    """The formula with gains from a table, and a second product within its tolerance."""
    gains = spark.createDataFrame([(n, n + 0.5) for n in range(1, 8)], "l_linenumber int, gain double")
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").join(F.broadcast(gains), "l_linenumber")
    own, other = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + 1e-6 * F.col("l_linenumber"))
    error = F.abs(own - other) / own
    direct = (F.col("l_quantity") * F.col("l_quantity") + 2) / F.col("gain")
    return rows.select("l_orderkey", "l_linenumber", F.round(direct, 6).alias("direct"), F.round(error, 9).alias("error"), (error <= 5e-6).alias("passed"))


@query("c20_value_and_area_audit", f"WITH {MASKS_SQL} SELECT scene, count(*) FILTER (valid) AS n, round(min(v) FILTER (valid), 6) + 0.0::DOUBLE AS least, round(max(v) FILTER (valid), 6) + 0.0::DOUBLE AS most, round(median(v) FILTER (valid), 6) + 0.0::DOUBLE AS middle, round(count(*) FILTER (ref AND valid) * 0.04::DOUBLE, 6) AS reference_ha, count(*) FILTER (ref AND permanent) AS rasterized FROM mk GROUP BY scene")
def value_and_area_audit(spark, sf):
    x = F.when(F.col("valid"), F.col("v"))
    out = masks(spark, sf).groupBy("scene").agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.percentile(x, F.lit(0.5)).alias("middle"), (F.count_if(F.col("ref") & F.col("valid")) * PIXEL_HA).alias("reference_ha"), F.count_if(F.col("ref") & F.col("permanent")).alias("rasterized"))
    return rounded(out, "least", "most", "middle", "reference_ha")


@query("c21_observation_qa", f"WITH {MASKS_SQL} SELECT scene, round(100.0::DOUBLE * count(*) FILTER (pred AND dist <= 90) / greatest(count(*) FILTER (pred), 1), 6) AS near_pct, count(*) FILTER (pred AND elev > 5) AS high, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (NOT valid) <= 6 AS passed, 'multisource v1' AS method FROM mk GROUP BY scene")
def observation_qa(spark, sf):
    p, bad = F.col("pred"), F.count_if(~F.col("valid"))
    out = masks(spark, sf).groupBy("scene").agg((100.0 * F.count_if(p & (F.col("dist") <= 90)) / F.greatest(F.count_if(p), F.lit(1))).alias("near_pct"), F.count_if(p & (F.col("elev") > 5)).alias("high"), bad.alias("invalid"), (bad <= 6).alias("passed"), F.lit("multisource v1").alias("method"))
    return rounded(out, "near_pct")


@query(
    "c22_scene_features",
    f"""WITH {MASKS_SQL}, {FOCAL_SQL} SELECT mk.scene, mk.r, mk.c, round(CASE WHEN mk.v + 0.5 > 0 THEN 10 * log10(greatest(mk.v + 0.5, 1e-12)) END, 6) + 0.0::DOUBLE AS db,
  round(mean, 6) + 0.0::DOUBLE AS mean, round(sqrt(greatest(mean_sq - mean * mean, 0)), 6) AS texture, valid AND mk.v + 0.5 > 0 AS usable FROM mk JOIN mo USING (scene, r, c)""",
)
def scene_features(spark, sf):
    """Bands in decibels, their neighbourhood, and whether a pixel can be used."""
    px = masks(spark, sf)
    m = raster.focal(px, "v", 1, 8, 8, keep=["v", "valid"])
    power = F.col("v") + 0.5
    out = m.select(*PIXEL, X.decibels(power).alias("db"), "mean", raster.local_std(m).alias("texture"), (F.col("valid") & (power > 0)).alias("usable"))
    return rounded(out, "db", "mean", "texture")
