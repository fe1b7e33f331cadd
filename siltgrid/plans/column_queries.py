"""Queries of projections, small joins, totals, order and scalar functions, each by a rule of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.functions import expressions as X
from siltgrid.operators import metrics, raster
from siltgrid.operators.quantiles import percentiles
from siltgrid.sources.tables import MASKS_SQL, PIXEL_HA, PIXELS_SQL, SIDE, masks, pixels, read

from .raster_queries import cc, rounded, sides
from .registry import query

PIXEL = ["scene", "r", "c"]


@query("p03_insert_column", "SELECT n_nationkey, 'nation' AS kind, n_name, n_regionkey FROM nation")
def insert_column(spark, sf):
    nation = read(spark, sf, "nation")
    names = [F.col(c) for c in nation.columns]
    return nation.select(*names[:1], F.lit("nation").alias("kind"), *names[1:])


@query("p11_mask_code", f"WITH {MASKS_SQL} SELECT scene, count(*) FILTER (((r * 8 + c) + scene) % 3 = 1) AS coded FROM mk GROUP BY scene")
def mask_code(spark, sf):
    code = (F.col("r") * 8 + F.col("c") + F.col("scene")) % 3
    return masks(spark, sf).groupBy("scene").agg(F.count_if(code == 1).alias("coded"))


@query(
    "p12_threshold_classify",
    f"""WITH {MASKS_SQL}, t AS (SELECT * FROM (VALUES (0, -0.03::DOUBLE), (1, 0.02::DOUBLE)) t(mode, thr))
SELECT label, count(*) FILTER (v < coalesce(thr, 0.01) AND valid) AS water, count(*) FILTER (valid) AS pixels
FROM mk LEFT JOIN t ON t.mode = label % 3 GROUP BY label""",
)
def threshold_classify(spark, sf):
    """A threshold for each mode that has one, else the global one."""
    thresholds = spark.createDataFrame([(0, -0.03), (1, 0.02)], "mode int, thr double")
    px = masks(spark, sf).withColumn("mode", F.col("label") % 3).join(F.broadcast(thresholds), "mode", "left")
    water = (F.col("v") < F.coalesce("thr", F.lit(0.01))) & F.col("valid")
    return px.groupBy("label").agg(F.count_if(water).alias("water"), F.count_if(F.col("valid")).alias("pixels"))


@query("p14_mask_subtraction", f"WITH {MASKS_SQL} SELECT scene, r, c, pred AND NOT permanent AND valid AS flood FROM mk")
def mask_subtraction(spark, sf):
    flood = F.col("pred") & ~F.col("permanent") & F.col("valid")
    return masks(spark, sf).select(*PIXEL, flood.alias("flood"))


CONTEXT_SQL = """k AS (SELECT *, valid AND pred AND elev <= 5 AND (NOT permanent OR -v >= 0.05) AS kept, permanent AS cropland,
  NOT permanent OR -v >= 0.05 AS confident, dist <= 0 AS hydro FROM mk)"""


def constrained(px):
    """Lowland and cropland-darkness rules on a candidate mask, with the flags that explain them."""
    confident = ~F.col("permanent") | (-F.col("v") >= 0.05)
    return px.select(
        "*",
        (F.col("valid") & F.col("pred") & (F.col("elev") <= 5) & confident).alias("kept"),
        (F.col("elev") <= 5).alias("elevation_ok"),
        F.col("permanent").alias("cropland"),
        confident.alias("cropland_confident"),
        (F.col("dist") <= 90).alias("within_90m"),
        (F.col("dist") <= 300).alias("within_300m"),
        (F.col("dist") <= 0).alias("hydro"),
    )


@query(
    "p15_context_constraint",
    f"""WITH RECURSIVE {MASKS_SQL}, {CONTEXT_SQL}, fg AS (SELECT scene, r, c, r * 8 + c AS id, hydro FROM k WHERE kept),
reach(scene, r, c) AS (SELECT scene, r, c FROM fg WHERE hydro UNION SELECT f.scene, f.r, f.c FROM reach JOIN fg f
  ON f.scene = reach.scene AND abs(f.r - reach.r) <= 1 AND abs(f.c - reach.c) <= 1)
SELECT k.scene, k.r, k.c, kept, elev <= 5 AS elevation_ok, cropland, confident AS cropland_confident,
  dist <= 90 AS within_90m, dist <= 300 AS within_300m, reach.scene IS NOT NULL AS hydro_connected FROM k LEFT JOIN reach USING (scene, r, c)""",
)
def context_constraint(spark, sf):
    """The sixth flag: the pixel's component reaches the hydrography."""
    k = constrained(masks(spark, sf))
    seeds = k.filter("hydro and kept").select(*PIXEL)
    connected = raster.touching(raster.components(k, "kept"), seeds).select(*PIXEL, F.lit(True).alias("hydro_connected"))
    flags = ["kept", "elevation_ok", "cropland", "cropland_confident", "within_90m", "within_300m"]
    return k.join(connected, PIXEL, "left").select(*PIXEL, *flags, F.coalesce("hydro_connected", F.lit(False)).alias("hydro_connected"))


@query(
    "p17_reason_encode",
    f"""WITH {MASKS_SQL} SELECT scene, r, c, (CASE WHEN NOT valid THEN 1 ELSE 0 END + CASE WHEN pred THEN 2 ELSE 0 END
  + CASE WHEN permanent THEN 4 ELSE 0 END + CASE WHEN elev > 5 THEN 8 ELSE 0 END + CASE WHEN dist > 60 THEN 16 ELSE 0 END
  + CASE WHEN ref THEN 32 ELSE 0 END + CASE WHEN v < -0.1 THEN 64 ELSE 0 END)::INT AS reasons FROM mk""",
)
def reason_encode(spark, sf):
    conditions = [~F.col("valid"), F.col("pred"), F.col("permanent"), F.col("elev") > 5, F.col("dist") > 60, F.col("ref"), F.col("v") < -0.1]
    return masks(spark, sf).select(*PIXEL, X.flags(*conditions).alias("reasons"))


@query(
    "p25_mode_group",
    """SELECT CASE WHEN starts_with(o_orderpriority, '1') AND o_orderstatus = 'O' THEN 'urgent open' WHEN starts_with(o_orderpriority, '1') THEN 'urgent'
  WHEN starts_with(o_orderpriority, '2') AND o_orderstatus = 'F' THEN 'high done' ELSE 'other' END AS mode_group, count(*) AS n FROM orders GROUP BY 1""",
)
def mode_group(spark, sf):
    first = lambda digit: F.col("o_orderpriority").startswith(digit)
    open_, done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    group = F.when(first("1") & open_, "urgent open").when(first("1"), "urgent").when(first("2") & done, "high done").otherwise("other")
    return read(spark, sf, "orders").groupBy(group.alias("mode_group")).agg(F.count("*").alias("n"))


@query("p26_prefix_default", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), CASE WHEN starts_with(p_type, 'STANDARD') THEN 'standard' ELSE 'any' END) AS resolved FROM part")
def prefix_default(spark, sf):
    default = F.when(F.col("p_type").startswith("STANDARD"), "standard").otherwise("any")
    return read(spark, sf, "part").select("p_partkey", F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), default).alias("resolved"))


@query("p27_layer_subset", f"WITH {MASKS_SQL}, l AS (SELECT CASE WHEN pred AND permanent THEN 'permanent' WHEN pred AND ref THEN 'agreed' WHEN pred THEN 'new' WHEN ref THEN 'missed' ELSE 'land' END AS layer FROM mk WHERE valid) SELECT layer, count(*) AS n FROM l WHERE layer IN ('permanent', 'agreed', 'missed') GROUP BY layer")
def layer_subset(spark, sf):
    p, r = F.col("pred"), F.col("ref")
    layer = F.when(p & F.col("permanent"), "permanent").when(p & r, "agreed").when(p, "new").when(r, "missed").otherwise("land")
    shown = ["permanent", "agreed", "missed"]
    return masks(spark, sf).filter("valid").select(layer.alias("layer")).filter(F.col("layer").isin(shown)).groupBy("layer").agg(F.count("*").alias("n"))


@query("p30_sentinel", f"WITH {MASKS_SQL} SELECT scene, r, c, round(CASE WHEN valid THEN v ELSE -9999 END, 6) + 0.0::DOUBLE AS stored FROM mk")
def sentinel(spark, sf):
    return rounded(masks(spark, sf).select(*PIXEL, F.when(F.col("valid"), F.col("v")).otherwise(-9999.0).alias("stored")), "stored")


@query("j02_left_join_subset", "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_subset(spark, sf):
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(names, "c_nationkey", "left")


@query(
    "j04_full_outer_counts",
    """SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0)::INT AS customers, coalesce(b.n, 0)::INT AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_counts(spark, sf):
    a = read(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = read(spark, sf, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return a.join(b, "nation", "full").select("nation", zero("customers"), zero("suppliers"))


@query(
    "j05_ordered_lookup",
    """WITH w AS (SELECT * FROM (VALUES (1, 7), (2, 3), (3, 24), (4, 99)) w(place, k)), j AS (SELECT place, k, n_name FROM w LEFT JOIN nation ON n_nationkey = k)
SELECT place, k, n_name, bool_and(n_name IS NOT NULL) OVER () AS all_found FROM j""",
)
def ordered_lookup(spark, sf):
    """Wanted keys in their order, and whether the set is exactly there. The wanted list is a constant of four rows."""
    wanted = spark.createDataFrame([(1, 7), (2, 3), (3, 24), (4, 99)], "place int, k int")
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), "n_name")
    found = F.broadcast(wanted).join(nation, "k", "left")
    missing = F.broadcast(wanted.join(nation, "k", "left_anti").agg((F.count("*") == 0).alias("all_found")))
    return found.crossJoin(missing).select("place", "k", "n_name", "all_found")


@query(
    "j15_fold_candidates",
    f"""WITH {MASKS_SQL}, f AS (SELECT DISTINCT label % 5 AS fold FROM mk) SELECT rep, thr, h.fold AS heldout, f.fold AS train
FROM (VALUES ('raw'), ('smooth')) a(rep), (VALUES (-0.02::DOUBLE), (0.0::DOUBLE), (0.02::DOUBLE)) b(thr), f h JOIN f ON h.fold <> f.fold""",
)
def fold_candidates(spark, sf):
    """Parameter tables of fixed size: representation x candidate x fold, without the fold itself."""
    folds = masks(spark, sf).select((F.col("label") % 5).alias("train")).distinct()
    grid = spark.createDataFrame([(r, t) for r in ("raw", "smooth") for t in (-0.02, 0.0, 0.02)], "rep string, thr double")
    pairs = folds.withColumnRenamed("train", "heldout").join(F.broadcast(folds), F.col("heldout") != F.col("train"))
    return pairs.crossJoin(F.broadcast(grid)).select("rep", "thr", "heldout", "train")


@query("j16_aligned_pixels", f"WITH {MASKS_SQL} SELECT a.scene, count(*) AS both, round(sum(a.v * b.elev), 6) + 0.0::DOUBLE AS weighted FROM mk a JOIN mk b ON a.scene = b.scene AND a.r = b.r AND a.c = b.c WHERE a.pred AND b.valid GROUP BY 1")
def aligned_pixels(spark, sf):
    """Two co-indexed rasters joined on scene, row and column."""
    px = masks(spark, sf)
    a, b = px.filter("pred").select(*PIXEL, "v"), px.filter("valid").select(*PIXEL, "elev")
    out = a.join(b, PIXEL).groupBy("scene").agg(F.count("*").alias("both"), F.sum(F.col("v") * F.col("elev")).alias("weighted"))
    return rounded(out, "weighted")


@query("j23_seeded_components", cc("pred") + " SELECT scene, count(*) AS pixels, count(DISTINCT component) AS components FROM cc WHERE (scene, component) IN (SELECT scene, component FROM cc JOIN mk USING (scene, r, c) WHERE dist <= 15) GROUP BY scene")
def seeded_components(spark, sf):
    px = masks(spark, sf)
    hit = raster.touching(raster.components(px, "pred"), px.filter("dist <= 15").select(*PIXEL))
    return hit.groupBy("scene").agg(F.count("*").alias("pixels"), F.countDistinct("component").alias("components"))


@query(
    "j24_manifest_join",
    """SELECT count(*) FILTER (d.h = m.h) AS same, count(*) FILTER (d.h <> m.h) AS changed, count(*) FILTER (m.h IS NULL) AS absent
FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) d
LEFT JOIN (SELECT doc_id, md5(CASE WHEN quality = 1 THEN coalesce(text, '') ELSE '' END) AS h FROM labels JOIN documents USING (doc_id)) m USING (doc_id)""",
)
def manifest_join(spark, sf):
    """Digests of all texts against a manifest of the labelled ones, in which those of low quality are out of date."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf, "documents").select("doc_id", "text")
    stated = read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 1, text).otherwise("")).alias("stated"))
    both = docs.select("doc_id", F.md5(text).alias("actual")).join(stated, "doc_id", "left")
    a, s = F.col("actual"), F.col("stated")
    return both.agg(F.count_if(a == s).alias("same"), F.count_if(a != s).alias("changed"), F.count_if(s.isNull()).alias("absent"))


@query("a03_mask_area", f"WITH {MASKS_SQL} SELECT scene, round(count(*) FILTER (pred) * 0.04::DOUBLE, 6) AS area_ha, round(count(*) FILTER (pred) * 0.09::DOUBLE, 6) AS coarse_ha FROM mk GROUP BY scene")
def mask_area(spark, sf):
    n = F.sum(F.col("pred").cast("int"))
    return rounded(masks(spark, sf).groupBy("scene").agg((n * PIXEL_HA).alias("area_ha"), (n * 0.09).alias("coarse_ha")), "area_ha", "coarse_ha")


@query("a12_report_table", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 6) AS price, round(stddev_samp(l_discount), 6) AS spread FROM lineitem GROUP BY 1, 2")
def report_table(spark, sf):
    out = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.stddev_samp("l_discount").alias("spread"))
    return rounded(out, "quantity", "price", "spread")


@query("a19_context_share", f"WITH {MASKS_SQL} SELECT label, round(100.0::DOUBLE * count(*) FILTER (pred AND dist <= 90) / greatest(count(*) FILTER (pred), 1), 6) AS near_pct, round(100.0::DOUBLE * count(*) FILTER (pred AND elev <= 5) / greatest(count(*) FILTER (pred), 1), 6) AS low_pct FROM mk GROUP BY label")
def context_share(spark, sf):
    p = F.col("pred")
    n = F.greatest(F.count_if(p), F.lit(1))
    out = masks(spark, sf).groupBy("label").agg((100.0 * F.count_if(p & (F.col("dist") <= 90)) / n).alias("near_pct"), (100.0 * F.count_if(p & (F.col("elev") <= 5)) / n).alias("low_pct"))
    return rounded(out, "near_pct", "low_pct")


@query("a25_component_sizes", cc("pred") + ", s AS (SELECT scene, component, count(*) AS size FROM cc GROUP BY 1, 2) SELECT size, count(*) AS components FROM s GROUP BY size")
def component_sizes(spark, sf):
    sizes = raster.components(masks(spark, sf), "pred").groupBy("scene", "component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


@query("a26_component_scores", cc("pred") + " SELECT scene, component, round(avg(0.5 - v), 6) AS score, bool_and(dist <= 60) AS all_near FROM cc JOIN mk USING (scene, r, c) GROUP BY 1, 2")
def component_scores(spark, sf):
    px = masks(spark, sf)
    lab = raster.components(px, "pred").join(px.select(*PIXEL, "v", "dist"), PIXEL)
    return rounded(lab.groupBy("scene", "component").agg(F.avg(0.5 - F.col("v")).alias("score"), F.every(F.col("dist") <= 60).alias("all_near")), "score")


@query("a29_all_scenes_and", f"WITH {MASKS_SQL} SELECT label, r, c, bool_and(valid) AS all_valid, bool_or(pred) AS any_pred FROM mk GROUP BY 1, 2, 3")
def all_scenes_and(spark, sf):
    return masks(spark, sf).groupBy("label", "r", "c").agg(F.every("valid").alias("all_valid"), F.some("pred").alias("any_pred"))


@query("a32_importance_spread", f"WITH {MASKS_SQL}, f AS (SELECT label % 5 AS fold, abs(corr(v, ref::INT)) AS v, abs(corr(elev, ref::INT)) AS elev, abs(corr(dist, ref::INT)) AS dist FROM mk GROUP BY 1), u AS (UNPIVOT f ON v, elev, dist INTO NAME feature VALUE weight) SELECT feature, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std FROM u GROUP BY feature")
def importance_spread(spark, sf):
    """Weights of features by fold, summed up over folds."""
    names = ["v", "elev", "dist"]
    ref = F.col("ref").cast("int")
    folds = masks(spark, sf).groupBy((F.col("label") % 5).alias("fold")).agg(*(F.abs(F.corr(n, ref)).alias(n) for n in names))
    rows = folds.unpivot(["fold"], names, "feature", "weight").groupBy("feature").agg(F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("std"))
    return rounded(rows, "mean", "std")


@query("a34_metric_lookup", "SELECT 'orders' AS metric, count(*)::DOUBLE AS value, true AS single FROM orders")
def metric_lookup(spark, sf):
    """One named value of a metrics table; single is false where the name is absent or repeated."""
    table = read(spark, sf, "orders").agg(F.count("*").cast("double").alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = table.unpivot([], ["orders", "total"], "metric", "value").filter("metric = 'orders'")
    return rows.groupBy("metric").agg(F.first("value").alias("value"), (F.count("*") == 1).alias("single"))


@query("a35_product_bytes", "SELECT source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY source")
def product_bytes(spark, sf):
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return read(spark, sf, "documents").groupBy("source").agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


@query(
    "a37_support_summary",
    f"""WITH {MASKS_SQL} SELECT scene, round(avg(dist) FILTER (valid), 6) AS mean, round(stddev_samp(dist) FILTER (valid), 6) AS std, min(dist) FILTER (valid) AS least,
  max(dist) FILTER (valid) AS most, count(*) FILTER (valid) AS good, count(*) FILTER (NOT valid) AS bad, round(100.0::DOUBLE * count(*) FILTER (valid) / count(*), 6) AS good_pct FROM mk GROUP BY scene""",
)
def support_summary(spark, sf):
    ok = F.col("valid")
    x = F.when(ok, F.col("dist"))
    out = masks(spark, sf).groupBy("scene").agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.count_if(ok).alias("good"),
        F.count_if(~ok).alias("bad"),
        (100.0 * F.count_if(ok) / F.count("*")).alias("good_pct"),
    )
    return rounded(out, "mean", "std", "good_pct")


@query("w03_running_sums", f"WITH {PIXELS_SQL}, h AS (SELECT label, floor(v / 0.05)::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2) SELECT label, bin, n, sum(n) OVER (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM h")
def running_sums(spark, sf):
    """The windows run over bins, not pixels."""
    bins = pixels(spark, sf).groupBy("label", F.floor(F.col("v") / 0.05).alias("bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


@query("w05_first_in_group", "SELECT lang, source, min(text) AS first_text FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def first_in_group(spark, sf):
    """The lexicographically first item of each group, by a partial minimum of whole texts."""
    return read(spark, sf, "documents").filter("text is not null").groupBy("lang", "source").agg(F.min("text").alias("first_text"))


@query("w07_group_offset", "SELECT user_id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS off FROM events GROUP BY user_id")
def group_offset(spark, sf):
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return rounded(read(spark, sf, "events").groupBy("user_id").agg((of("click") - of("view")).alias("off")), "off")


@query(
    "w09_focal_moments",
    f"""WITH {PIXELS_SQL}, p AS (SELECT px.scene, px.r, px.c, a.k AS dr, b.k AS dc FROM px, (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b)
SELECT p.scene, p.r, p.c, round(avg(q.v), 6) + 0.0::DOUBLE AS mean, round(avg(q.v * q.v), 6) AS mean_sq, count(*) AS n
FROM p JOIN px q ON q.scene = p.scene AND q.r = greatest(0, least(7, p.r + dr)) AND q.c = greatest(0, least(7, p.c + dc)) GROUP BY 1, 2, 3""",
)
def focal_moments(spark, sf):
    """Five by five moments with repeated edges."""
    return rounded(raster.focal(pixels(spark, sf), "v", 2, SIDE, SIDE), "mean", "mean_sq")


@query("w15_share_of_total", "WITH k AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang), 6) AS pct FROM k")
def share_of_total(spark, sf):
    k = read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rounded(k.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang"))), "pct")


@query("t06_extreme_rows", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def extreme_rows(spark, sf):
    by = F.struct("o_totalprice", "o_orderkey")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("t07_first_best_bin", f"WITH {PIXELS_SQL}, h AS (SELECT label, floor(v / 0.1)::BIGINT AS bin, count(*) AS n FROM px GROUP BY 1, 2) SELECT label, bin, n FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, bin) = 1")
def first_best_bin(spark, sf):
    """The fullest bin, the lowest on ties, as the greatest pair."""
    bins = pixels(spark, sf).groupBy("label", F.floor(F.col("v") / 0.1).alias("bin")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("bin")).alias("low")))
    return bins.groupBy("label").agg(best.alias("b")).select("label", (-F.col("b.low")).alias("bin"), F.col("b.n").alias("n"))


@query("u04_jaccard", f"WITH {MASKS_SQL} SELECT scene, round(coalesce(count(*) FILTER (pred AND ref) / nullif(count(*) FILTER (pred OR ref), 0), 0), 6) AS jaccard FROM mk WHERE valid GROUP BY scene")
def jaccard(spark, sf):
    p, r = F.col("pred"), F.col("ref")
    return rounded(masks(spark, sf).filter("valid").groupBy("scene").agg(metrics.ratio(F.count_if(p & r), F.count_if(p | r)).alias("jaccard")), "jaccard")


@query("f02_calibration", "SELECT l_orderkey, l_linenumber, round((l_quantity * l_quantity + 3) / (1 + l_linenumber), 6) AS power FROM lineitem")
def calibration(spark, sf):
    dn = F.col("l_quantity")
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((dn * dn + 3) / (1 + F.col("l_linenumber"))).alias("power")), "power")


@query("f04_quartile_gap", f"WITH {MASKS_SQL} SELECT label, round((quantile_cont(v, 0.75) FILTER (ref) + quantile_cont(v, 0.25) FILTER (NOT ref)) / 2, 6) AS threshold FROM mk GROUP BY label")
def quartile_gap(spark, sf):
    q = sides(percentiles(masks(spark, sf), ["label", "ref"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    return rounded(q.select("label", ((F.col("water_q3") + F.col("land_q1")) / 2).alias("threshold")), "threshold")


@query("f05_relative_error", "SELECT p_partkey, round(abs(p_retailprice * 1.00001 - p_retailprice) / p_retailprice, 9) AS error, abs(p_retailprice + p_partkey % 3 * 0.02 - p_retailprice) / p_retailprice <= 1e-5 AS passed FROM part")
def relative_error(spark, sf):
    price = F.col("p_retailprice")
    error = F.abs(price * 1.00001 - price) / price
    passed = F.abs(price + F.col("p_partkey") % 3 * 0.02 - price) / price <= 1e-5
    return read(spark, sf, "part").select("p_partkey", F.round(error, 9).alias("error"), passed.alias("passed"))


@query("f06_unit_conversions", f"WITH {MASKS_SQL} SELECT scene, round(100.0::DOUBLE * count(*) FILTER (pred) / count(*) - 100.0::DOUBLE * count(*) FILTER (ref) / count(*), 6) AS points, round(count(*) * 400 / 1e6, 6) AS km2, round(count(*) * 400 / 1e4, 6) AS hectares FROM mk GROUP BY scene")
def unit_conversions(spark, sf):
    n = F.count("*")
    pct = lambda m: 100.0 * F.count_if(F.col(m)) / n
    out = masks(spark, sf).groupBy("scene").agg((pct("pred") - pct("ref")).alias("points"), (n * 400 / 1e6).alias("km2"), (n * 400 / 1e4).alias("hectares"))
    return rounded(out, "points", "km2", "hectares")


@query("f07_scores_from_counts", "SELECT l_orderkey, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM (SELECT l_orderkey, sum(l_quantity) AS tp, sum(l_linenumber) AS fp, count(*) AS fn FROM lineitem GROUP BY 1)")
def scores_from_counts(spark, sf):
    k = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tp"), F.sum("l_linenumber").alias("fp"), F.count("*").alias("fn"))
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return rounded(k.select("l_orderkey", metrics.ratio(2 * tp, 2 * tp + wrong).alias("f1"), metrics.ratio(tp, tp + wrong).alias("iou")), "f1", "iou")


@query("f12_time_text", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact, strftime(ts, '%d %b %Y %H:%M UTC') AS readable, strftime(ts, '%Y-%m-%d') AS day FROM events")
def time_text(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").select("event_id", F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'").alias("compact"), F.date_format(ts, "dd MMM yyyy HH:mm 'UTC'").alias("readable"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


@query("f13_epoch_differences", "SELECT event_id, year(ts)::INT AS year, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 3600e6, 6) AS hours, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 86400e6, 6) AS days FROM events")
def epoch_differences(spark, sf):
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    away = micros(F.col("ts")) - micros(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rounded(read(spark, sf, "events").select("event_id", F.year("ts").alias("year"), (away / 3600e6).alias("hours"), (away / 86400e6).alias("days")), "hours", "days")


@query("f16_road_label", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'OSM way ' || s_suppkey WHEN s_suppkey % 3 = 0 THEN s_name || ' / ' || s_nationkey ELSE s_name END AS label FROM supplier")
def road_label(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 4 != 0, F.col("s_name"))
    ref = F.when(name.isNotNull() & (k % 3 == 0), F.col("s_nationkey").cast("string"))
    return read(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.nullif(F.concat_ws(" / ", name, ref), F.lit("")), F.concat(F.lit("OSM way "), k.cast("string"))).alias("label"))


@query("f19_cache_key", "SELECT doc_id, sha256(concat_ws('|', lang, source, n_chars, doc_id, 'grid8')) AS key FROM documents")
def cache_key(spark, sf):
    parts = [F.col(c).cast("string") for c in ("lang", "source", "n_chars", "doc_id")]
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", *parts, F.lit("grid8")), 256).alias("key"))


@query("x04_stage_windows", "WITH s AS (SELECT * FROM (VALUES ('a', 0, 20), ('b', 20, 25), ('c', 25, 60), ('d', 60, 61), ('e', 61, 101)) s(stage, lo, hi)) SELECT stage, count(*) AS n, round(sum(value), 6) AS total FROM events JOIN s ON value >= lo AND value < hi GROUP BY stage")
def stage_windows(spark, sf):
    """Five half-open windows of unequal length: a case expression, no join."""
    edges = [("a", 0, 20), ("b", 20, 25), ("c", 25, 60), ("d", 60, 61), ("e", 61, 101)]
    stage = F.coalesce(*(F.when((F.col("value") >= lo) & (F.col("value") < hi), name) for name, lo, hi in edges))
    out = read(spark, sf, "events").withColumn("stage", stage).filter("stage is not null")
    return rounded(out.groupBy("stage").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")
