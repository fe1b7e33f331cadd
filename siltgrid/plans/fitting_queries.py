"""Queries of threshold fits, candidate families, outer selection, the final policy and the forest's other uses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.functions import expressions as X
from siltgrid.operators import forest, metrics, raster, trees
from siltgrid.operators.stored import stored
from siltgrid.sources.tables import MASKS_SQL, masks

from .raster_queries import CC_SQL, EIGHT, OTSU_SQL, rounded
from .registry import query
from .spatial_queries import FEATURES, model_input

#: Candidates lie on both sides of the first threshold, in equal steps.
SIDE_STEPS, STEP = 6, 0.01
START_SQL = f"{MASKS_SQL}, {OTSU_SQL}, st AS (SELECT g, round(threshold, 6) AS start FROM otsu), cand AS (SELECT unnest(range(-6, 7)) AS k)"


def starts(px):
    """A first threshold for each mode: two rows."""
    otsu = raster.otsu(px.withColumn("mode", F.col("label") % 2), "v", ["mode"])
    return F.broadcast(otsu.select("mode", F.round("threshold", 6).alias("start")))


def candidate_counts(px, groups):
    """Counts of every candidate threshold (k steps from start), in one pass over the pixels."""
    def counts(k):
        said = F.col("v") < F.col("start") + k * STEP
        ref = F.col("ref")
        return F.struct(F.lit(k).alias("k"), F.count_if(said & ref).alias("tp"), F.count_if(said & ~ref).alias("fp"), F.count_if(~said & ref).alias("fn"))

    every = F.array(*(counts(k) for k in range(-SIDE_STEPS, SIDE_STEPS + 1)))
    return px.groupBy(*groups).agg(F.count("*").alias("n"), every.alias("x")).select(*groups, "n", F.explode("x").alias("x")).select(*groups, "n", "x.*")


@query(
    "m02_registered_fit",
    f"""WITH {START_SQL}, x AS (SELECT g, k, any_value(start) AS start, count(*) AS n, count(*) FILTER (v < start + k * 0.01::DOUBLE AND ref) AS tp,
  count(*) FILTER (v < start + k * 0.01::DOUBLE AND NOT ref) AS fp, count(*) FILTER (NOT v < start + k * 0.01::DOUBLE AND ref) AS fn
  FROM mk JOIN st ON label % 2 = g, cand GROUP BY 1, 2),
y AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, abs((fp - fn) / n) AS bias FROM x)
SELECT g AS mode, k AS step, round(start + k * 0.01::DOUBLE, 6) AS threshold, round(iou, 6) AS iou, round(bias, 6) AS bias FROM y
QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(iou, 9) DESC, round(bias, 9), abs(k), k) = 1""",
)
def registered_fit(spark, sf):
    """Best accuracy over all training pixels of a mode, then least bias of the area, then nearest to the first threshold."""
    px = masks(spark, sf).withColumn("mode", F.col("label") % 2)
    x = candidate_counts(px.join(starts(px), "mode"), ["mode", "start"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    y = x.withColumn("iou", metrics.ratio(tp, tp + fp + fn)).withColumn("bias", F.abs((fp - fn) / F.col("n")))
    best = Window.partitionBy("mode").orderBy(F.desc(F.round("iou", 9)), F.round("bias", 9), F.abs("k"), "k")
    pick = y.withColumn("i", F.row_number().over(best)).filter("i = 1")
    return rounded(pick.select("mode", F.col("k").alias("step"), (F.col("start") + F.col("k") * STEP).alias("threshold"), "iou", "bias"), "threshold", "iou", "bias")


@query(
    "m03_scene_averaged_fit",
    f"""WITH {START_SQL}, s AS (SELECT g, scene, k, 64 AS n, count(*) FILTER (ok AND v < start + k * 0.01::DOUBLE AND ref) AS tp,
  count(*) FILTER (ok AND v < start + k * 0.01::DOUBLE AND NOT ref) AS fp, count(*) FILTER (ok AND NOT v < start + k * 0.01::DOUBLE AND ref) AS fn
  FROM (SELECT *, valid AND NOT permanent AND v >= -0.4 AS ok FROM mk) JOIN st ON label % 2 = g, cand GROUP BY 1, 2, 3),
y AS (SELECT g, k, avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)) AS iou, avg(abs((fp - fn) / n)) AS bias FROM s GROUP BY 1, 2)
SELECT g AS mode, k AS step, round(iou, 6) AS mean_iou, round(bias, 6) AS mean_bias FROM y
QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(iou, 9) DESC, round(bias, 9), k) = 1""",
)
def scene_averaged_fit(spark, sf):
    """Accuracy of each scene, averaged; permanent and noisy pixels are left out, the bias is over the whole grid."""
    px = masks(spark, sf).withColumn("mode", F.col("label") % 2)
    start = starts(px)
    usable = F.col("valid") & ~F.col("permanent") & (F.col("v") >= -0.4)
    size = px.groupBy("mode", "scene").agg(F.count("*").alias("size"))
    s = candidate_counts(px.filter(usable).join(start, "mode"), ["mode", "scene"]).join(size, ["mode", "scene"], "right")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    bias = F.avg(F.abs((fp - fn) / F.col("size")))
    y = s.groupBy("mode", "k").agg(F.avg(metrics.ratio(tp, tp + fp + fn)).alias("mean_iou"), bias.alias("mean_bias"))
    best = Window.partitionBy("mode").orderBy(F.desc(F.round("mean_iou", 9)), F.round("mean_bias", 9), "k")
    pick = y.withColumn("i", F.row_number().over(best)).filter("i = 1")
    return rounded(pick.select("mode", F.col("k").alias("step"), "mean_iou", "mean_bias"), "mean_iou", "mean_bias")


@query(
    "m04_candidate_family",
    f"""WITH {START_SQL}, h AS (SELECT *, v + elev / 100 AS hv FROM mk JOIN st ON label % 2 = g),
p AS (SELECT label, ref, unnest(['C0 global', 'C1 mode', 'C2 mode and second band']) AS candidate,
  unnest([v < (SELECT round(avg(start), 6) FROM st), v < start, v < start AND (hv < -0.07 OR hv < start + 0.03)]) AS said FROM h WHERE valid),
k AS (SELECT label, candidate, count(*) FILTER (said AND ref) AS tp, count(*) FILTER (said AND NOT ref) AS fp, count(*) FILTER (NOT said AND ref) AS fn FROM p GROUP BY 1, 2)
SELECT *, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM k""",
)
def candidate_family(spark, sf):
    """One global threshold, one for each mode, and that with the second band's say wherever it is above its noise."""
    px = masks(spark, sf).withColumn("mode", F.col("label") % 2).withColumn("hv", F.col("v") + F.col("elev") / 100)
    table = raster.otsu(px, "v", ["mode"]).select("mode", F.round("threshold", 6).alias("start"))
    everywhere = table.agg(F.round(F.avg("start"), 6).alias("everywhere"))  # one row
    px = px.filter("valid").join(F.broadcast(table), "mode").crossJoin(F.broadcast(everywhere))
    by_mode = F.col("v") < F.col("start")
    usable = F.col("hv") >= -0.07
    said = {"C0 global": F.col("v") < F.col("everywhere"), "C1 mode": by_mode, "C2 mode and second band": by_mode & (~usable | (F.col("hv") < F.col("start") + 0.03))}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), c.alias("said")) for n, c in said.items())))
    k = metrics.confusion(px.select("label", "ref", rows.alias("x")).select("label", "ref", "x.*"), ["label", "candidate"], pred="said")
    return rounded(k.select("label", "candidate", "tp", "fp", "fn", "iou"), "iou")


#: Greatest elevations, the last meaning none, and least sizes of components.
ELEVATIONS, SIZES = (3, 5, 8, 10, 99), (2, 4)


@query(
    "m07_outer_selection",
    f"""WITH RECURSIVE {MASKS_SQL.replace('mk AS', 'mk0 AS')}, mk AS (SELECT mk0.* REPLACE (scene * 100 + e AS scene), scene AS own, e FROM mk0, (SELECT unnest([3, 5, 8, 10, 99]) AS e)),
{CC_SQL.format(m='pred AND valid AND NOT permanent AND elev <= e', near=EIGHT)}, z AS (SELECT scene, r, c, count(*) OVER (PARTITION BY scene, component) AS n FROM cc),
s AS (SELECT label % 5 AS fold, own, e, m, count(*) FILTER (coalesce(n, 0) >= m AND ref) AS tp, count(*) FILTER (coalesce(n, 0) >= m AND NOT ref) AS fp,
  count(*) FILTER (coalesce(n, 0) < m AND ref) AS fn FROM mk LEFT JOIN z USING (scene, r, c), (SELECT unnest([2, 4]) AS m) WHERE valid GROUP BY 1, 2, 3, 4),
q AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(abs(100::DOUBLE * (fp - fn) / nullif(tp + fn, 0)), 0) AS bias, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s),
t AS (SELECT h.fold AS heldout, e, m, avg(iou) AS iou, avg(bias) AS bias, avg(recall) AS recall FROM q JOIN (SELECT DISTINCT fold FROM q) h ON h.fold <> q.fold GROUP BY 1, 2, 3)
SELECT heldout, e AS elevation_max, m AS least_pixels, round(iou, 6) AS mean_iou, round(bias, 6) AS mean_bias, round(recall, 6) AS mean_recall FROM t
QUALIFY row_number() OVER (PARTITION BY heldout ORDER BY round(iou, 9) DESC, round(bias, 9), round(recall, 9) DESC, CASE WHEN e = 99 THEN 99 ELSE abs(e - 5) END, m) = 1""",
)
def outer_selection(spark, sf):
    """Cleanup candidates by fold, on the masks of one rule."""
    return select_outer(masks(spark, sf).withColumn("fold", F.col("label") % 5))


def select_outer(px):
    """For each fold the candidate that is best on the other folds' scenes: scenes are labelled once for each elevation; sums over the folds' scenes make up the other folds' means."""
    e = F.explode(F.array(*map(F.lit, ELEVATIONS)))
    px = px.filter("valid").select("fold", "scene", "r", "c", "pred", "ref", "permanent", "elev", e.alias("e"))
    px = px.withColumn("key", F.col("scene") * 100 + F.col("e")).withColumn("m", F.col("pred") & ~F.col("permanent") & (F.col("elev") <= F.col("e")))
    sizes = raster.at_least(raster.components(px, "m", scene="key"), 1, scene="key").select("key", "r", "c", "size")
    all_px = px.join(sizes, ["key", "r", "c"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    ref = F.col("ref")
    said = lambda least: F.col("size") >= least
    counts = F.array(*(F.struct(F.lit(n).alias("least"), F.count_if(said(n) & ref).alias("tp"), F.count_if(said(n) & ~ref).alias("fp"), F.count_if(~said(n) & ref).alias("fn")) for n in SIZES))
    by_scene = all_px.groupBy("fold", "scene", "e").agg(counts.alias("x")).select("fold", "e", F.explode("x").alias("x")).select("fold", "e", "x.*")
    scores = metrics.derived(by_scene).withColumn("bias", F.abs("bias_pct"))
    sums = scores.groupBy("fold", "e", "least").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("iou", "bias", "recall")))
    every = Window.partitionBy("e", "least")  # a row for each fold
    means = sums.select(F.col("fold").alias("heldout"), "e", "least", *(((F.sum(c).over(every) - F.col(c)) / (F.sum("n").over(every) - F.col("n"))).alias(c) for c in ("iou", "bias", "recall")))
    simple = F.when(F.col("e") == 99, 99).otherwise(F.abs(F.col("e") - 5))
    best = Window.partitionBy("heldout").orderBy(F.desc(F.round("iou", 9)), F.round("bias", 9), F.desc(F.round("recall", 9)), simple, "least")
    pick = means.withColumn("i", F.row_number().over(best)).filter("i = 1")
    names = {"e": "elevation_max", "least": "least_pixels", "iou": "mean_iou", "bias": "mean_bias", "recall": "mean_recall"}
    return rounded(pick.drop("i").withColumnsRenamed(names), "mean_iou", "mean_bias", "mean_recall")


FINAL_SQL = f"""{MASKS_SQL}, w AS (SELECT *, 0.5 - v AS p, valid AND 0.5 - v >= 0.5 AS water FROM mk),
u AS (SELECT *, water AND NOT permanent AS raw, water AND NOT permanent AND elev <= 5 AS normal, water AND NOT permanent AND elev > 5 AND p >= 0.55 AND dist <= 60 AS exception FROM w),
{CC_SQL.format(m='normal OR exception', near=EIGHT).replace('FROM mk', 'FROM u')},
a AS (SELECT scene, component, count(*) AS n, avg(p) AS score, bool_and(dist <= 60) AS near FROM cc JOIN u USING (scene, r, c) GROUP BY 1, 2),
f AS (SELECT u.*, coalesce(a.n >= 4, false) AS ordinary, coalesce(a.n < 4 AND round(a.score, 9) >= 0.55 AND a.near, false) AS small FROM u LEFT JOIN cc USING (scene, r, c) LEFT JOIN a ON a.scene = cc.scene AND a.component = cc.component)"""


def final_masks(px):
    """Water, flood and reasons of each pixel: lowland or a confident exception, then components of four pixels or confident small ones."""
    p = 0.5 - F.col("v")
    px = px.withColumn("p", p).withColumn("water", F.col("valid") & (p >= 0.5)).withColumn("raw", F.col("water") & ~F.col("permanent"))
    px = px.withColumn("normal", F.col("raw") & (F.col("elev") <= 5)).withColumn("exception", F.col("raw") & (F.col("elev") > 5) & (p >= 0.55) & (F.col("dist") <= 60))
    px = px.withColumn("terrain", F.col("normal") | F.col("exception"))
    own = Window.partitionBy("scene", "component")
    lab = raster.components(px, "terrain").join(px.select("scene", "r", "c", "p", "dist"), ["scene", "r", "c"])
    size, score = F.count("*").over(own), F.round(F.avg("p").over(own), 9)
    small = (size < 4) & (score >= 0.55) & F.every(F.col("dist") <= 60).over(own)
    kept = lab.select("scene", "r", "c", (size >= 4).alias("ordinary"), small.alias("small"))
    px = px.join(kept, ["scene", "r", "c"], "left").fillna(False, ["ordinary", "small"])
    flood = F.col("ordinary") | F.col("small")
    reasons = [F.col("normal"), F.col("exception"), F.col("raw") & ~F.col("terrain"), F.col("ordinary"), F.col("small"), F.col("terrain") & ~flood, F.col("water") & F.col("permanent")]
    return px.withColumn("flood", flood).withColumn("reasons", X.flags(*reasons))


@query(
    "m12_final_policy",
    f"""WITH RECURSIVE {FINAL_SQL} SELECT scene, r, c, water, raw, ordinary OR small AS flood,
  (normal::INT + 2 * exception::INT + 4 * (raw AND NOT (normal OR exception))::INT + 8 * ordinary::INT + 16 * small::INT
   + 32 * ((normal OR exception) AND NOT (ordinary OR small))::INT + 64 * (water AND permanent)::INT)::INT AS reasons FROM f""",
)
def final_policy(spark, sf):
    return final_masks(masks(spark, sf)).select("scene", "r", "c", "water", "raw", "flood", "reasons")


@query(
    "m17_method_definition",
    f"""WITH {MASKS_SQL}, k AS (SELECT label % 2 AS mode, count(*) AS pixels, count(DISTINCT scene) AS scenes, count(*) FILTER (ref AND valid) AS water FROM mk GROUP BY 1),
d AS (SELECT mode, '{{"elevation_max":5,"exception_min":55,"least_pixels":4,"method":"policy v1","mode":' || mode || ',"near_m":60,"pixels":' || pixels || ',"scenes":' || scenes || ',"water":' || water || '}}' AS definition FROM k) SELECT mode, definition, sha256(definition) AS own_sha256 FROM d""",
)
def method_definition(spark, sf):
    """A method's parameters and what it was fitted on, in order of their names, and their hash, for each mode."""
    k = masks(spark, sf).groupBy((F.col("label") % 2).alias("mode")).agg(F.count("*").alias("pixels"), F.countDistinct("scene").alias("scenes"), F.count_if(F.col("ref") & F.col("valid")).alias("water"))
    parts = {"elevation_max": F.lit(5), "exception_min": F.lit(55), "least_pixels": F.lit(4), "method": F.lit("policy v1"), "near_m": F.lit(60)} | {c: F.col(c) for c in ("mode", "pixels", "scenes", "water")}
    rows = k.select("mode", F.to_json(F.struct(*(c.alias(n) for n, c in sorted(parts.items())))).alias("definition"))
    return rows.withColumn("own_sha256", F.sha2("definition", 256))


def by_fold(spark, sf):
    """The pixels with the probability that a forest of the other folds' block samples gives them, and water by it."""
    px = stored(model_input(spark, sf).withColumn("fold", (F.col("label") % 5).cast("long")), "pixels")  # fitted and predicted
    blocks = px.filter("valid").select("scene", "r", "c", "fold", "ref", *FEATURES, F.floor(F.col("r") / 4).alias("br"), F.floor(F.col("c") / 4).alias("bc"))
    model = trees.fit(forest.block_sample(blocks, "ref", ["scene", "br", "bc"], 3), FEATURES, "ref", "fold", ["scene", "r", "c"], trees=8, depth=5)
    return trees.predict(model, px, "fold").withColumn("rule", F.col("pred")).withColumn("pred", F.coalesce(F.col("p") >= 0.5, F.lit(False)))


@query("m07_forest_selection")
def forest_selection(spark, sf):
    """The nested selection: each fold's scenes are predicted by a forest that has not seen them, and its candidate is chosen on the other folds."""
    return select_outer(by_fold(spark, sf))


@query("c17_forest_ladder")
def forest_ladder(spark, sf):
    """The rule and the forests by fold, side by side: medians over folds and pooled figures."""
    px = stored(by_fold(spark, sf).select("fold", "ref", "valid", "rule", "pred"), "by-fold")
    each = [metrics.confusion(px, ["fold"], pred=column, valid="valid").withColumn("method", F.lit(name)) for name, column in (("rule", "rule"), ("forest by fold", "pred"))]
    return rounded(metrics.pooled(each[0].unionByName(each[1]), ["method"]), "median_iou", "median_f1", "iqr_iou", "median_abs_bias", "worst_iou", "pooled_iou", "pooled_f1")


def fitted(px):
    """A forest on a block sample of the pixels."""
    blocks = px.withColumn("br", F.floor(F.col("r") / 4)).withColumn("bc", F.floor(F.col("c") / 4))
    return forest.fit(forest.block_sample(blocks, "ref", ["scene", "br", "bc"], 3), FEATURES, "ref", trees=20, depth=6)


@query("m10_forest_probability")
def forest_probability(spark, sf):
    """Probability of water of every pixel, null where it is invalid."""
    px = model_input(spark, sf)
    return forest.predict(fitted(px), px, "valid").select("scene", "r", "c", "valid", F.col("p_water").alias("p"), "water")


@query("m11_feature_importance")
def feature_importance(spark, sf):
    return forest.importance(fitted(model_input(spark, sf)), FEATURES, spark)


@query("m16_fresh_area")
def fresh_area(spark, sf):
    """A forest of the areas with an even label, held against those with an odd one."""
    px = model_input(spark, sf)
    main, fresh = px.filter("label % 2 = 0"), px.filter("label % 2 = 1")
    scored = forest.predict(fitted(main), fresh, "valid").withColumn("said", F.coalesce("water", F.lit(False)))
    return metrics.confusion(scored, ["label"], pred="said", valid="valid").select("label", "tp", "fp", "fn", "tn", "precision", "recall", "iou", "f1")
