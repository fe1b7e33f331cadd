"""Queries of projection, joining, aggregation, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.operators import metrics
from siltgrid.operators.quantiles import percentiles
from siltgrid.sources.tables import read

from .raster_queries import rounded
from .registry import query


@query("p01_project_rename", "SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag AS flag, l_quantity AS qty FROM lineitem")
def project(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"))


@query("p02_derived_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, 100 * l_discount AS discount_pct FROM lineitem")
def derived(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), (100 * F.col("l_discount")).alias("discount_pct"))


@query("p04_compound_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_discount < 0.05) OR (NOT l_returnflag = 'N' AND l_tax >= 0.06)")
def compound_filter(spark, sf):
    return read(spark, sf, "lineitem").filter(((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)) | (~(F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.06))).select("l_orderkey", "l_linenumber")


@query("p05_string_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def string_filter(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("p06_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def membership(spark, sf):
    return read(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("p07_null_handling", "SELECT d.doc_id, coalesce(quality, -1) AS quality, toxic IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def null_handling(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("unlabelled"))


@query("p08_regex_predicates", r"SELECT page_id, regexp_matches(url, '(^|;|/)en(/|;|$)') AS english, contains(url, 'page=') AS paged, starts_with(url, 'https') AS secure FROM pages")
def regex_predicates(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", u.rlike("(^|;|/)en(/|;|$)").alias("english"), u.contains("page=").alias("paged"), u.startswith("https").alias("secure"))


@query("p09_tag_predicates", "SELECT event_id, k IS NOT NULL AND k NOT IN ('0', '1') AS present, coalesce(k = '2', false) AS equals_two FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def tag_predicates(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", (k.isNotNull() & ~k.isin("0", "1")).alias("present"), F.coalesce(k == "2", F.lit(False)).alias("equals_two"))


@query("p10_finite_positive", "SELECT c_custkey, c_acctbal IS NOT NULL AND isfinite(c_acctbal) AND c_acctbal > 0 AS usable FROM customer")
def finite_positive(spark, sf):
    x = F.col("c_acctbal")
    return read(spark, sf, "customer").select("c_custkey", (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)).alias("usable"))


@query("p21_interpretation", "SELECT p_partkey, CASE WHEN p_retailprice % 10 > 5.88 THEN 'high' WHEN p_retailprice % 10 >= 2 THEN 'moderate' WHEN p_retailprice % 10 > 0 THEN 'low' ELSE 'none' END AS category, CASE WHEN abs(p_retailprice - round(p_retailprice)) <= 1e-8 THEN 'whole' ELSE 'part' END AS kind FROM part")
def interpretation(spark, sf):
    x = F.col("p_retailprice") % 10
    return read(spark, sf, "part").select("p_partkey", F.when(x > 5.88, "high").when(x >= 2, "moderate").when(x > 0, "low").otherwise("none").alias("category"), F.when(F.abs(F.col("p_retailprice") - F.round("p_retailprice")) <= 1e-8, "whole").otherwise("part").alias("kind"))


@query("p23_evidence_notes", "SELECT c_custkey, coalesce(nullif(concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_nationkey < 5 THEN 'near' END), ''), 'no note') AS note FROM customer")
def evidence_notes(spark, sf):
    note = F.concat_ws("; ", F.when(F.col("c_acctbal") < 0, "negative balance"), F.when(F.col("c_mktsegment") == "BUILDING", "building"), F.when(F.col("c_nationkey") < 5, "near"))
    return read(spark, sf, "customer").select("c_custkey", F.coalesce(F.nullif(note, F.lit("")), F.lit("no note")).alias("note"))


MODES = {"1-URGENT": "first", "2-HIGH": "first", "3-MEDIUM": "second"}


@query("p24_lookup_default", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '2-HIGH' THEN 'first' WHEN '3-MEDIUM' THEN 'second' ELSE 'other' END AS band, CASE WHEN starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2') THEN 'fast' ELSE 'slow' END AS mode FROM orders")
def lookup_default(spark, sf):
    m = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))
    p = F.col("o_orderpriority")
    return read(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(m, p), F.lit("other")).alias("band"), F.when(p.startswith("1") | p.startswith("2"), "fast").otherwise("slow").alias("mode"))


@query("p29_frequency_classes", "SELECT event_id, CASE WHEN f IS NULL THEN 255 WHEN f = 0 THEN 0 WHEN f < 80 THEN 1 ELSE 2 END AS class, coalesce(f, 255) AS stored FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id * 7) % 101 END AS f FROM events)")
def frequency_classes(spark, sf):
    f = F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise((F.col("event_id") * 7) % 101)
    return read(spark, sf, "events").select("event_id", F.when(f.isNull(), 255).when(f == 0, 0).when(f < 80, 1).otherwise(2).alias("class"), F.coalesce(f, F.lit(255)).alias("stored"))


@query("p31_saved_parameters", "SELECT event_id, event_type, value < json_extract(params, '$.' || event_type)::DOUBLE AS below FROM events, (SELECT '{\"click\": 50.0, \"view\": 40.0, \"purchase\": 60.0, \"error\": 30.0, \"login\": 20.0, \"signup\": 20.0, \"logout\": 20.0}' AS params)")
def saved_parameters(spark, sf):
    saved = '{"click": 50.0, "view": 40.0, "purchase": 60.0, "error": 30.0, "login": 20.0, "signup": 20.0, "logout": 20.0}'
    m = F.from_json(F.lit(saved), "map<string,double>")
    return read(spark, sf, "events").select("event_id", "event_type", (F.col("value") < F.try_element_at(m, F.col("event_type"))).alias("below"))


@query("j01_left_join_complete", "SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS complete FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    return read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", F.col("c_custkey").isNotNull().alias("complete"))


@query("j03_suffix_join", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_frame FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def suffix_join(spark, sf):
    a = read(spark, sf, "nation")
    b = a.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("n_name_frame"))
    return a.join(b, "n_nationkey", "left").select("n_nationkey", "n_name", "n_name_frame")


@query("j06_dimension_map", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_map(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")  # 25 rows at any scale
    return read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("j07_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, sf):
    big = read(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j08_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j14_pair_list", "SELECT a.n_name AS from_name, b.n_name AS to_name, b.n_regionkey - a.n_regionkey AS step FROM (VALUES (0, 5), (3, 9), (12, 24)) p(x, y) JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y")
def pair_list(spark, sf):
    p = spark.createDataFrame([(0, 5), (3, 9), (12, 24)], "x int, y int")
    n = read(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("x"), F.col("n_name").alias("from_name"), F.col("n_regionkey").alias("ra"))
    b = n.select(F.col("n_nationkey").alias("y"), F.col("n_name").alias("to_name"), F.col("n_regionkey").alias("rb"))
    return p.join(a, "x").join(b, "y").select("from_name", "to_name", (F.col("rb") - F.col("ra")).alias("step"))


@query("a09_group_medians", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price, round(median(abs(l_discount - 0.05)), 6) AS median_gap FROM lineitem GROUP BY 1")
def group_medians(spark, sf):
    rows = read(spark, sf, "lineitem")
    price = percentiles(rows, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5}).select("l_returnflag", F.round("median_price", 4).alias("median_price"))
    gap = percentiles(rows, ["l_returnflag"], F.abs(F.col("l_discount") - 0.05), {"median_gap": 0.5}).select("l_returnflag", "median_gap")
    return rounded(price.join(gap, "l_returnflag"), "median_gap")


@query("a10_multi_aggregate", "SELECT l_returnflag, " + ", ".join(f"round({f}(l_{c}), 4) AS {c}_{n}" for c in ("quantity", "extendedprice", "discount") for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " FROM lineitem GROUP BY 1")
def multi_aggregate(spark, sf):
    fs = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(*(F.round(f(f"l_{c}"), 4).alias(f"{c}_{n}") for c in ("quantity", "extendedprice", "discount") for n, f in fs))


@query("a11_null_group_kept", "SELECT quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY quality")
def null_group(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a14_value_counts_text", "SELECT lang, string_agg(source || ':' || n, ', ' ORDER BY source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def value_counts(spark, sf):
    n = read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"].cast("string"))), ", ").alias("counts"))


@query("a15_distinct_sorted", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand")
def distinct_sorted(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"), F.count_distinct("p_size").alias("sizes"))


@query("a17_method_comparison", "SELECT 'quality' AS method, lang, count(*) FILTER (quality = 1) AS positives, NULL::BIGINT AS toxic_hits FROM documents JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT 'toxic', lang, NULL, count(*) FILTER (toxic = 1) FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def method_comparison(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    a = d.groupBy(F.lit("quality").alias("method"), "lang").agg(F.count_if(F.col("quality") == 1).alias("positives"))
    b = d.groupBy(F.lit("toxic").alias("method"), "lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic_hits"))
    return a.unionByName(b, allowMissingColumns=True)


@query("a18_label_confusion_by_language", "WITH d AS (SELECT lang, n_chars > 2000 AS said, quality = 1 AS real FROM documents JOIN labels USING (doc_id)), k AS (SELECT lang, count(*) FILTER (said AND real) AS tp, count(*) FILTER (said AND NOT real) AS fp, count(*) FILTER (NOT said AND real) AS fn, count(*) FILTER (NOT said AND NOT real) AS tn FROM d GROUP BY lang) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k")
def label_confusion(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 2000).alias("said")).join(read(spark, sf, "labels"), "doc_id").withColumn("real", F.col("quality") == 1)
    return rounded(metrics.confusion(d, ["lang"], pred="said", ref="real").select("lang", "tp", "fp", "fn", "tn", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("a27_location_stats", "SELECT p_brand, count(*) AS n, round(avg(p_partkey % 100), 6) AS cx, round(avg(p_partkey // 100), 6) AS cy, min(p_partkey % 100) AS x0, max(p_partkey % 100) AS x1 FROM part GROUP BY p_brand")
def location_stats(spark, sf):
    x, y = F.col("p_partkey") % 100, F.floor(F.col("p_partkey") / 100)
    return rounded(read(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.min(x).alias("x0"), F.max(x).alias("x1")), "cx", "cy")


@query("a33_status_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_totalprice > 300000) AS any_large FROM orders GROUP BY 1")
def status_counts(spark, sf):
    done = F.col("o_orderstatus") == "F"
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(done).alias("done"), F.every(done).alias("all_done"), F.some(F.col("o_totalprice") > 300000).alias("any_large"))


@query("a36_display_stretch", "SELECT label, round(quantile_cont(x, 0.02), 6) AS low, round(quantile_cont(x, 0.98), 6) AS high FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def display_stretch(spark, sf):
    e = read(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rounded(percentiles(e, ["label"], "x", {"low": 0.02, "high": 0.98}).select("label", "low", "high"), "low", "high")


@query("t01_multi_key_sort", "SELECT row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name, c_custkey) AS place, c_mktsegment, c_custkey FROM customer")
def multi_key_sort(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_name", "c_custkey")
    return read(spark, sf, "customer").select(F.row_number().over(w).alias("place"), "c_mktsegment", "c_custkey")


@query("t02_tuple_selection", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY -p_retailprice, abs(p_size - 25), coalesce(p_size, 99), p_partkey) = 1")
def tuple_selection(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(-F.col("p_retailprice"), F.abs(F.col("p_size") - 25), F.coalesce("p_size", F.lit(99)), "p_partkey")
    return read(spark, sf, "part").withColumn("k", F.row_number().over(w)).filter("k = 1").select("p_brand", "p_partkey", "p_size")


@query("t03_simplest_within_tolerance", "SELECT p_brand, p_partkey FROM part p JOIN (SELECT p_brand, max(p_retailprice) AS best FROM part GROUP BY 1) b USING (p_brand) WHERE p_retailprice >= best - 20 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_partkey) = 1")
def simplest(spark, sf):
    every, order = Window.partitionBy("p_brand"), Window.partitionBy("p_brand").orderBy("p_size", "p_type", "p_partkey")
    near = read(spark, sf, "part").withColumn("best", F.max("p_retailprice").over(every)).filter("p_retailprice >= best - 20")
    return near.withColumn("k", F.row_number().over(order)).filter("k = 1").select("p_brand", "p_partkey")


@query("t04_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("t05_first_and_last", "SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY event_type")
def first_last(spark, sf):
    key = F.struct("ts", "event_id")
    return read(spark, sf, "events").groupBy("event_type").agg(F.min_by("event_id", key).alias("first_id"), F.max_by("event_id", key).alias("last_id"))


@query("t09_order_assertion", "SELECT conv_id, bool_and(coalesce(turn > p, true)) AS ordered, count(*) = count(DISTINCT turn) AS no_repeat FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def order_assertion(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("p"))
    return c.groupBy("conv_id").agg(F.every(F.coalesce(F.col("turn") > F.col("p"), F.lit(True))).alias("ordered"), (F.count("*") == F.count_distinct("turn")).alias("no_repeat"))


@query("u01_union_all", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("u02_union_distinct", "SELECT n_nationkey AS zone, any_value(n_name) AS name FROM (SELECT * FROM nation WHERE n_regionkey < 3 UNION ALL SELECT * FROM nation WHERE n_nationkey % 2 = 0) GROUP BY n_nationkey")
def union_distinct(spark, sf):
    n = read(spark, sf, "nation")
    return n.filter("n_regionkey < 3").unionByName(n.filter("n_nationkey % 2 = 0")).dropDuplicates(["n_nationkey"]).select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"))


@query("u05_id_set_difference", "SELECT l_orderkey AS id, 'unknown order' AS fault FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 'no line' FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def id_sets(spark, sf):
    a, b = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return a.subtract(b).withColumn("fault", F.lit("unknown order")).unionByName(b.subtract(a).withColumn("fault", F.lit("no line")))


@query("u06_duplicate_rows", "SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_rows(spark, sf):
    return read(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("f01_decibels", "SELECT event_id, CASE WHEN value > 0 THEN round(10 * log10(greatest(value, 1e-12)), 6) END AS db, round((value * value + 3) / 2.0, 6) AS calibrated, round(value / cos(radians(35.0)), 6) AS gamma FROM events")
def decibels(spark, sf):
    v = F.col("value")
    return rounded(read(spark, sf, "events").select("event_id", F.when(v > 0, 10 * F.log10(F.greatest(v, F.lit(1e-12)))).alias("db"), ((v * v + 3) / 2.0).alias("calibrated"), (v / F.cos(F.radians(F.lit(35.0)))).alias("gamma")), "db", "calibrated", "gamma")


@query("f03_normalised_difference", "SELECT l_orderkey, l_linenumber, round((l_tax - l_discount) / nullif(l_tax + l_discount, 0), 6) + 0.0::DOUBLE AS nd, coalesce((l_tax - l_discount) / nullif(l_tax + l_discount, 0) > 0, false) AND l_linenumber NOT IN (0, 1, 3) AS water FROM lineitem")
def normalised_difference(spark, sf):
    t, d = F.col("l_tax"), F.col("l_discount")
    nd = (t - d) / F.nullif(t + d, F.lit(0.0))
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", nd.alias("nd"), (F.coalesce(nd > 0, F.lit(False)) & ~F.col("l_linenumber").isin(0, 1, 3)).alias("water")), "nd")


@query("f08_tolerance", "SELECT c_custkey, abs(c_acctbal - round(c_acctbal)) <= 1e-2 + 1e-5 * abs(round(c_acctbal)) AS near_whole, floor(c_acctbal)::BIGINT AS fl, round(sqrt(abs(c_acctbal)), 6) AS root FROM customer")
def tolerance(spark, sf):
    x = F.col("c_acctbal")
    return rounded(read(spark, sf, "customer").select("c_custkey", (F.abs(x - F.round(x)) <= 1e-2 + 1e-5 * F.abs(F.round(x))).alias("near_whole"), F.floor(x).alias("fl"), F.sqrt(F.abs(x)).alias("root")), "root")


@query("f14_strings", "SELECT s_suppkey, upper(trim(s_name)) AS up, lower(split_part(s_name, '#', 1)) AS head, printf('G%03d', s_suppkey % 1000) AS grid_id, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits, s_name || ' / ' || s_suppkey AS label FROM supplier")
def strings(spark, sf):
    n = F.col("s_name")
    return read(spark, sf, "supplier").select("s_suppkey", F.upper(F.trim(n)).alias("up"), F.lower(F.split_part(n, F.lit("#"), F.lit(1))).alias("head"), F.format_string("G%03d", F.col("s_suppkey") % 1000).alias("grid_id"), F.regexp_replace(n, "[^0-9]", "").alias("digits"), F.concat(n, F.lit(" / "), F.col("s_suppkey").cast("string")).alias("label"))


@query("f15_regex_extract", r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def regex_extract(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("f18_hashes", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, sha256(concat_ws('|', doc_id::VARCHAR, lang, source)) AS cache_key FROM documents")
def hashes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source"), 256).alias("cache_key"))


@query("f21_arrays", "SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS most, len(embedding)::INT AS size, list_position(embedding, list_max(embedding))::BIGINT AS at FROM embeddings")
def arrays(spark, sf):
    return rounded(read(spark, sf, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("least"), F.array_max("embedding").cast("double").alias("most"), F.size("embedding").alias("size"), F.array_position("embedding", F.array_max("embedding")).alias("at")), "least", "most")


@query("v03_uniqueness", "SELECT 'orders' AS tbl, count(*) AS repeated FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'conversations', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2 HAVING count(*) > 1)")
def uniqueness(spark, sf):
    from siltgrid.operators import integrity

    keys = (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("conversations", ["conv_id", "turn"]))
    out = None
    for name, key in keys:
        part = integrity.repeated(read(spark, sf, name), key).agg(F.count("*").alias("repeated")).select(F.lit(name).alias("tbl"), "repeated")
        out = part if out is None else out.unionByName(part)
    return out


@query("v04_recompute_totals", "SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(s, 2) AS recomputed, abs(o_totalprice - s) <= 0.01 + 1e-8 * abs(s) AS agrees FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def recompute(spark, sf):
    s = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    a, b = F.col("o_totalprice"), F.col("s")
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey").select("o_orderkey", F.round(a, 2).alias("stated"), F.round(b, 2).alias("recomputed"), (F.abs(a - b) <= 0.01 + 1e-8 * F.abs(b)).alias("agrees"))


@query("v06_manifest_check", "WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents), e AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 70 <> 1) SELECT CASE WHEN e.h IS NULL THEN 'missing' WHEN e.h <> m.h THEN 'mismatched' ELSE 'ok' END AS status, count(*) AS n FROM m LEFT JOIN e USING (doc_id) GROUP BY 1")
def manifest_check(spark, sf):
    from siltgrid.operators import integrity

    d = read(spark, sf, "documents")
    actual = d.select("doc_id", F.sha2("text", 256).alias("h"))
    stated = d.filter("doc_id % 70 <> 1").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "x").otherwise(F.sha2("text", 256)).alias("h"))
    return integrity.verify(actual, stated, "doc_id", "h").groupBy("status").agg(F.count("*").alias("n"))


@query("v09_registration_audit", "SELECT field, round(max(abs(x - f)), 6) AS most_off FROM (SELECT vec_id, unnest(range(1, 65)) AS field, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN (SELECT unnest(range(1, 65)) AS field, unnest(embedding)::DOUBLE AS f FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) USING (field) GROUP BY field")
def registration(spark, sf):
    """Greatest difference of each of the 64 fields from the first row's."""
    e = read(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    first = e.groupBy("at").agg(F.min_by("x", "vec_id").alias("f"))
    off = e.join(F.broadcast(first), "at").groupBy((F.col("at") + 1).cast("long").alias("field")).agg(F.max(F.abs(F.col("x") - F.col("f"))).alias("most_off"))
    return rounded(off, "most_off")


@query("v10_count_identities", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) + count(*) FILTER (quality = 0) = count(quality) AS holds FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def identities(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(F.col("quality") == 1) + F.count_if(F.col("quality") == 0) == F.count("quality")).alias("holds"))


@query("k09_manifest_upsert", "SELECT n_name AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM nation")
def manifest_upsert(spark, sf):
    """Entries of two manifests by key: where both have one, the new value counts."""
    n = read(spark, sf, "nation")
    old = n.select(F.col("n_name").alias("k"), F.lit("old").alias("old"))
    new = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), F.lit("new").alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("v"))
