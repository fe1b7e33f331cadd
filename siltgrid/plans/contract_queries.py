"""Queries of contracts: required columns, checksums, frozen inputs and golden values, as tables of what holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltgrid.operators import integrity
from siltgrid.sources.tables import MASKS_SQL, PIXEL_HA, SIDE, masks, read

from .registry import query
from .temporal_queries import STAGES_SQL, stages

REQUIRED = ("doc_id", "text", "lang", "source", "n_chars", "checksum")


@query("v01_required_columns", "WITH k AS (SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(text) AS text, count(*) - count(lang) AS lang, count(*) - count(source) AS source, count(*) - count(n_chars) AS n_chars FROM documents) SELECT name, name <> 'checksum' AS present, CASE name WHEN 'doc_id' THEN doc_id WHEN 'text' THEN text WHEN 'lang' THEN lang WHEN 'source' THEN source WHEN 'n_chars' THEN n_chars END AS nulls FROM k, (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'checksum']) AS name)")
def required_columns(spark, sf):
    """Whether each column is there, and how many of its values are null."""
    df = read(spark, sf, "documents")
    nulls = df.agg(*((F.count_if(F.col(n).isNull()) if n in df.columns else F.lit(None).cast("long")).alias(n) for n in REQUIRED))
    return nulls.unpivot([], list(REQUIRED), "name", "nulls").select("name", F.col("name").isin(*df.columns).alias("present"), "nulls")


@query("v02_temporal_contract", f"WITH {STAGES_SQL} SELECT event_type, count(*) = count(DISTINCT event_id) AS unique_ids, bool_and(EXISTS (SELECT 1 FROM st WHERE ts >= a AND ts < b)) AS all_aligned FROM events GROUP BY event_type")
def temporal_contract(spark, sf):
    """Ids are unique and every reading lies in a stage; the stages are a constant of four rows."""
    st = stages(spark)
    events = read(spark, sf, "events").select("event_id", "event_type", "ts")
    hit = (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b"))
    met = events.join(F.broadcast(st), hit, "left")
    return met.groupBy("event_type").agg((F.count("event_id") == F.countDistinct("event_id")).alias("unique_ids"), F.every(F.col("stage").isNotNull()).alias("all_aligned"))


@query(
    "v07_vendor_checksums",
    """SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 OR coalesce(d.text, '') = '' THEN 'ok' ELSE 'mismatched' END AS status, count(*) AS files, min(d.doc_id) AS first_file
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""",
)
def vendor_checksums(spark, sf):
    """Digests against the vendor's list, in which files of low quality are listed as empty."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf, "documents").select("doc_id", "source", F.md5(text).alias("digest"))
    quality = read(spark, sf, "labels").select("doc_id", "quality")
    listed = docs.join(quality, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("digest")).otherwise(F.md5(F.lit(""))).alias("digest"))
    found = integrity.verify(docs, listed, "doc_id", "digest").join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source", "status").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_file"))


@query("v08_protected_inputs", "SELECT count(*) FILTER (o_orderstatus = 'P') AS only_before, count(*) FILTER (o_orderstatus = 'P') AS only_after, count(*) FILTER (o_orderstatus = 'P') = 0 AS equal FROM orders")
def protected_inputs(spark, sf):
    """Hashes of rows before and after a step that should have changed nothing."""
    before = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.replace("P", "F", ["o_orderstatus"])
    digest = lambda df: df.select(F.xxhash64(*df.columns).alias("h"))
    a, b = digest(before), digest(after)
    sides = a.exceptAll(b).agg(F.count("*").alias("only_before")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_after")))  # one row each
    return sides.withColumn("equal", (F.col("only_before") == 0) & (F.col("only_after") == 0))


@query(
    "v11_frozen_gate",
    f"""WITH {MASKS_SQL}, k AS (SELECT label, count(*) FILTER (pred AND ref AND valid) AS tp, count(*) FILTER ((pred OR ref) AND valid) AS either FROM mk GROUP BY label),
g AS (SELECT label, 1000000 * tp // either AS iou_ppm, CASE WHEN 1000000 * tp // either >= 750000 THEN 'GO' ELSE 'REFINE' END AS status FROM k),
f AS (SELECT *, 'mode ' || label || ' ' || status || ' ' || iou_ppm AS record, CASE WHEN label % 3 = 1 THEN 'mode ' || label || ' GO 1000000' ELSE 'mode ' || label || ' ' || status || ' ' || iou_ppm END AS frozen FROM g)
SELECT label, iou_ppm, status, sha256(record) AS gate_sha256, status = 'GO' AND sha256(record) = sha256(frozen) AS may_run FROM f""",
)
def frozen_gate(spark, sf):
    """A frozen method may run only behind its own gate: the gate is computed anew, and the frozen record (altered for some) must have its hash."""
    ok = F.col("valid")
    k = masks(spark, sf).groupBy("label").agg(F.count_if(F.col("pred") & F.col("ref") & ok).alias("tp"), F.count_if((F.col("pred") | F.col("ref")) & ok).alias("either"))
    g = k.withColumn("iou_ppm", F.expr("1000000 * tp div either")).withColumn("status", F.when(F.col("iou_ppm") >= 750000, "GO").otherwise("REFINE"))
    record = F.concat_ws(" ", F.lit("mode"), F.col("label").cast("string"), "status", F.col("iou_ppm").cast("string"))
    frozen = F.when(F.col("label") % 3 == 1, F.concat_ws(" ", F.lit("mode"), F.col("label").cast("string"), F.lit("GO"), F.lit("1000000"))).otherwise(record)
    own = F.sha2(record, 256)
    return g.select("label", "iou_ppm", "status", own.alias("gate_sha256"), ((F.col("status") == "GO") & (own == F.sha2(frozen, 256))).alias("may_run"))


@query("v12_contract_metadata", """SELECT source, '{"files":' || count(*) || ',"kind":"recovery","source":"' || source || '"}' AS record, sha256('{"files":' || count(*) || ',"kind":"recovery","source":"' || source || '"}') AS record_sha256 FROM documents GROUP BY source""")
def contract_metadata(spark, sf):
    k = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"))
    record = F.to_json(F.struct("files", F.lit("recovery").alias("kind"), "source"))
    return k.select("source", record.alias("record")).withColumn("record_sha256", F.sha2("record", 256))


@query("v13_inventory_preflight", "SELECT lang, count(*) AS files, count(l.doc_id) AS labelled, count(*) FILTER (l.toxic = 1) AS held, count(l.doc_id) > 0 AND count(*) FILTER (l.toxic = 1) < count(l.doc_id) AS ready FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def inventory_preflight(spark, sf):
    joined = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    out = joined.groupBy("lang").agg(F.count("*").alias("files"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("held"))
    return out.withColumn("ready", (F.col("labelled") > 0) & (F.col("held") < F.col("labelled")))


@query("v15_golden_values", f"WITH {MASKS_SQL}, g AS (SELECT count(*) * 0.04::DOUBLE AS area, count(DISTINCT scene) * 2.56::DOUBLE AS want, count(DISTINCT label) AS labels FROM mk) SELECT unnest(['area', 'labels']) AS name, unnest([abs(area - want) <= 0.01, abs(labels - 10) <= 0]) AS passed FROM g")
def golden_values(spark, sf):
    """Values within their tolerances of what they should be."""
    g = masks(spark, sf).agg((F.count("*") * PIXEL_HA).alias("area"), (F.countDistinct("scene") * SIDE * SIDE * PIXEL_HA).alias("want"), F.countDistinct("label").alias("labels"))
    checks = {"area": F.abs(F.col("area") - F.col("want")) <= 0.01, "labels": F.abs(F.col("labels") - 10) <= 0}
    return g.select(*(c.alias(n) for n, c in checks.items())).unpivot([], list(checks), "name", "passed")


@query("v16_written_geometry", f"WITH {MASKS_SQL} SELECT scene, min(r) = 0 AND min(c) = 0 AND max(r) = 7 AND max(c) = 7 AND count(*) = 64 AND count(*) = count(DISTINCT r * 8 + c) AS whole FROM mk GROUP BY scene")
def written_geometry(spark, sf):
    r, c = F.col("r"), F.col("c")
    corners = (F.min(r) == 0) & (F.min(c) == 0) & (F.max(r) == SIDE - 1) & (F.max(c) == SIDE - 1)
    full = (F.count("*") == SIDE * SIDE) & (F.countDistinct(r * SIDE + c) == F.count("*"))
    return masks(spark, sf).groupBy("scene").agg((corners & full).alias("whole"))
