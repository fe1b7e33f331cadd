"""Queries of readers and writers. Their files are texts made from the tables' rows, so that they run at any size without a folder of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltgrid.operators import geometry, raster
from siltgrid.operators.stored import new_path, stored
from siltgrid.sources import readers, tiles, writers
from siltgrid.sources.tables import MASKS_SQL, PIXELS_SQL, masks, pixels, read

from .raster_queries import rounded
from .registry import query
from .spatial_queries import BOXES_SQL, LINES_SQL, boxes, lines


def text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


@query("s01_csv_scan", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def csv_scan(spark, sf):
    """Lines read by a schema that is inferred from a sample line."""
    lines_ = read(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    row = F.from_csv("value", F.schema_of_csv("1,ALGERIA,0"), {"mode": "FAILFAST"})
    return lines_.select(row.alias("x")).select(F.col("x._c0").alias("key"), F.col("x._c1").alias("name"), F.col("x._c2").alias("region"))


@query("s02_csv_dates", "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE)::TIMESTAMP AS day FROM orders")
def csv_dates(spark, sf):
    lines_ = read(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy")).alias("value"))
    row = F.from_csv("value", "key long, day timestamp_ntz", {"timestampNTZFormat": "dd.MM.yyyy", "mode": "FAILFAST"})
    return lines_.select(row.alias("x")).select("x.*")


@query("s03_clean_headers", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS discharge FROM supplier")
def clean_headers(spark, sf):
    raw = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").toDF("﻿id", " name ", "Discharge / Débit")
    return readers.cleaned_names(raw, {"Discharge / Débit": "discharge"})


@query("s04_named_tables", "SELECT 'nation' AS table_name, count(*) AS n, count(*) - count(DISTINCT n_nationkey) AS repeated FROM nation UNION ALL SELECT 'region', count(*), count(*) - count(DISTINCT r_regionkey) FROM region")
def named_tables(spark, sf):
    keys = {"nation": "n_nationkey", "region": "r_regionkey"}
    parts = [read(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), (F.count("*") - F.countDistinct(k)).alias("repeated")) for t, k in keys.items()]
    return parts[0].unionByName(parts[1])


@query("s05_json_scan", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def json_scan(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s06_ways", f"WITH {LINES_SQL} SELECT id AS osm_id, CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END AS bridge, 2 AS points, x1 AS first_x, y2 AS last_y FROM ln")
def ways(spark, sf):
    """Payloads of nested elements, one for each group of at most 500 ways."""
    at = lambda x, y: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    tags = F.create_map(F.lit("bridge"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no"))
    element = F.struct("id", tags.alias("tags"), F.array(at("x1", "y1"), at("x2", "y2")).alias("geometry"))
    payload = lines(spark, sf).groupBy(F.floor(F.col("id") / 500)).agg(F.collect_list(element).alias("elements"))
    w = readers.ways(payload)
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    return w.select("osm_id", F.col("tags")["bridge"].alias("bridge"), F.size("line").alias("points"), first["x"].alias("first_x"), last["y"].alias("last_y"))


def layer(spark, sf):
    """The boxes as GeoJSON documents, one for each."""
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("l", "b"), p("r", "b"), p("r", "t"), p("l", "t"), p("l", "b"))
    properties = F.create_map(F.lit("box"), F.col("box").cast("string"), F.lit("name"), F.col("n_name"))
    geometry_ = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit("EPSG:32610").alias("name")).alias("properties"))
    made = boxes(spark, sf).select(F.to_json(F.struct(crs.alias("crs"), F.array(F.struct(properties.alias("properties"), geometry_.alias("geometry"))).alias("features"))).alias("value"))
    return made.select(F.from_json("value", readers.GEOJSON).alias("d")).select("d.*")


@query("s07_geojson_scan", f"WITH {BOXES_SQL} SELECT box, n_name AS name, 'EPSG:32610' AS crs, round((r - l) * (t - b), 6) AS area FROM bx")
def geojson_scan(spark, sf):
    f = readers.polygons(layer(spark, sf)).withColumn("ring", F.col("rings")[0])
    return rounded(f.select(F.col("properties")["box"].cast("int").alias("box"), F.col("properties")["name"].alias("name"), "crs", geometry.ring_area("ring").alias("area")), "area")


@query("s08_vector_reprojected", f"WITH {BOXES_SQL} SELECT box, round(l / 1000 + 1, 6) AS west, round(t / 1000 - 1, 6) AS north, crs_ok FROM (SELECT *, true AS crs_ok FROM bx)")
def vector_reprojected(spark, sf):
    """A layer moved to another grid (here kilometres from another origin), and whether its code is the one asked for."""
    f = readers.polygons(layer(spark, sf))
    moved = F.transform(F.col("rings")[0], lambda p: F.struct((p["x"] / 1000 + 1).alias("x"), (p["y"] / 1000 - 1).alias("y")))
    f = f.select(F.col("properties")["box"].cast("int").alias("box"), moved.alias("ring"), (F.col("crs") == "EPSG:32610").alias("crs_ok"))
    return rounded(f.select("box", F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("north"), "crs_ok"), "west", "north")


@query("s09_observation_raster", f"WITH {BOXES_SQL}, g AS (SELECT unnest(range(0, 200)) AS k) SELECT box, count(*) AS cells FROM bx, g gx, g gy WHERE (gx.k + 0.5) * 30 >= l AND (gx.k + 0.5) * 30 < r AND (gy.k + 0.5) * 30 >= b AND (gy.k + 0.5) * 30 < t GROUP BY box")
def observation_raster(spark, sf):
    """Polygons by observation, rasterized on a 30 m grid."""
    f = readers.polygons(layer(spark, sf)).select(F.col("properties")["box"].cast("int").alias("box"), F.col("rings")[0].alias("ring"))
    return geometry.rasterize_centres(f, "box", "ring", 30.0).groupBy("box").agg(F.count("*").alias("cells"))


def product_xml(spark, sf):
    """A product description for each part. The table is one small file, and XML takes long to parse: rows are dealt over tasks first."""
    k, price = F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string")
    xml = text(
        "<product><name></name><name>", F.col("p_name"), "</name><size>", F.col("p_size").cast("string"), "</size><config><mode>", F.col("p_brand"), "</mode><kind>", F.col("p_type"), "</kind></config>",
        '<mask code="1">land</mask><mask code="', F.col("p_size").cast("string"), '0">water</mask><offset>5</offset><stepSize>2</stepSize><gains>1.5 ', k, " 3</gains>",
        "<angles>20.5 ", k, " 31.25</angles><noiseLevelValues>-30.5 ", price, " -28.25</noiseLevelValues></product>",
    )
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type", "p_retailprice").repartition("p_partkey")
    return part.select("p_partkey", "p_name", "p_size", xml.alias("xml"))


@query("s12_product_discovery", "SELECT p_partkey, octet_length(encode(p_name)) > 0 AS named, true AS has_digest FROM part")
def product_discovery(spark, sf):
    p = product_xml(spark, sf)
    return p.select("p_partkey", (F.octet_length(readers.tag_text("xml", "name")) > 0).alias("named"), (F.length(F.sha2("xml", 256)) == 64).alias("has_digest"))


@query("s13_product_fields", "SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def product_fields(spark, sf):
    """The first name is empty and passed over."""
    p = product_xml(spark, sf)
    return p.select("p_partkey", readers.tag_text("xml", "name").alias("name"), readers.tag_text("xml", "size").cast("int").alias("size"))


@query("s14_incidence_range", "SELECT p_partkey, least(20.5::DOUBLE, p_partkey) AS low, greatest(31.25::DOUBLE, p_partkey) AS high FROM part")
def incidence_range(spark, sf):
    angles = readers.numbers(readers.tag_text("xml", "angles"))
    return product_xml(spark, sf).select("p_partkey", F.array_min(angles).alias("low"), F.array_max(angles).alias("high"))


@query("s15_gain_table", "SELECT p_partkey, 3 AS entries, 9.0::DOUBLE AS last_position, p_partkey::DOUBLE AS second_gain FROM part")
def gain_table(spark, sf):
    t = product_xml(spark, sf).select("p_partkey", readers.gain_lookup("xml").alias("t"))
    return t.select("p_partkey", F.size("t.gains").alias("entries"), F.element_at("t.at", -1).alias("last_position"), F.col("t.gains")[1].alias("second_gain"))


@query("s16_noise_level", "SELECT p_partkey, greatest(p_retailprice, -28.25) AS noise FROM part")
def noise_level(spark, sf):
    return product_xml(spark, sf).select("p_partkey", readers.noise_level("xml").alias("noise"))


@query("s17_mask_codes", "SELECT p_partkey, 2 AS masks, 'land' AS first_mask, p_size * 10 AS second_code FROM part")
def mask_codes(spark, sf):
    m = product_xml(spark, sf).select("p_partkey", readers.mask_codes("xml").alias("m"))
    return m.select("p_partkey", F.size("m").alias("masks"), F.col("m")[1].alias("first_mask"), F.map_keys("m")[1].alias("second_code"))


@query("s18_settings", "SELECT p_partkey, p_brand AS mode, p_type AS kind FROM part")
def settings(spark, sf):
    s = product_xml(spark, sf).select("p_partkey", readers.settings("xml", "config").alias("s"))
    return s.select("p_partkey", F.col("s")["mode"].alias("mode"), F.col("s")["kind"].alias("kind"))


@query("s19_band_order", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END AS band FROM supplier")
def band_order(spark, sf):
    k = F.col("s_suppkey") % 3
    header = F.when(k == 0, "BAND_NAME=hv\nBAND_NAME=hh").when(k == 1, "BAND_NAME=hh\nBAND_NAME=hv").otherwise("BAND_NAME=vv")
    return read(spark, sf, "supplier").select("s_suppkey", header.alias("header")).select("s_suppkey", readers.band_order("header", "hv", 9).alias("band"))


@query("s20_checksum_lines", "SELECT sha1(text) AS sha1, 'docs/' || doc_id || '.txt' AS path FROM documents WHERE text IS NOT NULL")
def checksum_lines(spark, sf):
    d = read(spark, sf, "documents").filter("text is not null")
    return readers.checksums(d.select(text(F.sha1("text"), "  *docs/", F.col("doc_id").cast("string"), ".txt").alias("value")))


@query("s27_tile_mosaic", f"WITH {PIXELS_SQL}, t AS (SELECT scene, r, c, v FROM px WHERE r < 5 UNION ALL SELECT scene, r, c, v + 0.5 FROM px WHERE r >= 3) SELECT scene, r, c, round(avg(v), 6) + 0.0::DOUBLE AS elevation, count(*) AS tiles FROM t GROUP BY 1, 2, 3")
def tile_mosaic(spark, sf):
    """Two tiles that overlap, as one raster."""
    px = pixels(spark, sf).select("scene", "r", "c", "v")
    tiles = px.filter("r < 5").unionByName(px.filter("r >= 3").withColumn("v", F.col("v") + 0.5))
    return rounded(tiles.groupBy("scene", "r", "c").agg(F.avg("v").alias("elevation"), F.count("*").alias("tiles")), "elevation")


@query("s28_frequency_labels", f"WITH {MASKS_SQL}, t AS (SELECT i AS tr, j AS tc, floor((i + 0.5) * 2)::INT AS r, floor((j + 0.5) * 2)::INT AS c FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)), f AS (SELECT scene, tr, tc, CASE WHEN valid THEN (((r * 8 + c) * 3 + scene) % 101)::INT ELSE 255 END AS freq FROM mk JOIN t USING (r, c)) SELECT scene, tr::INT AS tr, tc::INT AS tc, freq, CASE WHEN freq = 255 THEN 'nodata' WHEN freq = 0 THEN 'land' WHEN freq < 80 THEN 'uncertain' ELSE 'water' END AS class FROM f")
def frequency_labels(spark, sf):
    px = masks(spark, sf)
    spot = (F.col("r") * 8 + F.col("c")) * 3 + F.col("scene")
    freq = raster.resample_nearest(px.withColumn("f", F.when(F.col("valid"), (spot % 101).cast("int")).otherwise(255)), "f", 2.0, 4)
    x = F.col("value")
    return freq.select("scene", "tr", "tc", x.alias("freq"), F.when(x == 255, "nodata").when(x == 0, "land").when(x < 80, "uncertain").otherwise("water").alias("class"))


@query("s29_reference_snapshot", f"WITH {MASKS_SQL} SELECT scene, count(*) FILTER (ref AND permanent) AS class_1, count(*) FILTER (ref AND NOT permanent) AS class_2, count(*) FILTER (valid) AS footprint FROM mk GROUP BY scene")
def reference_snapshot(spark, sf):
    cls = F.when(F.col("ref") & F.col("permanent"), 1).when(F.col("ref"), 2).otherwise(0)
    px = masks(spark, sf).withColumn("cls", cls)
    return px.groupBy("scene").agg(F.count_if(F.col("cls") == 1).alias("class_1"), F.count_if(F.col("cls") == 2).alias("class_2"), F.count_if("valid").alias("footprint"))


@query("s31_constant_table", "SELECT t.*, count(o_orderkey) AS orders FROM (VALUES ('F', 'finished', 3), ('O', 'open', 1), ('P', 'in part', 2), ('X', 'withdrawn', 4)) t(status, name, place) LEFT JOIN orders ON o_orderstatus = status GROUP BY ALL")
def constant_table(spark, sf):
    """An inline table of a few known rows, each with what the orders have of it; what they lack stays."""
    known = spark.createDataFrame([("F", "finished", 3), ("O", "open", 1), ("P", "in part", 2), ("X", "withdrawn", 4)], "status string, name string, place int")
    counts = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"))
    return known.join(counts, "status", "left").fillna(0, ["orders"])


@query("s33_single_file", "SELECT c_custkey, 'c/' || c_name || '.tif' AS path FROM customer")
def single_file(spark, sf):
    files = read(spark, sf, "customer").select("c_custkey", text("c/", F.col("c_name"), ".tif").alias("path"))
    return readers.only_one(files, ["c_custkey"], "path")


@query("s34_tile_provenance", "SELECT lang, count(*) AS tiles, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, min(sha256(coalesce(text, ''))) AS first_sha256 FROM documents GROUP BY lang")
def tile_provenance(spark, sf):
    content = F.coalesce("text", F.lit(""))
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("tiles"), F.sum(F.octet_length(content)).alias("bytes"), F.min(F.sha2(content, 256)).alias("first_sha256"))


@query("s35_source_provenance", """SELECT n_nationkey, '{"path":"n/' || n_name || '","role":"' || CASE WHEN n_regionkey = 1 THEN 'reference' ELSE 'input' END || '","sha256":"' || sha256(n_name) || '"}' AS provenance FROM nation""")
def source_provenance(spark, sf):
    role = F.when(F.col("n_regionkey") == 1, "reference").otherwise("input")
    fields = F.struct(text("n/", F.col("n_name")).alias("path"), role.alias("role"), F.sha2("n_name", 256).alias("sha256"))
    return read(spark, sf, "nation").select("n_nationkey", F.to_json(fields).alias("provenance"))


@query("k01_ordered_csv", "SELECT n_regionkey || ',' || n_name || ',' || n_nationkey AS line FROM nation")
def ordered_csv(spark, sf):
    columns = ["n_regionkey", "n_name", "n_nationkey"]
    return read(spark, sf, "nation").select(F.to_csv(F.struct(*columns)).alias("line"))


@query("k02_strict_json", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def strict_json(spark, sf):
    return writers.strict_json(read(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name"))


@query("k03_nodata_raster", f"WITH {MASKS_SQL} SELECT scene, r, c, round(CASE WHEN valid THEN v ELSE -9999 END, 6) + 0.0::DOUBLE AS band, CASE WHEN valid THEN pred::INT ELSE 255 END AS mask FROM mk")
def nodata_raster(spark, sf):
    ok = F.col("valid")
    out = masks(spark, sf).select("scene", "r", "c", F.when(ok, F.col("v")).alias("band"), F.when(ok, F.col("pred").cast("int")).alias("mask"))
    return rounded(out.fillna({"band": -9999.0, "mask": 255}), "band")


@query("k05_geojson_features", f"""WITH {BOXES_SQL} SELECT '{{"type":"Feature","properties":{{"box":' || box || '}},"geometry":{{"type":"Point","coordinates":[' || l::BIGINT || ',' || b::BIGINT || ']}}}}' AS value FROM bx""")
def geojson_features(spark, sf):
    at = F.array(F.col("l").cast("long"), F.col("b").cast("long"))
    return writers.features(boxes(spark, sf), ["box"], "Point", at)


@query("k06_layer_bundle", f"WITH {MASKS_SQL} SELECT scene, r, c, pred, ref, permanent, valid, pred AND NOT ref AS new, ref AND NOT pred AS lost, round(v, 6) + 0.0::DOUBLE AS band FROM mk")
def layer_bundle(spark, sf):
    """Seven layers of a scene as one wide table."""
    p, r = F.col("pred"), F.col("ref")
    return rounded(masks(spark, sf).select("scene", "r", "c", "pred", "ref", "permanent", "valid", (p & ~r).alias("new"), (r & ~p).alias("lost"), F.col("v").alias("band")), "band")


@query("k10_staging", "SELECT d.doc_id, md5(coalesce(d.text, '')) AS digest FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL")
def staging(spark, sf):
    """What has to be copied: texts that the staged set lacks or has with another digest."""
    new = read(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    quality = read(spark, sf, "labels").select("doc_id", "quality")
    old = new.join(quality, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("digest")).otherwise("old").alias("digest"))
    return writers.changed(new, old, "doc_id", "digest")


@query("k11_empty_table", "SELECT o_orderkey AS zone_id, o_orderstatus AS label, o_totalprice::DOUBLE AS area_ha FROM orders WHERE o_totalprice < 0")
def empty_table(spark, sf):
    """Where nothing passes, a table without rows is written all the same, and read back with its columns and types."""
    found = read(spark, sf, "orders").filter("o_totalprice < 0").select(F.col("o_orderkey").alias("zone_id"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").cast("double").alias("area_ha"))
    return stored(found, "zones")


TILED_SQL = f"WITH {PIXELS_SQL} SELECT scene, r, c, CASE WHEN v >= 0 THEN round(v, 6) END AS band FROM px"


def tiled(spark, sf):
    """The pixels' values, negative ones without data, written in tiles of 3 x 3; the path."""
    px = pixels(spark, sf)
    path, _ = new_path(spark, "tiles")
    tiles.write(px.select("scene", "r", "c", F.when(F.col("v") >= 0, F.round("v", 6)).alias("band")), path, {"band": -9999.0}, tile=3)
    return path


@query("k03_tiled_window", f"SELECT * FROM ({TILED_SQL}) WHERE r BETWEEN 2 AND 4 AND c BETWEEN 3 AND 5")
def tiled_window(spark, sf):
    """What is read back of a written store; the window meets two tiles of nine."""
    return tiles.window(spark, tiled(spark, sf), 2, 3, 4, 5)


@query("v16_geometry_as_written", f"WITH {PIXELS_SQL} SELECT scene, count(*) = 64 AS whole FROM px GROUP BY scene")
def geometry_as_written(spark, sf):
    """The check that follows writing reads the written pixels, not those in memory."""
    return tiles.check(spark, tiled(spark, sf))


@query("k12_json_records", """SELECT '{"key":' || r_regionkey || ',"label":"' || r_name || '"}' AS value FROM region""")
def json_records(spark, sf):
    labels = {"r_regionkey": "key", "r_name": "label"}
    return writers.strict_json(read(spark, sf, "region").select(*labels).withColumnsRenamed(labels))
