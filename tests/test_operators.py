"""Truth tables and boundary cases of the operators, as small literal fixtures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import geometry, integrity, metrics, raster, temporal
from siltgrid.sources import readers, writers
from siltgrid.streaming import windows


def grid(spark, rows, name="m", kind="boolean"):
    return spark.createDataFrame([(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], f"scene long, r int, c int, {name} {kind}")


def as_map(df, *names):
    return {(x.r, x.c): tuple(x[n] for n in names) if len(names) > 1 else x[names[0]] for x in df.collect()}


def test_otsu_finds_the_gap_of_a_skewed_sample(spark):
    rows = [(0.1 * k - 12,) for k in range(9)] * 70 + [(0.1 * k + 3,) for k in range(7)] * 900 + [(31.0,)] * 3
    threshold = raster.otsu(spark.createDataFrame(rows, "v double"), "v").first().threshold
    assert -11.4 < threshold < 3  # the lowest of the bins between them, by its middle


def test_otsu_of_one_value(spark):
    assert raster.otsu(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").first().threshold == 3.0


def test_confusion_of_equal_and_empty_masks(spark):
    df = spark.createDataFrame([(1, True, True), (1, False, False), (2, False, False)], "scene long, pred boolean, ref boolean")
    got = {r.scene: r for r in metrics.confusion(df, ["scene"]).collect()}
    assert got[1].iou == 1 and got[2].iou == 0 and got[2].precision == 0
    assert metrics.confusion(df, ["scene"], empty=None).filter("scene = 2").first().iou is None


def test_agreement_arithmetic(spark):
    out = metrics.derived(spark.createDataFrame([(15774, 8017, 357, 64367)], "tp long, fp long, fn long, tn long")).first()
    assert round(out.f1, 6) == 0.790241 and round(out.iou, 6) == 0.653222


@pytest.mark.parametrize(("ious", "qa", "status"), [([0.6] * 5, {}, "GO"), ([0.6] * 4, {}, "FAIL"), ([0.4] * 5, {}, "REFINE"), ([0.6, 0.6, 0.6, 0.2, 0.2], {}, "FAIL"), ([0.6] * 5, {"artifact": "pending"}, "FAIL"), ([0.6] * 5, {"artifact": "passed"}, "GO")])
def test_gate(spark, ious, qa, status):
    rows = [(k % 2, x, 0.8, 1.0) for k, x in enumerate(ious)]
    out = metrics.gate(spark.createDataFrame(rows, "mode int, iou double, f1 double, bias_pct double"), "mode", qa).first()
    assert out.status == status and bool(out.reasons) == (status != "GO")


def test_distribution_of_nothing(spark):
    out = metrics.distribution(spark.createDataFrame([(1, float("nan")), (1, None), (1, float("inf"))], "g int, v double"), ["g"], "v").first()
    assert out.n == 0 and out.median is None


def test_focal_repeats_edges(spark):
    got = as_map(raster.focal(grid(spark, [[1.0, 2.0], [3.0, 4.0]], "v", "double"), "v", 1, 2, 2), "mean", "n")
    assert got[0, 0] == (pytest.approx((1 * 4 + 2 * 2 + 3 * 2 + 4) / 9), 9)


def test_focal_leaves_invalid_out(spark):
    df = grid(spark, [[1.0, 5.0, 1.0]], "v", "double").withColumn("ok", F.col("c") != 1)
    assert as_map(raster.focal(df, "v", 1, 1, 3, valid="ok"), "mean")[0, 1] == 1.0


def test_erosion_counts_outside_as_false(spark):
    got = as_map(raster.erode(grid(spark, [[True] * 3] * 3), "m"), "eroded")
    assert [k for k, v in got.items() if v] == [(1, 1)]


def test_distance_of_nothing_is_infinite(spark):
    assert all(math.isinf(v) for v in as_map(raster.distance(grid(spark, [[False] * 3] * 2), "m"), "distance").values())


def test_distance_is_euclidean(spark):
    got = as_map(raster.distance(grid(spark, [[True, False, False, False], [False] * 4, [False] * 4, [False] * 4]), "m", 10.0), "distance")
    assert got[3, 3] == pytest.approx(30 * math.sqrt(2)) and got[0, 2] == 20 and got[1, 2] == pytest.approx(10 * math.sqrt(5))


def test_components_over_diagonals(spark):
    df = grid(spark, [[i == j for j in range(4)] for i in range(4)])
    assert len({r.component for r in raster.components(df, "m").collect()}) == 1
    assert len({r.component for r in raster.components(df, "m", eight=False).collect()}) == 4
    assert raster.at_least(raster.components(df, "m"), 5).count() == 0


def test_components_of_a_spiral(spark):
    art = ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######"]
    got = raster.components(grid(spark, [[x == "#" for x in row] for row in art]), "m", eight=False)
    assert got.select("component").distinct().count() == 1


@pytest.mark.parametrize("tile", [None, 5, 64])
@pytest.mark.parametrize("eight", [True, False])
def test_components_match_a_flood_fill(spark, tile, eight):
    rng = random.Random(6)
    fields = [{(r, c) for r in range(23) for c in range(31) if rng.random() < share} for share in (0.35, 0.55, 0.0)]
    fields.append({(r, c) for r in range(0, 40, 2) for c in range(31)} | {(r, 30 if r % 4 == 1 else 0) for r in range(1, 39, 2)})  # one winding path
    want = {}
    for k, field in enumerate(fields):
        width = 31 + k
        for start in sorted(field):
            todo = [start] if (k, *start) not in want else []
            while todo:
                r, c = todo.pop()
                if (r, c) in field and (k, r, c) not in want:
                    want[k, r, c] = start[0] * width + start[1]
                    todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or 0 in (a, b)]
    rows = [(k, r, c, (r, c) in field) for k, field in enumerate(fields) for r in range(41) for c in range(31 + k)]
    df = spark.createDataFrame(rows + rows[:50], "scene long, r int, c int, m boolean").repartition(3)
    got = raster.components(df, "m", eight=eight, tile=tile).collect()
    assert {(x.scene, x.r, x.c): x.component for x in got} == want
    assert raster.components(df.limit(0), "m", eight=eight, tile=tile).count() == 0


def test_labels_of_a_long_path():
    r, c = np.divmod(np.arange(400 * 401), 401)
    on = (r % 2 == 0) | (c == np.where(r % 4 == 1, 400, 0))
    label = raster.label_pixels(np.zeros(on.sum(), int), r[on], c[on], np.array([401]), False)
    assert (label == 0).all()


def test_block_mean_coverage(spark):
    df = grid(spark, [[1.0, 3.0], [0.0, 0.0]], "v", "double").withColumn("ok", F.col("r") == 0)
    out = raster.block_mean(df, "v", "ok", 2, 0.95).first()
    assert (out.value, out.coverage, out.valid) == (2.0, 0.5, False)


def test_block_mode_takes_the_smaller_on_ties(spark):
    assert raster.block_mode(grid(spark, [[2, 1], [1, 2]], "k", "int"), "k", 2).first().value == 1


def test_float_boundary(spark):
    assert spark.range(1).select((F.lit(0.9).cast("float") >= F.lit(0.9).cast("float")).alias("x")).first().x


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 11, "c")], "k int, t int, x string")
    assert {(r.k, r.t): (r.as_of, r.x) for r in temporal.as_of(left, right, ["k"], "t", "t", ["x"]).collect()} == {(1, 10): (9, "b"), (1, 5): (5, "a"), (2, 7): (None, None)}


def test_hourly_has_the_hours_between(spark):
    df = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:10:00' AS ts, 2.0 AS v UNION ALL SELECT 1, timestamp'2024-01-01 03:00:00', 4.0")
    assert [(r.mean, r.n) for r in temporal.hourly(df, ["k"], "ts", "v").orderBy("hour").collect()] == [(2.0, 1), (None, 0), (None, 0), (4.0, 1)]


def test_intervals_are_half_open(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp'2024-01-02 00:00:00'")
    spans = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-02 00:00:00' AS b")
    assert temporal.in_intervals(df, "ts", spans, "a", "b", 3600).count() == 1


def test_projection_of_known_corners(spark):
    df = spark.createDataFrame([(-122.123101, 49.138657), (-122.039809, 49.191968)], "lon double, lat double")
    e, n = geometry.utm(F.col("lon"), F.col("lat"), 10)
    got = [(r.e, r.n) for r in df.select(e.alias("e"), n.alias("n")).collect()]
    assert got[0] == (pytest.approx(563960, abs=0.2), pytest.approx(5443240, abs=0.2))
    assert got[1] == (pytest.approx(569960, abs=0.2), pytest.approx(5449240, abs=0.2))


@pytest.mark.parametrize(("width", "cells"), [(14.0, 0), (16.0, 2)])
def test_rasterizing_by_centres(spark, width, cells):
    ring = spark.sql(f"SELECT 1 AS k, array(struct(0D AS x, 0D AS y), struct({width}D AS x, 0D AS y), struct({width}D AS x, 60D AS y), struct(0D AS x, 60D AS y), struct(0D AS x, 0D AS y)) AS ring")
    assert geometry.rasterize_centres(ring, "k", "ring", 30.0).count() == cells


def test_clipped_length(spark):
    x = [F.lit(float(v)) for v in (-5, 5, 15, 5, 0, 0, 10, 10)]
    y = [F.lit(float(v)) for v in (-5, 50, 15, 50, 0, 0, 10, 10)]
    assert tuple(spark.range(1).select(geometry.clipped_length(*x), geometry.clipped_length(*y)).first()) == (10.0, 0.0)


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,value\n1,2.5\n1,3\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), "id int, value double").count() == 2
    with pytest.raises(ValueError, match="repeat"):
        readers.csv(spark, str(tmp_path / "a.csv"), "id int, value double", unique=["id"])


def test_header_cleanup(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿Date ", " Valeur"])
    assert readers.cleaned_names(df, {"Valeur": "value"}).columns == ["Date", "value"]


def test_geojson_needs_a_crs(spark, tmp_path):
    geometry_ = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    layer = {"type": "FeatureCollection", "features": [{"properties": {"id": "a"}, "geometry": geometry_}, {"properties": {"id": "b"}, "geometry": None}]}
    (tmp_path / "no.json").write_text(json.dumps(layer))
    with pytest.raises(ValueError, match="CRS"):
        readers.geojson_polygons(spark, str(tmp_path / "no.json"))
    (tmp_path / "yes.json").write_text(json.dumps(layer | {"crs": {"type": "name", "properties": {"name": "EPSG:32610"}}}))
    out = readers.geojson_polygons(spark, str(tmp_path / "yes.json")).collect()
    assert len(out) == 1 and out[0].rings[0][1].x == 1.0


def test_ways_need_two_points(spark):
    payload = spark.sql("SELECT array(named_struct('id', 1L, 'tags', map('name', 'A'), 'geometry', array(named_struct('lat', 1D, 'lon', 2D), named_struct('lat', 3D, 'lon', 4D))), named_struct('id', 2L, 'tags', map('name', 'B'), 'geometry', array(named_struct('lat', 1D, 'lon', 2D)))) AS elements")
    assert [(r.osm_id, r.line[1].x) for r in readers.ways(payload).collect()] == [(1, 4.0)]


def test_xml_tags_and_gain_table(spark):
    df = spark.createDataFrame([('<r xmlns:p="u"><p:offset>5</p:offset><stepSize>10</stepSize><gains>100 200 3e2</gains><e/><e>x</e></r>',), ("<r><stepSize>0</stepSize></r>",)], "xml string")
    at, gains = readers.gain_table("xml")
    rows = df.select(at.alias("at"), gains.alias("g"), readers.tag_text("xml", "e").alias("e")).collect()
    assert (rows[0].at, rows[0].g, rows[0].e) == ([5.0, 15.0, 25.0], [100.0, 200.0, 300.0], "x") and rows[1].at is None


def test_checksum_lines(spark):
    lines = spark.createDataFrame([("A" * 40 + "  *dir/a.tif",), ("nothing",), ("b" * 40 + " b.xml",)], "value string")
    assert [(r.sha1, r.path) for r in readers.checksums(lines).collect()] == [("a" * 40, "dir/a.tif"), ("b" * 40, "b.xml")]


def test_strict_json_refuses_nan(spark):
    assert json.loads(writers.strict_json(spark.createDataFrame([(1.5, None)], "b double, a string")).first().value) == {"a": None, "b": 1.5}
    with pytest.raises(Exception, match="finite"):
        writers.strict_json(spark.createDataFrame([(float("nan"),)], "b double")).collect()


def test_frozen_results_are_not_overwritten(spark, tmp_path):
    integrity.write_once(spark.range(2).toDF("x"), str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exist"):
        integrity.write_once(spark.range(3).toDF("x"), str(tmp_path / "r"))
    assert integrity.same_rows(spark.read.parquet(str(tmp_path / "r")), spark.range(2).toDF("x"))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b"):
        integrity.require_columns(spark.range(1).toDF("a"), ["a", "b"])


def test_hash_verification(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string")
    s = spark.createDataFrame([(1, "x"), (2, "n"), (4, "q")], "k int, h string")
    assert {r.k: r.status for r in integrity.verify(a, s, "k", "h").collect()} == {1: "ok", 2: "mismatched", 3: "missing", 4: "absent"}


def test_stream_gives_the_table_s_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 10) AS ts, 'a' AS k, CAST(id AS double) AS v FROM range(60)")
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", ["k"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_windows").start()
    q.processAllAvailable()
    q.stop()
    assert integrity.same_rows(spark.table("hourly_windows"), windows.tumbling(df, "ts", "1 hour", ["k"], "v"))


def boxed(spark, ring, box=(0.0, 0.0, 10.0, 10.0)):
    names = ["l", "b", "r", "t"]
    return spark.createDataFrame([([tuple(map(float, p)) for p in ring], *box)], "ring array<struct<x:double,y:double>>, " + ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize(
    "ring, area",
    [
        ([(-5, -5), (5, -5), (-5, 5), (-5, -5)], 0.0),
        ([(0, 0), (20, 0), (0, 20), (0, 0)], 100.0),
        ([(5, 5), (25, 5), (5, 25), (5, 5)], 25.0),
        ([(2, 2), (4, 2), (4, 6), (2, 6), (2, 2)], 8.0),
        ([(-5, 3), (15, 3), (15, 7), (-5, 7), (-5, 3)], 40.0),
    ],
)
def test_clipped_rings(spark, ring, area):
    df, sides = boxed(spark, ring)
    cut = geometry.clip_ring(df, "ring", *sides).select(F.when(F.size("ring") >= 4, geometry.ring_area("ring")).otherwise(0.0).alias("a"))
    assert cut.first().a == pytest.approx(area)


def test_points_in_a_concave_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, ring)], "key int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (5.0, 5.0), (9.0, 5.0), (0.0, 0.0), (11.0, 1.0), (5.0, 1.9)])], "id int, x double, y double")
    assert sorted(r.id for r in geometry.points_in_rings(points, rings, "ring", 3.0).collect()) == [0, 2, 3, 5]


def test_touched_cells_are_those_a_segment_crosses(spark):
    segments = [(3.0, 4.0, 57.0, 21.0), (15.0, 2.0, 15.0, 38.0), (2.0, 33.0, 41.0, 33.0), (50.0, 5.0, 11.0, 47.0)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(segments)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.k.gx, r.k.gy) for r in df.select("id", F.explode(geometry.touched_cells(10.0)).alias("k")).collect()}
    want = set()
    for i, (x1, y1, x2, y2) in enumerate(segments):
        want |= {(i, int((x1 + t * (x2 - x1)) // 10), int((y1 + t * (y2 - y1)) // 10)) for t in (k / 20000 for k in range(20001))}
    assert got == want


def test_one_file_for_each_group(spark):
    files = spark.createDataFrame([("a", "1.tif"), ("b", "2.tif")], "g string, path string")
    assert {(r.g, r.path) for r in readers.only_one(files, ["g"], "path").collect()} == {("a", "1.tif"), ("b", "2.tif")}
    with pytest.raises(Exception, match="more than one file for a"):
        readers.only_one(files.unionByName(files.filter("g = 'a'")), ["g"], "path").collect()


def test_noise_without_a_marker(spark):
    rows = spark.createDataFrame([("<noiseLevelValues>-3.5 -2 -9</noiseLevelValues>",), ("<gain>4</gain>",)], "xml string")
    assert [str(r[0]) for r in rows.select(readers.noise_level("xml")).collect()] == ["-2.0", "nan"]


def test_gain_table_parses_each_tag_once(spark):
    df = spark.range(3).withColumn("xml", F.concat(F.lit("<p><offset>5</offset><stepSize>2</stepSize><gains>1.5 "), F.col("id").cast("string"), F.lit("</gains></p>")))
    at, gains = readers.gain_table("xml")
    assert [(r.at, r.g) for r in df.select(at.alias("at"), gains.alias("g")).collect()] == [([5.0, 7.0], [1.5, float(i)]) for i in range(3)]
    t = df.select(readers.gain_lookup("xml").alias("t")).select(F.size("t.gains"), F.element_at("t.at", -1), F.col("t.gains")[1])
    assert t._jdf.queryExecution().optimizedPlan().toString().count("local-name()") == 3
