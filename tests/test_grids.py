"""Focal sums over tiles, distances by envelopes in blocks, and traced polygons, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import geometry, raster, tracing


def frame(spark, grids, name="m", kind="boolean"):
    return spark.createDataFrame([(s, r, c, v) for s, g in enumerate(grids) for r, row in enumerate(g) for c, v in enumerate(row)], f"scene long, r int, c int, {name} {kind}")


@pytest.mark.parametrize(("radius", "tile"), [(1, 3), (2, 4), (2, 256), (3, 5)])
def test_focal_sums_over_tiles_repeat_edges(spark, radius, tile):
    rng = random.Random(radius * tile)
    height, width = 7, 11
    values = [[rng.uniform(-5, 5) for _ in range(width)] for _ in range(height)]
    good = [[rng.random() < 0.8 for _ in range(width)] for _ in range(height)]
    rows = [(1, r, c, values[r][c], good[r][c]) for r in range(height) for c in range(width)]
    df = spark.createDataFrame(rows, "scene long, r int, c int, v double, ok boolean")
    for valid in (None, "ok"):
        got = {(x.r, x.c): x for x in raster.focal(df, "v", radius, height, width, valid=valid, keep=["v"], tile=tile).collect()}
        for r in range(height):
            for c in range(width):
                near = [(min(max(r + a, 0), height - 1), min(max(c + b, 0), width - 1)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
                x = [values[i][j] for i, j in near if valid is None or good[i][j]]
                if not x:
                    assert (r, c) not in got
                    continue
                assert (got[r, c].mean, got[r, c].n, got[r, c].v) == (pytest.approx(np.mean(x), abs=1e-9), len(x), values[r][c])
                assert got[r, c].mean_sq == pytest.approx(np.mean(np.square(x)), abs=1e-9)


def test_focal_shuffles_each_pixel_once(spark):
    df = spark.range(256 * 300).select(F.floor(F.col("id") / 76_800).alias("scene"), (F.col("id") / 300).cast("int").alias("r"), (F.col("id") % 300).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    out = raster.focal(df, "v", 1, 256, 300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    sent = df.select(F.explode(F.sequence(F.floor((F.col("r") - 1) / 256), F.floor((F.col("r") + 1) / 256))), "c").select(F.explode(F.sequence(F.floor((F.col("c") - 1) / 256), F.floor((F.col("c") + 1) / 256)))).count()
    assert sent < 1.1 * 256 * 300 and out.count() == 256 * 300


@pytest.mark.parametrize("block", [1, 3, 8, 4096])
def test_distance_in_blocks(spark, block):
    rng = random.Random(block)
    grids = [[[rng.random() < p for _ in range(17)] for _ in range(9)] for p in (0.0, 0.01, 0.05, 0.4, 1.0)] + [[[c == 16 and r == 8 for c in range(17)] for r in range(9)]]
    got = {(x.scene, x.r, x.c): x.distance for x in raster.distance(frame(spark, grids), "m", 2.0, block=block).collect()}
    assert len(got) == 6 * 9 * 17
    for s, g in enumerate(grids):
        on = [(r, c) for r in range(9) for c in range(17) if g[r][c]]
        for r in range(9):
            for c in range(17):
                assert got[s, r, c] == pytest.approx(min((2 * math.hypot(r - i, c - j) for i, j in on), default=math.inf))


def test_distance_of_a_very_wide_row(spark):
    width = 60_000
    df = spark.range(width).select(F.lit(1).cast("long").alias("scene"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.col("id").isin(0, 41_000, width - 1).alias("m"))
    out = raster.distance(df, "m", block=1000)
    want = F.least(F.col("c"), F.abs(F.col("c") - 41_000), F.lit(width - 1) - F.col("c")).cast("double")
    assert out.filter(F.col("distance") != want).count() == 0 and out.count() == width


def test_envelope_keeps_what_is_least_somewhere():
    rng = random.Random(2)
    for _ in range(200):
        at = sorted(rng.sample(range(40), rng.randint(1, 12)))
        g = [rng.randint(0, 25) for _ in at]
        kept, since = raster.envelope(at, g)
        for x in range(-5, 50):
            n = max(i for i, s in enumerate(since) if s <= x)
            assert g[kept[n]] ** 2 + (x - at[kept[n]]) ** 2 == min(h * h + (x - a) ** 2 for a, h in zip(at, g))


SHAPES = [
    ["######", "#....#", "#.##.#", "#.##.#", "#....#", "######"],  # a zone in the hole of another
    ["#.#.#.", ".#.#.#", "#.#.#.", ".#.#.#"],  # pixels that touch at corners only
    ["###", "#.#", "###"],
    ["##.", "#.#", ".##"],
    ["######", "#.##.#", "##..##", "#.##.#", "######"],  # holes that touch at corners
    ["......", ".#...."],
    ["...."],
]


def test_traced_rings_hold_their_pixels(spark):
    rng = random.Random(7)
    grids = [[[x == "#" for x in row] for row in g] for g in SHAPES] + [[[rng.random() < p for _ in range(13)] for _ in range(10)] for p in (0.3, 0.55, 0.7, 0.9)]
    lab = raster.components(frame(spark, grids), "m", eight=False)
    want = {}
    for x in lab.collect():
        want.setdefault((x.scene, x.component), set()).add((x.r, x.c))
    rings = tracing.trace(lab).collect()
    areas, outlines = {}, {}
    for x in rings:
        key = (x.scene, x.component)
        p = [(q.x, q.y) for q in x.points]
        assert p[0] == p[-1] and len(p) == x.corners + 1 and x.corners >= 4
        assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(p, p[1:])) == x.sides
        assert sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:])) / 2 == x.signed_area
        areas[key] = areas.get(key, 0) + x.signed_area
        outlines[key] = outlines.get(key, 0) + (x.signed_area > 0)
    assert areas == {k: len(v) for k, v in want.items()} and set(outlines.values()) == {1}
    polygons = tracing.zone_polygons(lab)
    cells = geometry.rasterize_centres(polygons.select(F.struct("scene", "component").alias("zone"), F.explode("rings").alias("ring")), "zone", "ring", 1.0)
    back = {}
    for x in cells.collect():
        back.setdefault((x.zone.scene, x.zone.component), set()).add((-x.gy - 1, x.gx))
    assert back == want
    assert tracing.trace(lab.limit(0)).count() == 0


def test_tiles_are_read_by_window(spark, tmp_path):
    from siltgrid.sources import tiles

    rows = [(s, r, c, None if (r + c) % 5 == 0 else float(100 * s + 10 * r + c)) for s in (1, 2) for r in range(7) for c in range(11)]
    df = spark.createDataFrame(rows, "scene long, r int, c int, band double")
    path = f"{tmp_path}/store"
    tiles.write(df, path, {"band": -1.0}, tile=4)
    back = tiles.window(spark, path, 0, 0, 6, 10)
    assert sorted(map(tuple, back.select("scene", "r", "c", "band").collect()), key=str) == sorted(rows, key=str)
    part = tiles.window(spark, path, 5, 1, 6, 3)
    assert sorted(map(tuple, part.select("scene", "r", "c", "band").collect()), key=str) == sorted([x for x in rows if 5 <= x[1] <= 6 and 1 <= x[2] <= 3], key=str)
    assert {f.split("pixels/")[1].rsplit("/", 1)[0] for f in part.inputFiles()} >= {"tr=1/tc=0"}
    read = part.select("_metadata.file_path").distinct().collect()
    assert all("/tr=1/tc=0/" in x[0] for x in read)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tr" in plan and "tr#" in plan
    assert all(x.whole for x in tiles.check(spark, path).collect())
    spark.createDataFrame([(2, 3, 3, 0.0, 0, 0)], "scene long, r int, c int, band double, tr int, tc int").write.partitionBy("tr", "tc").mode("append").parquet(f"{path}/pixels")
    assert {x.scene: x.whole for x in tiles.check(spark, path).collect()} == {1: True, 2: False}
    with pytest.raises(Exception, match="already exists"):
        tiles.write(df, path, {"band": -1.0}, tile=4)


def test_inverse_projection_undoes_the_projection(spark):
    from siltgrid.operators import warping

    rng = random.Random(3)
    rows = [(i, rng.uniform(-126, -120), rng.uniform(0.001, 83.9)) for i in range(300)] + [(300, -123.0, 0.001), (301, -120.1, 83.9)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    e, n = geometry.utm(F.col("lon"), F.col("lat"), 10)
    back = warping.lonlat(df.select("*", e.alias("e"), n.alias("n")), "e", "n", 10, "lon2", "lat2")
    e2, n2 = geometry.utm(F.col("lon2"), F.col("lat2"), 10)
    for x in back.select("*", e2.alias("e2"), n2.alias("n2")).collect():
        assert abs(x.e2 - x.e) < 1e-6 and abs(x.n2 - x.n) < 1e-6  # metres
        assert abs(x.lon2 - x.lon) < 1e-11 and abs(x.lat2 - x.lat) < 1e-11


def test_bilinear_values_of_overlapping_tiles(spark):
    from siltgrid.operators import warping

    rng = random.Random(5)
    tiles = {(t, r, c): rng.uniform(0, 9) for t in (0, 1) for r in range(5) for c in range(6)}
    df = spark.createDataFrame([(t, r, c, None if (t, r, c) == (0, 0, 0) else v) for (t, r, c), v in tiles.items()], "t int, r int, c int, v double")
    grid = warping.mosaic(df, F.col("r"), F.col("c") + 4 * F.col("t"), "v")  # two columns overlap
    values = {}
    for (t, r, c), v in tiles.items():
        if (t, r, c) != (0, 0, 0):
            values.setdefault((r, c + 4 * t), []).append(v)
    values = {k: sum(v) / len(v) for k, v in values.items()}
    places = [(i, rng.uniform(-1, 10), rng.uniform(-1, 5)) for i in range(200)] + [(200, 3.0, 2.0), (201, 9.0, 4.0), (202, 0.0, 0.5), (203, 4.5, 2.0)]
    got = {x.id: x.value for x in warping.bilinear(grid, spark.createDataFrame(places, "id long, x double, y double"), "id", F.col("x"), F.col("y")).collect()}
    for i, x, y in places:
        c, r = math.floor(x), math.floor(y)
        parts = [((y - r if a else 1 - y + r) * (x - c if b else 1 - x + c), (r + a, c + b)) for a in (0, 1) for b in (0, 1)]
        parts = [(w, k) for w, k in parts if w > 0]
        want = sum(w * values[k] for w, k in parts) if all(k in values for _, k in parts) else None
        assert got.get(i) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(("factor", "size"), [(1.6, 5), (0.5, 30), (3.0, 2), (0.7, 9)])
def test_nearest_resampling_by_arithmetic(spark, factor, size):
    df = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(8) for c in range(8)], "scene long, r int, c int, v double")
    got = {(x.tr, x.tc): x.value for x in raster.resample_nearest(df, "v", factor, size).collect()}
    at = lambda t: math.floor((t + 0.5) * factor)
    assert got == {(i, j): 10.0 * at(i) + at(j) for i in range(size) for j in range(size) if at(i) < 8 and at(j) < 8}


def spiral(n):
    """One path that winds to the middle of an n x n grid, one pixel wide."""
    grid = [[False] * n for _ in range(n)]
    r = c = d = 0
    steps = ((0, 1), (1, 0), (0, -1), (-1, 0))
    free = lambda i, j: not (0 <= i < n and 0 <= j < n) or not grid[i][j]
    grid[0][0] = True
    while True:
        for turn in (0, 1):
            i, j = r + steps[(d + turn) % 4][0], c + steps[(d + turn) % 4][1]
            if 0 <= i < n and 0 <= j < n and not grid[i][j] and free(i + steps[(d + turn) % 4][0], j + steps[(d + turn) % 4][1]):
                d, r, c = (d + turn) % 4, i, j
                grid[r][c] = True
                break
        else:
            return grid


@pytest.mark.parametrize("eight", [True, False])
def test_components_over_many_tiles(spark, eight):
    rng = random.Random(11)
    grids = [spiral(33), [[rng.random() < 0.55 for _ in range(33)] for _ in range(33)], [[True] * 33 for _ in range(33)], [[False] * 33 for _ in range(33)]]
    df = frame(spark, grids)
    whole = {(x.scene, x.r, x.c): x.component for x in raster.components(df, "m", eight).collect()}
    for tile in (4, 9):
        assert {(x.scene, x.r, x.c): x.component for x in raster.components(df, "m", eight, tile=tile).collect()} == whole
    assert {v for (s, _, _), v in whole.items() if s in (0, 2)} == {0} and sum(k[0] == 0 for k in whole) > 500


def test_large_scenes_are_tiled_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(raster, "WHOLE", 8)
    grids = [spiral(21)]
    got = {(x.r, x.c): x.component for x in raster.components(frame(spark, grids), "m").collect()}
    assert set(got.values()) == {0} and len(got) == sum(map(sum, grids[0]))
    assert raster.components(frame(spark, grids).limit(0), "m").count() == 0


def test_least_nodes_of_links(spark):
    rng = random.Random(4)
    order = rng.sample(range(200), 200)
    links = [(1, a, b) for a, b in zip(order, order[1:])] + [(2, 5, 6), (2, 6, 7), (2, 7, 5), (2, 9, 9), (3, 1, 100), (3, 100, 50)]
    got = {(x.scene, x.node): x.root for x in raster.linked_roots(spark.createDataFrame(links, "scene long, a long, b long")).collect()}
    assert got == {(1, i): 0 for i in range(200)} | {(2, 5): 5, (2, 6): 5, (2, 7): 5, (3, 1): 1, (3, 50): 1, (3, 100): 1}


def test_rings_of_small_scenes_in_a_task_and_by_rounds(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(s, r, c, rng.random() < 0.6) for s in range(6) for r in range(9) for c in range(11)]
    lab = raster.components(spark.createDataFrame(rows, "scene long, r int, c int, m boolean"), "m", eight=False).cache()
    rings = lambda: sorted(map(str, tracing.trace(lab).collect()))
    rounds = []
    monkeypatch.setattr(tracing, "rings_of", lambda *a, f=tracing.rings_of: rounds.append(1) or f(*a))
    small = rings()
    assert not rounds and len(small) > 20
    monkeypatch.setattr(tracing, "WHOLE", 5)
    assert rings() == small and rounds


def test_links_of_tiles_are_not_broadcast(spark):
    """Files of labels are far smaller than their rows, which would go whole through the driver."""
    df = spark.createDataFrame([(0, 0, c, True) for c in range(8)], "scene long, r int, c int, m boolean")
    out = raster.components(df, "m", tile=3)
    assert [r.component for r in out.collect()] == [0] * 8
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_rings_of_whole_scenes_are_shuffled_once(spark):
    rows = [(s, r, c, s % 2) for s in range(5) for r in range(4) for c in range(4) if (r, c) != (1, 2)]
    polygons = tracing.zone_polygons(spark.createDataFrame(rows, "scene long, r int, c int, component long"))
    cells = geometry.rasterize_centres(polygons.select("scene", "component", F.explode("rings").alias("ring")), ["scene", "component"], "ring", 1.0)
    # pixels go to their scene, and rings once more; polygons, crossings and cells stay there
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 2
    assert {(x.scene, -int(x.gy) - 1, int(x.gx), x.component) for x in cells.collect()} == set(rows)
