"""Polygons of any shape, nearest features at any distance and boundary scores, against plain Python and truth tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import geometry, nearest, overlay, raster, slabs


def ring(rng, cx, cy, low, high, n):
    """A star-shaped ring, concave as a rule, of either direction."""
    p = []
    for k in range(n):
        a, r = 2 * math.pi * (k + rng.uniform(0, 0.9)) / n, rng.uniform(low, high)
        p.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    if rng.random() < 0.5:
        p.reverse()
    return [*p, p[0]]


def polygon(rng):
    cx, cy = rng.uniform(0, 300), rng.uniform(-200, 100)
    return [ring(rng, cx, cy, 40, 120, rng.randint(5, 11)), *([ring(rng, cx, cy, 2, 9, 4)] if rng.random() < 0.6 else [])]


def shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]])) / 2


def shared(a, b):
    """Signed area that two triangles share, by clipping one at the other's sides."""
    sa, sb = shoelace(a), shoelace(b)
    if abs(sa) < 1e-12 or abs(sb) < 1e-12:
        return 0.0
    out, b = a if sa > 0 else a[::-1], b if sb > 0 else b[::-1]
    for p, q in zip(b, [*b[1:], b[0]]):
        side = lambda z, p=p, q=q: (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])
        cut = []
        for u, v in zip(out, [*out[1:], *out[:1]]):
            su, sv = side(u), side(v)
            if su >= 0:
                cut.append(u)
            if (su >= 0) != (sv >= 0):
                cut.append((u[0] + su / (su - sv) * (v[0] - u[0]), u[1] + su / (su - sv) * (v[1] - u[1])))
        out = cut
        if len(out) < 3:
            return 0.0
    return math.copysign(1, sa) * math.copysign(1, sb) * shoelace(out)


def fan(rings):
    """A polygon as signed triangles from one point: outlines counter-clockwise, holes clockwise."""
    out = []
    for k, r in enumerate(rings):
        r = r if (shoelace(r[:-1]) > 0) == (k == 0) else r[::-1]
        out += [[(0.0, 0.0), p, q] for p, q in zip(r, r[1:])]
    return out


def area(rings):
    return sum(abs(shoelace(r[:-1])) * (1 if k == 0 else -1) for k, r in enumerate(rings))


def both(p, q):
    return sum(shared(x, y) for x in fan(p) for y in fan(q))


def frame(spark, polygons, key):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for i, p in enumerate(polygons)]
    return spark.createDataFrame(rows, f"{key} long, rings {overlay.RINGS}")


@pytest.mark.parametrize("size", [60.0, 1000.0])
def test_overlay_of_concave_polygons_with_holes(spark, size):
    rng = random.Random(5)
    first, second = ([polygon(rng) for _ in range(9)] for _ in range(2))
    got = {(r.a, r.b): r for r in overlay.pair_areas(frame(spark, first, "a"), frame(spark, second, "b"), "a", "b", "rings", size).collect()}
    for i, p in enumerate(first):
        for j, q in enumerate(second):
            want = both(p, q)
            if (i, j) not in got:
                assert abs(want) < 1e-9
                continue
            r = got[i, j]
            assert r.both == pytest.approx(want, abs=1e-6)
            assert (r.only_first, r.only_second) == (pytest.approx(area(p) - want, abs=1e-6), pytest.approx(area(q) - want, abs=1e-6))
            assert (r.either, r.differing) == (pytest.approx(area(p) + area(q) - want, abs=1e-6), pytest.approx(area(p) + area(q) - 2 * want, abs=1e-6))


def test_layers_of_many_polygons(spark):
    rng = random.Random(9)
    polygons = [polygon(rng) for _ in range(3)]
    p, q, s = polygons
    found = {r.layers: r.area for r in overlay.cover_areas(frame(spark, polygons, "a").withColumn("g", F.lit("x")), "rings", ["g"], 45.0).collect()}
    three = sum(n * found.get(n, 0.0) for n in (1, 2, 3))
    assert three == pytest.approx(area(p) + area(q) + area(s), abs=1e-6)
    assert found.get(2, 0.0) + 3 * found.get(3, 0.0) == pytest.approx(both(p, q) + both(p, s) + both(q, s), abs=1e-6)


def square(x, y, side, turn=1):
    p = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)][::turn]
    return [*p, p[0]]


def test_overlay_of_equal_touching_and_odd_polygons(spark):
    cases = [([square(0, 0, 10)], [square(0, 0, 10, -1)], 100.0), ([square(0, 0, 10)], [square(10, 0, 10)], 0.0), ([square(0, 0, 10), square(2, 2, 3)], [square(2, 2, 3)], 0.0), ([square(0, 0, 10), square(2, 2, 3)], [square(0, 0, 10)], 91.0), ([square(-5, -5, 10)], [[(0, 0), (8, 0), (0, 8), (0, 0)]], 25.0), ([[]], [square(0, 0, 1)], 0.0), ([[(0, 0), (5, 5), (0, 0)]], [square(0, 0, 9)], 0.0)]
    rows = [(i, layer, [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for i, (a, b, _) in enumerate(cases) for layer, p in ((0, a), (1, b))]
    df = spark.createDataFrame([*rows, (90, 0, None), (91, 1, [])], f"g long, layer int, rings {overlay.RINGS}")
    got = {r.g: r.both for r in overlay.overlay_areas(df, "rings", ["g"], "layer", 4.0).collect()}
    want = [100.0, 0.0, 0.0, 91.0, both([square(-5, -5, 10)], [[(0, 0), (8, 0), (0, 8), (0, 0)]]), 0.0, 0.0]
    assert [got[i] for i in range(7)] == pytest.approx(want, abs=1e-9) and got[90] == got[91] == 0.0
    assert overlay.overlay_areas(df.limit(0), "rings", ["g"], "layer", 4.0).count() == 0


def inside(rings, x, y):
    hits = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            hits += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return hits % 2 == 1


def test_lines_through_concave_polygons(spark):
    rng = random.Random(4)
    polygons = [polygon(rng) for _ in range(6)]
    lines = [(i, rng.uniform(-200, 450), rng.uniform(-350, 250), rng.uniform(-200, 450), rng.uniform(-350, 250)) for i in range(25)]
    lines += [(25, -900.0, -50.0, 900.0, -49.0), (26, 5.0, 5.0, 5.0, 5.0)]  # one that only passes through, one without length
    df = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.p): r.inside for r in overlay.lines_in_polygons(df, frame(spark, polygons, "p"), "id", "p", "rings", 50.0).collect()}
    for i, x1, y1, x2, y2 in lines:
        for j, p in enumerate(polygons):
            ts = {0.0, 1.0}
            for r in p:
                for (ax, ay), (bx, by) in zip(r, r[1:]):
                    d = (x2 - x1) * (by - ay) - (y2 - y1) * (bx - ax)
                    if d:
                        t, u = ((ax - x1) * (by - ay) - (ay - y1) * (bx - ax)) / d, ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / d
                        ts |= {t} if 0 <= t <= 1 and 0 <= u <= 1 else set()
            ts = sorted(ts)
            want = sum(b - a for a, b in zip(ts, ts[1:]) if inside(p, x1 + (a + b) / 2 * (x2 - x1), y1 + (a + b) / 2 * (y2 - y1))) * math.hypot(x2 - x1, y2 - y1)
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=1e-6)
            assert ((i, j) in got) == (want > 0 or inside(p, x1, y1))


def test_lines_that_only_touch_meet(spark):
    lines = [(0, 10.0, -5.0, 10.0, 15.0), (1, 10.5, 0.0, 10.5, 9.0), (2, -4.0, 4.0, 4.0, -4.0), (3, 3.0, 3.0, 4.0, 4.0), (4, 1.0, 1.0, 1.0, 1.0), (5, 3.5, 3.5, 3.5, 3.5)]
    p = frame(spark, [[square(0, 0, 10), square(3, 3, 1)]], "p")
    got = {r.id: r.inside for r in overlay.lines_in_polygons(spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), p, "id", "p", "rings", 3.0).collect()}
    assert set(got) == {0, 2, 3, 4}  # along a side, through a corner, across the hole by its corners, a point inside; not beside, not in the hole
    assert got[2] == got[3] == got[4] == 0


def test_lines_by_polygon_sum_up_pairs_in_their_tiles(spark, monkeypatch):
    rng = random.Random(7)
    at = lambda: rng.uniform(-40, 90)
    lines = [(i % 70, *((x, y, x, y) if i % 9 == 0 else (x, y, at(), at()) if i % 4 == 0 else (x, y, x + rng.uniform(-20, 20), y))) for i in range(100) for x, y in [(at(), at())]]
    lines += [(None, 0.0, 0.0, 50.0, 50.0), (None, 0.0, 5.0, 50.0, 50.0), (98, None, 0.0, 1.0, 1.0)]
    polygons = []
    for _ in range(40):
        x, y, w = at(), at(), rng.choice([3, 15, 60])
        polygons.append([square(x, y, w), square(x + w / 4, y + w / 4, w / 3)][: rng.choice([1, 2])])
    df = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    p = frame(spark, polygons, "p")
    p = p.withColumn("p", F.when(F.col("p") < 30, F.col("p")).when(F.col("p") < 36, F.col("p") % 4)).unionByName(spark.createDataFrame([(77, None), (78, [])], p.schema))
    pairs = overlay.lines_in_polygons(df, p, "id", "p", "rings", 20.0).filter("inside > 0.5")
    want = {r.p: (r.n, pytest.approx(r.m)) for r in pairs.groupBy("p").agg(F.count("*").alias("n"), F.sum("inside").alias("m")).collect()}
    for block in (1024, 3):
        monkeypatch.setattr(overlay, "BLOCK", block)
        found = overlay.lines_by_polygon(df, p, "id", "p", "rings", 20.0, 0.5)
        assert {r.p: (r.lines, r.inside) for r in found.collect()} == want and len(want) > 20 and None in want
    monkeypatch.setattr(overlay, "BLOCK", 1024)
    level = (F.col("id") + 0.5).alias("y1"), F.lit(40.0).alias("x2"), (F.col("id") + 0.5).alias("y2")
    dense = overlay.lines_by_polygon(spark.range(300).select("id", F.lit(1.0).alias("x1"), *level), frame(spark, [[square(0, 0, 300)]] * 50, "p"), "id", "p", "rings", 100.0, 0.5)
    assert sorted((r.p, r.lines, round(r.inside, 6)) for r in dense.collect()) == [(i, 300, 300 * 39.0) for i in range(50)]
    plan = dense._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan


def test_boxes_of_many_cells_hold_segments(spark):
    boxes = spark.createDataFrame([(1, 500.0, 100.0, 2500.0, 700.0), (2, -50.0, -50.0, 0.0, 0.0)], "box long, l double, b double, r double, t double")
    lines = spark.createDataFrame([(7, 2100.0, 200.0, 2200.0, 300.0), (8, 0.0, 400.0, 9000.0, 400.0), (9, -100.0, -100.0, 100.0, 100.0), (10, 500.0, 100.0, 500.0, 50.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.box): r.inside_m for r in geometry.lengths_in_boxes(lines, boxes, 300.0).collect()}
    assert got == {(7, 1): pytest.approx(math.hypot(100, 100)), (8, 1): pytest.approx(2000.0), (9, 2): pytest.approx(math.hypot(50, 50))}


def test_nearest_box_at_any_distance(spark):
    rng = random.Random(1)
    places = [(i, rng.uniform(0, 1000) + (1e5 if i % 7 == 0 else 0), rng.uniform(0, 1000) - (3e6 if i % 11 == 0 else 0)) for i in range(150)]
    boxes = []
    for i in range(700):  # some crowded, some large
        x, y = rng.choice([(rng.uniform(0, 1000), rng.uniform(0, 1000)), (rng.gauss(300, 5), rng.gauss(300, 5))])
        w, h = rng.choice([(1, 1), (30, 2), (400, 300)])
        boxes.append((i, x, y, x + rng.random() * w, y + rng.random() * h))
    boxes += [(700 + i, 5.0, 5.0, 6.0, 6.0) for i in range(20)]
    own = spark.createDataFrame([*places, (900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double").select("id", "x", "y", F.col("x").alias("l"), F.col("y").alias("b"), F.col("x").alias("r"), F.col("y").alias("t"))
    to = spark.createDataFrame([*boxes, (-1, None, 0.0, 0.0, 0.0), (-2, float("inf"), 0.0, 0.0, 0.0)], "box long, l2 double, b2 double, r2 double, t2 double")
    d = geometry.box_distance(*(F.col(c) for c in ("x", "y", "l2", "b2", "r2", "t2")))
    found = nearest.nearest(own, to, "id", "box", d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    got = {r.id: (r.distance, r.box) for r in found.collect()}
    assert len(got) == len(places)
    for i, x, y in places:
        want = min((math.hypot(max(left - x, 0, x - right), max(low - y, 0, y - top)), k) for k, left, low, right, top in boxes)
        assert got[i] == (pytest.approx(want[0]), want[1])
    assert nearest.nearest(own, to.limit(0), "id", "box", d).count() == 0


def gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_distance_of_lines_points_and_polygons_to_a_union(spark):
    rng = random.Random(12)
    polygons = [polygon(rng) for _ in range(5)]
    lines = [(i, x := rng.uniform(-400, 700), y := rng.uniform(-600, 500), x + rng.choice([0.0, 30.0]), y + rng.choice([0.0, -25.0])) for i in range(30)]
    lines += [(30, 5e6, 1.0, 5e6 + 1, 1.0)]
    df = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.distance for r in nearest.distance_to_union(df, frame(spark, polygons, "p"), "id", "rings", 40.0).collect()}
    crosses = lambda a, b, c, d: (lambda o: o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0)(lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i, x1, y1, x2, y2 in lines:
        a, b = (x1, y1), (x2, y2)
        edges = [(p, q) for poly in polygons for r in poly for p, q in zip(r, r[1:])]
        want = 0.0 if any(inside(p, x1, y1) for p in polygons) or any(crosses(a, b, p, q) for p, q in edges) else min(min(gap(a, p, q), gap(b, p, q), gap(p, a, b), gap(q, a, b)) for p, q in edges)
        assert got[i] == pytest.approx(want, abs=1e-6)
    # a polygon that holds a target wholly
    frame_ = frame(spark, [[square(-5000, -5000, 10000)]], "id")
    outline = nearest.ring_segments(frame_, "rings", ["id"]).select("id", *(F.col(f"s{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    assert nearest.distance_to_union(outline, frame(spark, polygons, "p"), "id", "rings", 500.0, areas=frame_).first().distance == 0
    assert nearest.distance_to_union(outline, frame(spark, polygons, "p"), "id", "rings", 500.0).first().distance > 1000


def scenes(spark, masks):
    rows = [(s, r, c, p[r][c] == "#", q[r][c] == "#", True) for s, (p, q) in enumerate(masks) for r in range(len(p)) for c in range(len(p[0]))]
    return spark.createDataFrame(rows, "scene long, r int, c int, pred boolean, ref boolean, valid boolean")


def test_boundaries_of_empty_and_shifted_masks(spark):
    empty, spot = ["......"] * 5, ["......", "..##..", "..##..", "......", "......"]
    moved, far = ["......", "....##", "....##", "......", "......"], ["......", "......", "......", "......", ".....#"]
    df = scenes(spark, [(empty, spot), (spot, empty), (empty, empty), (spot, spot), (spot, moved), (spot, far)])
    f1 = {r.scene: r for r in raster.boundary_f1(df, "pred", "ref", (1, 2), valid="valid").collect()}
    assert [(f1[s].pred_edge, f1[s].ref_edge) for s in range(6)] == [(0, 4), (4, 0), (0, 0), (4, 4), (4, 4), (4, 1)]
    assert [f1[s].boundary_f1_1px for s in range(6)] == [0, 0, 0, 1, 0.5, 0] and [f1[s].boundary_f1_2px for s in range(6)] == [0, 0, 0, 1, 1, 0]
    d = {r.scene: r for r in raster.boundary_distances(df, "pred", "ref").collect()}
    assert [d[s].median_px for s in range(3)] == [math.inf] * 3 and [d[s].p95_px for s in range(3)] == [math.inf] * 3
    assert d[3].most_px == 0 and (d[4].median_px, d[4].most_px) == (1.5, 2.0) and (d[0].pred_edge, d[0].ref_edge) == (0, 4)


@pytest.mark.parametrize("size, block", [(60.0, 1024), (1000.0, 2)])
def test_shared_areas_of_layers(spark, monkeypatch, size, block):
    monkeypatch.setattr(overlay, "BLOCK", block)
    rng = random.Random(6)
    first, second = ([polygon(rng) for _ in range(9)] for _ in range(2))
    got = {(r.a, r.b): r.both for r in overlay.shared_areas(frame(spark, first, "a"), frame(spark, second, "b"), "a", "b", "rings", size).collect()}
    for i, p in enumerate(first):
        for j, q in enumerate(second):
            assert got.get((i, j), 0.0) == pytest.approx(both(p, q), abs=1e-6)


def test_pairs_of_layers_send_edges_only(spark):
    """Not a ring for each pair: what is shuffled before the areas does not grow with the pairs."""
    df = frame(spark, [[square(0, 0, 10)]] * 3, "a")
    plan = overlay.shared_areas(df, df.withColumnRenamed("a", "b"), "a", "b", "rings", 1000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan.replace("FlatMapCoGroupsInPandas", "")


def test_pairs_of_layers_leave_one_tile_whole(spark, monkeypatch):
    rng = random.Random(11)
    first, second = ([polygon(rng) for _ in range(14)] for _ in range(2))
    first += [[square(-200, -300, 600), square(0, 0, 40)], [square(0, 0, 10), square(2, 2, 3)], [[]], [[(0, 0), (5, 5), (0, 0)]]]
    second += [[square(-5, -5, 10)], [square(10, 0, 10)], [square(-250, -250, 500, -1)]]
    a, b = frame(spark, first, "a").withColumnRenamed("rings", "shape"), frame(spark, second, "b").withColumnRenamed("rings", "shape")
    found = overlay.shared_areas(a, b, "a", "b", "shape", 60.0)
    assert "Aggregate [a#" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair is sent to be summed
    want = {(i, j): both(p, q) if p[0] else 0.0 for i, p in enumerate(first) for j, q in enumerate(second)}
    # whole, by cut edges and mixed, in blocks and in parts
    for whole, block, held in ((4096, 1024, 1 << 17), (4096, 3, 7), (150, 5, 1 << 17), (0, 1024, 1 << 17)):
        for name, value in (("WHOLE", whole), ("BLOCK", block), ("HELD", held)):
            monkeypatch.setattr(overlay, name, value)
        rows = overlay.shared_areas(a, b, "a", "b", "shape", 60.0).collect()
        got = {(r.a, r.b): r.both for r in rows}
        assert len(got) == len(rows)
        for pair, area_of in want.items():
            assert got.get(pair, 0.0) == pytest.approx(area_of, abs=1e-6)


def test_strips_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    n = 60
    y = rng.uniform(0, 10, (n, 2)).round(1)
    e = (rng.integers(0, 3, n), rng.choice([-1, 1], n), rng.uniform(0, 10, n), y.min(axis=1), rng.uniform(0, 10, n), y.max(axis=1) + 0.1)
    want = np.concatenate([np.stack(p) for p in slabs.strips(*e, 10.0)], axis=1)
    monkeypatch.setattr(slabs.pieces, "__defaults__", (5,))
    parts = [np.stack(p) for p in slabs.strips(*e, 10.0)]
    assert len(parts) > 20 and max(p.shape[1] for p in parts) <= n
    assert np.array_equal(np.concatenate(parts, axis=1), want)


def test_cover_of_many_copies(spark):
    rng = random.Random(10)
    p, q = polygon(rng), polygon(rng)
    df = frame(spark, [p] * 40 + [q] * 3, "a").withColumn("g", F.lit("x"))
    cover = overlay.cover_areas(df, "rings", ["g"], 45.0)
    found = {r.layers: r.area for r in cover.collect()}
    common = both(p, q)
    assert [found.get(n, 0.0) for n in (3, 40, 43)] == [pytest.approx(v, abs=1e-6) for v in (area(q) - common, area(p) - common, common)]
    # edges of a tile are not joined with each other, nor with slabs
    assert "Join" not in cover._jdf.queryExecution().optimizedPlan().toString()


def test_places_deep_in_many_polygons_meet_no_edges(spark):
    """Squares on each other: only cells that none holds wholly are left, and edges within the union are no targets."""
    polygons = [[square(10 * k, 10 * k, 200)] for k in range(10)]
    solid = {(r.gx, r.gy) for r in nearest.solid_cells(frame(spark, polygons, "p"), "rings", 25.0).collect()}
    want = {(x, y) for x in range(12) for y in range(12) if any(10 * k < 25 * x and 25 * x + 25 < 10 * k + 200 and 10 * k < 25 * y and 25 * y + 25 < 10 * k + 200 for k in range(10))}
    assert solid == want and len(want) > 50
    points = [(i, float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate([(100, 100), (0, 0), (-30, 50), (290, 290), (300, 290), (5e6, 100), (250, 15), (math.nan, 1)])]
    df = spark.createDataFrame(points, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.distance for r in nearest.distance_to_union(df, frame(spark, polygons, "p"), "id", "rings", 100.0).collect()}
    for i, x, y, *_ in points[:-1]:
        want = min(math.hypot(max(10 * k - x, 0, x - 10 * k - 200), max(10 * k - y, 0, y - 10 * k - 200)) for k in range(10))
        assert got[i] == pytest.approx(want, abs=1e-6)
    assert len(got) == 7


def test_far_off_only_the_nearest_side_is_left(spark):
    """From far off, the box's near side bounds the distance, not its far corner."""
    df = spark.createDataFrame([(10000.0, 50.0, 10000.0, 50.0, 0.0, 0.0, 300.0, 100.0)], "l double, b double, r double, t double, l2 double, b2 double, r2 double, t2 double")
    row = df.select(nearest.least_gap().alias("least"), nearest.most_gap().alias("most")).first()
    assert row.least == 9700 and row.most == pytest.approx(math.hypot(9700, 50))


def test_rings_of_a_union_are_not_broadcast(spark, tmp_path):
    """They stand in a row for each cell, which the size of their table does not tell."""
    df = spark.createDataFrame([(1, 50.0, 50.0, 60.0, 60.0), (2, 900.0, 0.0, 950.0, 40.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    shapes = {"union": frame(spark, [[square(0, 0, 100)]], "p"), "areas": frame(spark, [[square(895, -5, 60)]], "id").withColumn("id", F.lit(2))}
    for name, table in shapes.items():
        table.write.parquet(f"{tmp_path}/{name}")  # of a known size
    union, areas = (spark.read.parquet(f"{tmp_path}/{name}") for name in shapes)
    found = nearest.distance_to_union(df, union, "id", "rings", 400.0, areas=areas)
    tests = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "ring#" in line]
    assert len(tests) == 2 and all("SortMergeJoin" in line for line in tests)
    assert {r.id: r.distance for r in found.collect()} == {1: 0.0, 2: 800.0}


def test_nearest_segments_of_long_lines_by_their_ends(spark):
    """The ends bound the distance by less than the box does, and the nearest stays the nearest."""
    rng = random.Random(21)
    lines = [(i, x := rng.uniform(-3000, 3000), y := rng.uniform(-3000, 3000), x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)) for i in range(60)]
    targets = [(k, x := rng.uniform(0, 1000), y := rng.uniform(0, 1000), x + rng.uniform(-20, 20), y + rng.choice([0.0, 15.0])) for k in range(700)]
    box = lambda a, b: (F.least(a, b), F.greatest(a, b))
    (left, right), (bottom, top) = box("x1", "x2"), box("y1", "y2")
    own = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double").select("*", left.alias("l"), bottom.alias("b"), right.alias("r"), top.alias("t"))
    (left, right), (bottom, top) = box("sx1", "sx2"), box("sy1", "sy2")
    to = spark.createDataFrame(targets, "k long, sx1 double, sy1 double, sx2 double, sy2 double").select("*", left.alias("l2"), bottom.alias("b2"), right.alias("r2"), top.alias("t2"))
    columns = lambda names: tuple(F.col(c) for c in names.split())
    d = nearest.segment_gap(columns("x1 y1 x2 y2"), columns("sx1 sy1 sx2 sy2"))
    every = own.crossJoin(to).groupBy("id").agg(F.min(F.struct(d.alias("d"), "k")).alias("m"))
    want = {r.id: (r.m.d, r.m.k) for r in every.collect()}
    got = {r.id: (r.distance, r.k) for r in nearest.nearest(own, to, "id", "k", d, [("x1", "y1"), ("x2", "y2")]).collect()}
    assert got == want
    far = spark.createDataFrame([(7000.0, 0.0, 7300.0, 200.0, 5400.0, 0.0, 5410.0, 10.0)], "l double, b double, r double, t double, l2 double, b2 double, r2 double, t2 double")
    row = far.select(nearest.most_gap().alias("box"), nearest.most_gap("l", "b", "l", "b").alias("end"), nearest.least_gap().alias("least")).first()
    assert row.least == 1590 and row.end < 1591 and row.box > 1890
