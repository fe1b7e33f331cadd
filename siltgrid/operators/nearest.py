"""Nearest neighbours at any distance, between features of any number and extent.

The targets are summed up in a tree of cells: a leaf is a cell of targets by the middles of their boxes,
four cells make one of the next level, and each knows the box around what it holds. All sources start at
the same cells, few enough to be broadcast, and go down level by level: a cell is left when its box is
farther than some other cell's box can be at most, and the others are replaced by their cells below, found by
an equi-join on the cell. In the leaves the distance itself decides. So no source meets all targets,
however far it lies from them, the result is exact, and the number of levels is the logarithm of
the number of targets.

Targets with one and the same middle share a leaf and are all compared. Ties go to the smaller target key.
Sources or targets whose bounds are null, NaN or infinite take no part; a source without any target has no row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltgrid.functions.expressions import finite

from .stored import small_side, stored

#: Targets of a leaf on average, and the levels of the tree whose cells are few enough to start with (4^3).
LEAF, START, MOST_LEVELS = 8, 3, 24
#: What rounding may add to a distance: equal ones must not be told apart.
ROUNDING = 1 + 1e-12


def least_gap() -> Column:
    """Distance of a source's box (l, b, r, t) and a target's box (l2, b2, r2, t2), zero where they touch."""
    return F.hypot(F.greatest(F.lit(0.0), F.col("l2") - F.col("r"), F.col("l") - F.col("r2")), F.greatest(F.lit(0.0), F.col("b2") - F.col("t"), F.col("b") - F.col("t2")))


def most_gap(l: str = "l", b: str = "b", r: str = "r", t: str = "t") -> Column:  # noqa: E741
    """A distance that the nearest target in a box (l2, b2, r2, t2) does not exceed: some target touches each side of the box, at the far end at worst.

    Taken from the farthest place of the source's box. Far off it is hardly more than the least distance, where the box's far corner would be its width more.
    """
    x, y = F.greatest(F.col("r2") - F.col(l), F.col(r) - F.col("l2")), F.greatest(F.col("t2") - F.col(b), F.col(t) - F.col("b2"))
    to = lambda side, lo, hi: F.greatest(F.abs(F.col(side) - F.col(lo)), F.abs(F.col(side) - F.col(hi)))
    return F.least(*(F.hypot(to(side, l, r), y) for side in ("l2", "r2")), *(F.hypot(x, to(side, b, t)) for side in ("b2", "t2")))


def nearest(sources: DataFrame, targets: DataFrame, source_key: str, target_key: str, distance: Column, places: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(source_key, target_key, distance): the nearest target of each source.

    sources: boxes l, b, r, t and other columns; targets: boxes l2, b2, r2, t2 and other columns, of which `distance` is an expression.
    It must lie between the least and the greatest distance of the two boxes, and a target must touch all sides of its box. A source key may stand in many
    rows: the nearest of all counts. places: columns (x, y) of places on the source, such as a line's ends. No target is farther from the source than from
    them, which leaves fewer cells than the box, whose size would count in full.
    """
    ok = lambda df, names: df.filter(finite(F.col(names[0])) & finite(F.col(names[1])) & finite(F.col(names[2])) & finite(F.col(names[3])))
    # stored, as both readings must see the same numbers
    sources = stored(ok(sources, ("l", "b", "r", "t")).withColumn("_s", F.monotonically_increasing_id()), "sources")
    targets = ok(targets, ("l2", "b2", "r2", "t2")).withColumn("_x", (F.col("l2") + F.col("r2")) / 2).withColumn("_y", (F.col("b2") + F.col("t2")) / 2)
    span = targets.agg(F.count("*").alias("n"), F.min("_x").alias("x"), F.min("_y").alias("y"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("side")).first()
    levels = 0 if not span["n"] or not span["side"] else min(MOST_LEVELS, max(0, math.ceil(math.log(span["n"] / LEAF, 4))))
    start = min(levels, START)
    parts, side = 1 << levels, span["side"] or 1.0

    def place(v: str) -> Column:
        return F.least(F.floor((F.col(f"_{v}") - F.lit(span[v] or 0.0)) / F.lit(side) * parts), F.lit(parts - 1)).cast("long")

    leaves = targets.withColumn("_gx", place("x")).withColumn("_gy", place("y")).drop("_x", "_y")
    box = (F.min("l2").alias("l2"), F.min("b2").alias("b2"), F.max("r2").alias("r2"), F.max("t2").alias("t2"))
    above = lambda by: (F.shiftright("_gx", by).alias("_gx"), F.shiftright("_gy", by).alias("_gy"))
    cells = {levels: leaves.groupBy("_gx", "_gy").agg(*box)}
    for level in range(levels - 1, start - 1, -1):
        cells[level] = cells[level + 1].groupBy(*above(1)).agg(*box)

    own = list(dict.fromkeys(["_s", "l", "b", "r", "t", *(c for p in places for c in p)]))
    bounds = [most_gap(), *(most_gap(x, y, x, y) for x, y in places)]
    most = F.least(*bounds) if places else bounds[0]

    def near(met: DataFrame) -> DataFrame:
        return met.withColumn("_most", F.min(most).over(Window.partitionBy("_s"))).filter(least_gap() <= F.col("_most") * ROUNDING)

    def pruned(met: DataFrame) -> DataFrame:
        return near(met).select(*own, "_gx", "_gy")

    boxes = sources.select(*own)
    now = pruned(boxes.crossJoin(F.broadcast(cells[start])))  # at most 4^START cells
    for level in range(start + 1, levels + 1):
        below = cells[level].select(*(c.alias(n) for c, n in zip(above(1), ("_px", "_py"))), "_gx", "_gy", "l2", "b2", "r2", "t2")
        up = now.withColumnRenamed("_gx", "_px").withColumnRenamed("_gy", "_py")
        now = pruned(up.join(below, ["_px", "_py"]))
    # the boxes of single targets prune once more, before the rest of the sources' columns is joined
    met = near(now.join(leaves, ["_gx", "_gy"]))
    # by sorting: the windows have sorted the pairs, and files say little of what the sources take in memory
    met = met.drop(*own[1:], "_gx", "_gy", "_most").join(sources.hint("merge"), "_s")
    best = met.groupBy(source_key).agg(F.min(F.struct(distance.alias("distance"), F.col(target_key).alias("target"))).alias("m"))
    return best.select(source_key, F.col("m.target").alias(target_key), F.col("m.distance").alias("distance"))


def point_gap(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point and a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segment_gap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Distance of two segments (x1, y1, x2, y2), zero where they meet; either may be a point."""
    from .overlay import segments_meet

    ends = F.least(point_gap(a[0], a[1], *b), point_gap(a[2], a[3], *b), point_gap(b[0], b[1], *a), point_gap(b[2], b[3], *a))
    return F.when(segments_meet(*a, *b), 0.0).otherwise(ends)


def ring_segments(df: DataFrame, rings: str, keys: list[str]) -> DataFrame:
    """(keys, sx1, sy1, sx2, sy2): the edges of all rings."""
    from . import geometry

    each = df.select(*keys, F.explode(rings).alias("ring")).select(*keys, F.explode(geometry.edges(F.col("ring"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    return each.select(*keys, F.col("e.a.x").alias("sx1"), F.col("e.a.y").alias("sy1"), F.col("e.b.x").alias("sx2"), F.col("e.b.y").alias("sy2"))


def solid_cells(polygons: DataFrame, rings: str, size: float) -> DataFrame:
    """(gx, gy) of the grid cells that lie wholly inside one of the polygons, away from all its edges."""
    from . import geometry
    from .overlay import rings_bounds

    bounds = rings_bounds(F.col(rings))
    known = polygons.select(rings).filter(finite(bounds[0]) & finite(bounds[1]) & finite(bounds[2]) & finite(bounds[3])).distinct()
    cells = geometry.spread(known, *bounds, size)
    left, bottom = F.col("gx") * size, F.col("gy") * size

    def near(a: Column, b: Column) -> Column:
        # by boxes: a cell near a sloped edge counts as not solid, which loses nothing
        x = (F.least(a["x"], b["x"]) <= left + size) & (F.greatest(a["x"], b["x"]) >= left)
        return F.coalesce(x & (F.least(a["y"], b["y"]) <= bottom + size) & (F.greatest(a["y"], b["y"]) >= bottom), F.lit(True))

    crossed = F.exists(rings, lambda r: F.exists(F.coalesce(geometry.edges(r, near), F.array().cast("array<boolean>")), lambda hit: hit))
    held = F.size(F.filter(rings, lambda r: geometry.in_ring(left + size / 2, bottom + size / 2, r))) % 2 == 1
    return cells.filter(~crossed).filter(held).select("gx", "gy").distinct()


def distance_to_union(segments: DataFrame, polygons: DataFrame, key: str, rings: str, size: float, areas: DataFrame | None = None) -> DataFrame:
    """(key, distance): distance of features to the union of all polygons, zero where they meet, at any distance.

    segments: (key, x1, y1, x2, y2), any number for a feature; a point is a segment of no length. areas: (key, rings) of the features that
    are polygons, whose inside counts as well.

    Where many polygons overlap, most places lie deep inside some of them: cells of a fourth of the size that one polygon holds wholly settle the
    features that start there, and edges within them are inside the union, nearest to nothing outside. The rest is done with the edges that are left.
    Rings stand in a row for each of their cells, many times the size of their table, so they are joined by sorting and never broadcast.
    """
    from . import geometry

    box = lambda a, c: (F.least(a, c), F.greatest(a, c))
    cell = lambda v: F.floor(v / (size / 4)).cast("long")
    solid = small_side(stored(solid_cells(polygons, rings, size / 4), "solid"))
    segments = segments.filter(finite(F.col("x1")) & finite(F.col("y1")) & finite(F.col("x2")) & finite(F.col("y2")))
    starts = segments.select(key, F.col("x1").alias("x"), F.col("y1").alias("y"), cell(F.col("x1")).alias("gx"), cell(F.col("y1")).alias("gy")).withColumn("_p", F.monotonically_increasing_id())
    deep = starts.join(solid, ["gx", "gy"], "left_semi").select(key).distinct()
    left, right = box("x1", "x2")
    bottom, top = box("y1", "y2")
    own = segments.join(deep, key, "left_anti").select(key, "x1", "y1", "x2", "y2", left.alias("l"), bottom.alias("b"), right.alias("r"), top.alias("t"))
    left, right = box("sx1", "sx2")
    bottom, top = box("sy1", "sy2")
    met = geometry.spread(ring_segments(polygons, rings, []).distinct(), left, bottom, right, top, size / 4).join(solid, ["gx", "gy"], "left_anti")
    edges = met.select("sx1", "sy1", "sx2", "sy2").distinct().withColumn("edge", F.struct("sx1", "sy1", "sx2", "sy2"))
    to = edges.select("edge", "sx1", "sy1", "sx2", "sy2", left.alias("l2"), bottom.alias("b2"), right.alias("r2"), top.alias("t2"))
    columns = lambda names: tuple(F.col(c) for c in names)
    gap = segment_gap(columns(("x1", "y1", "x2", "y2")), columns(("sx1", "sy1", "sx2", "sy2")))
    far = nearest(own, stored(to, "edges"), key, "edge", gap, [("x1", "y1"), ("x2", "y2")]).select(key, "distance")

    def held(points: DataFrame, shapes: DataFrame, keep: str, but: DataFrame | None = None) -> DataFrame:
        # a point inside the outline and outside the holes, by the parity of all rings
        each = shapes.withColumn("_n", F.monotonically_increasing_id()).select("*", F.explode(rings).alias("ring")).drop(rings)
        return geometry.points_in_rings(points, each, "ring", size / 4, but, "merge").groupBy("_p", "_n", keep).count().filter("count % 2 = 1").select(keep)

    inside = held(starts.join(deep, key, "left_anti").drop("gx", "gy"), polygons.select(rings), key, solid)  # what starts in a solid cell is deep
    if areas is not None:
        first = lambda c: F.get(F.get(rings, F.lit(0)), F.lit(0))[c].alias(c)
        rest = areas.select(key, rings).join(deep, key, "left_anti")
        inside = inside.unionByName(held(polygons.select(first("x"), first("y")).withColumn("_p", F.monotonically_increasing_id()), rest, key))
    hit = inside.select(key).distinct().withColumn("_in", F.lit(True))
    rest = far.join(hit, key, "left").select(key, F.when(F.col("_in"), 0.0).otherwise(F.col("distance")).alias("distance"))
    return rest.unionByName(deep.withColumn("distance", F.lit(0.0)))
