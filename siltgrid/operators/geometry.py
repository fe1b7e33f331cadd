"""Planar geometry as column expressions: projection, clipping, lengths, areas, distances.

A line is an array of struct<x, y>. Segments are exploded to rows and meet boxes by equality on grid
cells, so no operator compares every line with every box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transverse Mercator on WGS 84, UTM: fixed values.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by a Krueger series of third order."""
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(6 * zone - 183)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(phi)
    # atanh(x) = ln((1 + x) / (1 - x)) / 2
    t = F.sinh(F.log((1 + s) / (1 - s)) / 2 - e * F.log((1 + e * s) / (1 - e * s)) / 2)
    xi, q = F.atan2(t, F.cos(lam)), F.sin(lam) / F.sqrt(1 + t * t)
    eta = F.log((1 + q) / (1 - q)) / 2
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * a * x, SCALE * a * y


def segments(df: DataFrame, line: str) -> DataFrame:
    """One row per segment: x1, y1, x2, y2 and its number; the line itself is dropped."""
    n = F.size(line)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(line, i.cast("int")).alias("a"), F.element_at(line, (i + 1).cast("int")).alias("b")))
    rest = [c for c in df.columns if c != line]
    return df.filter(n >= 2).select(*rest, F.posexplode(pairs).alias("segment", "p")).select(*rest, "segment", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))


def inside_box(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, right: Column, top: Column) -> tuple[Column, Column]:
    """The parameters at which a segment enters and leaves a box; it leaves before it enters where it misses the box."""
    def slab(a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        d = b - a
        p, q = (lo - a) / F.when(d != 0, d), (hi - a) / F.when(d != 0, d)
        within = (a >= lo) & (a <= hi)
        enter = F.when(d == 0, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(p, q))
        leave = F.when(d == 0, F.when(within, 1.0).otherwise(-1.0)).otherwise(F.greatest(p, q))
        return enter, leave

    ex, lx = slab(x1, x2, left, right)
    ey, ly = slab(y1, y2, bottom, top)
    return F.greatest(ex, ey, F.lit(0.0)), F.least(lx, ly, F.lit(1.0))


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Length of a segment inside a box."""
    enter, leave = inside_box(x1, y1, x2, y2, left, bottom, right, top)
    return F.greatest(leave - enter, F.lit(0.0)) * F.hypot(x2 - x1, y2 - y1)


def lengths_in_boxes(lines: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) with the boxes (l, b, r, t) that hold a part of them, and its length inside_m.

    Both meet in the cells of their boxes, whatever their extent; a pair counts in the cell of the place where the segment enters the
    box, which lies in the extent of both.
    """
    x1, y1, x2, y2, left, bottom, right, top = (F.col(c) for c in ("x1", "y1", "x2", "y2", "l", "b", "r", "t"))
    s = spread(lines, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2), size)
    enter, leave = inside_box(x1, y1, x2, y2, left, bottom, right, top)
    within = lambda v, a, b, lo, hi: F.greatest(lo, F.least(a, b), F.least(hi, F.greatest(a, b), v))
    x, y = within(x1 + enter * (x2 - x1), x1, x2, left, right), within(y1 + enter * (y2 - y1), y1, y2, bottom, top)
    here = (F.floor(x / size) == F.col("gx")) & (F.floor(y / size) == F.col("gy"))
    met = s.join(spread(boxes, left, bottom, right, top, size), ["gx", "gy"]).filter((leave > enter) & here).drop("gx", "gy")
    return met.withColumn("inside_m", clipped_length(x1, y1, x2, y2, left, bottom, right, top)).filter("inside_m > 0")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def edges(ring: Column, f) -> Column:
    """f(a, b) of each edge of a closed ring, as an array; empty for fewer than two points."""
    n = F.size(ring)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: f(F.get(ring, i - 1), F.get(ring, i)))
    return F.when(n >= 2, every)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, by parity of the edges to its right; left and lower borders belong to it."""
    def crosses(a: Column, b: Column) -> Column:
        up = b["y"] - a["y"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(up != 0, up) + a["x"]
        return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))

    return F.size(F.filter(edges(ring, crosses), lambda hit: hit)) % 2 == 1


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Left, bottom, right, top."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def spread(df: DataFrame, left: Column, bottom: Column, right: Column, top: Column, size: float) -> DataFrame:
    """A row for each grid cell (gx, gy) that the box of a row meets."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return df.select("*", F.explode(span(left, right)).alias("gx")).select("*", F.explode(span(bottom, top)).alias("gy"))


def points_in_rings(points: DataFrame, rings: DataFrame, ring: str, size: float, but: DataFrame | None = None, join: str | None = None) -> DataFrame:
    """Points (x, y) with the rings that hold them; both meet in grid cells, so each pair is tested once.

    but: cells (gx, gy) without points. join: a join hint where rings are many, as Spark does not see that they stand in a row for each cell.
    """
    cells = spread(rings, *bounds(F.col(ring)), size)
    if but is not None:
        cells = cells.join(but, ["gx", "gy"], "left_anti")
    if join is not None:
        cells = cells.hint(join)
    own = points.withColumn("gx", F.floor(F.col("x") / size).cast("long")).withColumn("gy", F.floor(F.col("y") / size).cast("long"))
    return own.join(cells, ["gx", "gy"]).filter(in_ring(F.col("x"), F.col("y"), F.col(ring))).drop("gx", "gy")


def clip_ring(df: DataFrame, ring: str, left: str, bottom: str, right: str, top: str) -> DataFrame:
    """The ring cut to a box, side after side; empty where they don't meet."""
    sides = (("x", left, 1), ("x", right, -1), ("y", bottom, 1), ("y", top, -1))
    for axis, edge, sign in sides:
        limit = F.col(edge)

        def cut(a: Column, b: Column, axis=axis, limit=limit, sign=sign) -> Column:
            in_a, in_b = (a[axis] - limit) * sign >= 0, (b[axis] - limit) * sign >= 0
            run = b[axis] - a[axis]
            t = (limit - a[axis]) / F.when(run != 0, run)
            other = "y" if axis == "x" else "x"
            moved = a[other] + t * (b[other] - a[other])
            met = point(limit, moved) if axis == "x" else point(moved, limit)
            return F.when(in_a & in_b, F.array(b)).when(in_a, F.array(met)).when(in_b, F.array(met, b)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        df = df.withColumn(ring, F.coalesce(F.flatten(edges(F.col(ring), cut)), F.array().cast("array<struct<x:double,y:double>>")))
        df = df.withColumn(ring, F.concat(F.col(ring), F.slice(F.col(ring), 1, 1)))
    return df


def touched_cells(size: float) -> Column:
    """Grid cells (gx, gy) that a segment of columns x1, y1, x2, y2 passes through, column by column."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    run = x2 - x1

    def column(gx: Column) -> Column:
        def at(x: Column) -> Column:
            return y1 + (x - x1) / F.when(run != 0, run) * (y2 - y1)

        a, b = at(F.greatest(low, gx * size)), at(F.least(high, (gx + 1) * size))
        first, last = F.coalesce(F.least(a, b), F.least(y1, y2)), F.coalesce(F.greatest(a, b), F.greatest(y1, y2))
        first = F.when(run == 0, F.least(y1, y2)).otherwise(first)
        last = F.when(run == 0, F.greatest(y1, y2)).otherwise(last)
        return F.transform(F.sequence(F.floor(first / size).cast("long"), F.floor(last / size).cast("long")), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")), column))


def box_distance(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Distance of a point to a box, zero inside."""
    return F.hypot(F.greatest(left - x, F.lit(0.0), x - right), F.greatest(bottom - y, F.lit(0.0), y - top))


def length(line: str) -> Column:
    return F.aggregate(F.sequence(F.lit(2), F.size(line)), F.lit(0.0), lambda s, i: s + F.hypot(F.element_at(line, i.cast("int"))["x"] - F.element_at(line, (i - 1).cast("int"))["x"], F.element_at(line, i.cast("int"))["y"] - F.element_at(line, (i - 1).cast("int"))["y"]))


def ring_area(ring: str) -> Column:
    """Shoelace area of a closed ring."""
    def term(i: Column) -> Column:
        a, b = F.element_at(ring, i.cast("int")), F.element_at(ring, (i + 1).cast("int"))
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.abs(F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + term(i))) / 2


def rasterize_centres(rings: DataFrame, key: str | list[str], ring: str, cell: float) -> DataFrame:
    """(key or keys, gx, gy) of the grid cells whose centres lie inside a ring, by parity of edge crossings.

    Each edge sends one row for every grid line of centres that it crosses; crossings are paired in order
    along that line, so the cost follows the outline's length and the area filled.
    """
    keys = [key] if isinstance(key, str) else key
    e = segments(rings.select(*keys, ring), ring)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(lo / cell - 0.5), F.ceil(hi / cell - 0.5) - 1
    rows = e.filter(last >= first).withColumn("gy", F.explode(F.sequence(first, last)))
    y = (F.col("gy") + 0.5) * cell
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    lines = rows.groupBy(*keys, "gy").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    spans = lines.select(*keys, "gy", F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))).alias("s"))
    a, b = F.ceil(F.col("s.a") / cell - 0.5), F.ceil(F.col("s.b") / cell - 0.5) - 1
    return spans.filter(b >= a).select(*keys, F.explode(F.sequence(a, b)).alias("gx"), "gy").distinct()
