"""Polygons out of masks: outlines and holes of four-connected zones of pixels.

Each side of a pixel that parts it from another zone is an edge with the zone to its left: outlines run
counter-clockwise, holes clockwise. The edge that follows is known from the two pixels ahead, so each edge points to
one other edge and the edges of a zone fall into cycles. Cycles are found by pointer jumping: in each round an
edge looks twice as far along its ring for the least edge, which names the ring, and for how far it is. Rounds
end when nothing changes, after the logarithm of the longest ring; each is one equi-join of stored tables. Scenes of at most
raster.WHOLE pixels a side are a task's work instead: their pixels are sent once, by scene, and the rounds are those of arrays. Where two
pixels of a zone touch at a corner only, the rings stay apart there.

Places are corners of pixels: x = c to the right and y = -r upwards, in pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import WHOLE
from .stored import done, stored

#: By heading (east along the lower side, north, west, south): rows and columns to the pixel ahead and to the one right of it.
AHEAD, RIGHT = ((0, 1), (-1, 0), (0, -1), (1, 0)), ((1, 1), (-1, 1), (-1, -1), (1, -1))
#: By heading: where the side starts, in pixels from the pixel's column and (upwards) from its row's upper border.
STARTS = ((0, -1), (1, -1), (1, 0), (0, 0))


def edge_number(r: Column, c: Column, heading: Column) -> Column:
    """One number for each side of each pixel of a scene of less than 2^29 rows and 2^31 columns."""
    return F.shiftleft(r.cast("long"), 33) + F.shiftleft(c.cast("long"), 2) + heading


def zone_edges(zones: DataFrame, scene: str = "scene", zone: str = "component") -> DataFrame:
    """(scene, zone, r, c, heading, edge, next) of the sides of pixels (scene, r, c, zone) where their zone ends."""
    row, column = Window.partitionBy(scene, "r").orderBy("c"), Window.partitionBy(scene, "c").orderBy("r")

    def beside(step, values: str, order: str, by: int, w) -> Column:
        return F.when(step(order).over(w) == F.col(order) + by, step(values).over(w))

    z = zones.select(scene, "r", "c", F.col(zone).alias("z"))
    z = z.withColumn("w", beside(F.lag, "z", "c", -1, row)).withColumn("e", beside(F.lead, "z", "c", 1, row))
    # the pixel right of the one ahead is asked for through the one ahead, which is the zone's where it matters
    z = z.withColumn("n", beside(F.lag, "z", "r", -1, column)).withColumn("s", beside(F.lead, "z", "r", 1, column))
    z = z.withColumn("ne", beside(F.lag, "e", "r", -1, column)).withColumn("sw", beside(F.lead, "w", "r", 1, column))
    z = z.withColumn("se", beside(F.lead, "s", "c", 1, row)).withColumn("nw", beside(F.lag, "n", "c", -1, row))
    same = lambda name: F.coalesce(F.col(name) == F.col("z"), F.lit(False))
    outer, ahead, right = ("s", "e", "n", "w"), ("e", "n", "w", "s"), ("se", "ne", "nw", "sw")
    sides = []
    for k in range(4):
        (ar, ac), (rr, rc) = AHEAD[k], RIGHT[k]
        turn = lambda r, c, h: edge_number(F.col("r") + r, F.col("c") + c, F.lit(h))
        follow = F.when(~same(ahead[k]), turn(0, 0, (k + 1) % 4)).when(same(right[k]), turn(rr, rc, (k + 3) % 4)).otherwise(turn(ar, ac, k))
        sides.append(F.when(~same(outer[k]), F.struct(F.lit(k).alias("heading"), turn(0, 0, k).alias("edge"), follow.alias("next"))))
    each = z.select(scene, F.col("z").alias(zone), "r", "c", F.explode(F.array(*sides)).alias("s"))
    return each.filter("s is not null").select(scene, zone, "r", "c", "s.*")


def rings_of(edges: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, edge, ring, ahead): the least edge of each edge's ring and how many steps ahead it is. edges is read again and again."""
    now, far, changed = stored(edges.select(scene, "edge", F.col("next").alias("to"), F.col("edge").alias("ring"), F.lit(0).cast("long").alias("ahead")), "rings"), 1, True
    while changed:
        other = now.select(scene, F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"), (F.col("ahead") + far).alias("ahead2")).hint("merge")
        met = now.join(other, [scene, "to"]).select(
            scene, "edge", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), F.when(F.col("ring2") < F.col("ring"), F.col("ahead2")).otherwise(F.col("ahead")).alias("ahead"), (F.col("ring2") < F.col("ring")).alias("found")
        )
        new = stored(met, "rings")
        changed = not new.filter("found").isEmpty()
        done(now)
        now, far = new, 2 * far
    return now.select(scene, "edge", "ring", "ahead")


def least_ahead(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number the least one on its cycle, and how many steps ahead it is."""
    ring, ahead, far = np.arange(len(to)), np.zeros(len(to), np.int64), 1
    while True:
        found = ring[to] < ring
        if not found.any():
            return ring, ahead
        ring, ahead = np.where(found, ring[to], ring), np.where(found, ahead[to] + far, ahead)
        to, far = to[to], 2 * far


#: Edges that are worked on together, at least where a scene has as many.
EDGES = 1 << 20


def whole_rings(edges: DataFrame, scene: str, zone: str) -> DataFrame:
    """What trace returns, of scenes that a task can hold: only rings and their corners leave it."""
    rows = edges.groupBy(scene).agg(F.collect_list(F.struct(zone, "r", "c", "heading", "edge", "next")).alias("e"))
    kinds = dict(edges.dtypes)
    place = np.array(STARTS, np.int64)

    def rings(names: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        flat, which = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        r, c, heading, edge, follow = (flat.field(i).to_numpy().astype(np.int64) for i in range(1, 6))
        known = np.unique(edge)
        key = which * len(known) + np.searchsorted(known, edge)
        order = np.argsort(key)
        to = np.searchsorted(key[order], (which * len(known) + np.searchsorted(known, follow))[order])
        ring, ahead = least_ahead(to)
        r, c, heading, follow = r[order], c[order], heading[order], follow[order]
        (x1, y1), (x2, y2) = ((c + place[h, 0], place[h, 1] - r) for h in (heading, (heading + 1) % 4))
        # steps from the least edge; the side's end is a corner if the next one has another heading
        n = np.bincount(ring, minlength=len(ring))
        turn = np.lexsort(((n[ring] - ahead) % n[ring], ring))
        turn = turn[(follow & 3)[turn] != heading[turn]]
        first = np.flatnonzero(n)
        cross = np.zeros(len(ring), np.int64)
        np.add.at(cross, ring, x1 * y2 - x2 * y1)
        corners = np.bincount(ring[turn], minlength=len(ring))[first]
        ends = np.cumsum(corners)
        closed = np.insert(turn, ends, turn[ends - corners])
        points = pa.StructArray.from_arrays([pa.array(x2[closed].astype(np.float64)), pa.array(y2[closed].astype(np.float64))], ["x", "y"])
        offsets = np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)
        at = pa.array(order[first])
        columns = [names.take(pa.array(which[order][first])), flat.field(0).take(at), pa.array(edge[order][first]), pa.array(corners.astype(np.int32)), pa.array(cross[first] / 2), pa.array(n[first]), pa.ListArray.from_arrays(pa.array(offsets), points)]
        return pa.RecordBatch.from_arrays(columns, [scene, zone, "ring", "corners", "signed_area", "sides", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(batch.column(1).value_lengths().to_numpy()) // EDGES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    yield rings(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))

    return rows.mapInArrow(run, f"`{scene}` {kinds[scene]}, `{zone}` {kinds[zone]}, ring long, corners int, signed_area double, sides long, points array<struct<x:double,y:double>>")


def trace(zones: DataFrame, scene: str = "scene", zone: str = "component") -> DataFrame:
    """(scene, zone, ring, corners, signed_area, sides, points): each ring of each zone, its corners as a closed ring of points (x, y).

    The signed area, in pixels, is that of the edges: above zero for the outline, below for holes.
    """
    zones = stored(zones.select(scene, "r", "c", zone), "zones")
    side = zones.agg(F.greatest(F.max("r"), F.max("c")).alias("side")).first()["side"]
    if side is None or side < WHOLE:
        # all windows over a scene's rows and columns find them where the scene is, and so does what groups its rings later
        return whole_rings(zone_edges(zones.repartition(scene), scene, zone), scene, zone).repartition(scene)
    edges = stored(zone_edges(zones, scene, zone), "edges")
    rows = edges.join(rings_of(edges, scene).hint("merge"), [scene, "edge"]).withColumn("n", F.count("*").over(Window.partitionBy(scene, "ring")))
    x = lambda step: F.col("c") + F.element_at(F.array(*(F.lit(STARTS[k][0]) for k in step)), F.col("heading") + 1)
    y = lambda step: -F.col("r") + F.element_at(F.array(*(F.lit(STARTS[k][1]) for k in step)), F.col("heading") + 1)
    start, end = (0, 1, 2, 3), (1, 2, 3, 0)
    # steps from the least edge; the side's end is a corner if the next one has another heading
    at = F.pmod(F.col("n") - F.col("ahead"), F.col("n"))
    corner = F.when(F.col("next").bitwiseAND(3) != F.col("heading"), F.struct(at.alias("at"), x(end).cast("double").alias("x"), y(end).cast("double").alias("y")))
    cross = (x(start) * y(end) - x(end) * y(start)).cast("long")
    out = rows.groupBy(scene, zone, "ring").agg((F.sum(cross) / 2).alias("signed_area"), F.count("*").alias("sides"), F.array_sort(F.collect_list(corner)).alias("ordered"))
    points = F.transform("ordered", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return out.select(scene, zone, "ring", F.size("ordered").alias("corners"), "signed_area", "sides", F.concat(points, F.slice(points, 1, 1)).alias("points"))


def zone_polygons(zones: DataFrame, scene: str = "scene", zone: str = "component") -> DataFrame:
    """(scene, zone, rings): polygons with the outline first and the holes after it."""
    rings = trace(zones, scene, zone)
    ordered = F.array_sort(F.collect_list(F.struct((F.col("signed_area") < 0).alias("hole"), "ring", "points")))
    return rings.groupBy(scene, zone).agg(F.transform(ordered, lambda x: x["points"]).alias("rings"))
