"""Map algebra on pixel tables (scene, r, c, ...).

Focal sums run in windows over tiles that know a margin of their neighbours; other neighbourhood operators
replicate each pixel to the few pixels that need it. Nothing here pairs whole scenes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import done, stored

SCENE = ("scene",)
#: Pixels of a tile's side, for operators that look a few pixels around, and columns of a block of a row.
TILE, BLOCK = 256, 4096


def offsets(radius: int, cross: bool = False) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if not cross or a == 0 or b == 0]


def neighbours(df: DataFrame, steps: Sequence[tuple[int, int]], columns: Sequence[str], scene: str = "scene") -> DataFrame:
    """Each pixel's columns, sent to the pixels for which it is a neighbour: (scene, r, c, dr, dc, columns)."""
    sent = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps)))
    return df.select(scene, "r", "c", *columns, sent.alias("s")).select(scene, (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), "s.dr", "s.dc", *columns)


def focal(df: DataFrame, value: str, radius: int, height: int, width: int, valid: str | None = None, scene: str = "scene", keep: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(scene, r, c, mean, mean_sq, n) over (2 radius + 1)^2 pixels, with columns to keep: edge pixels are repeated outwards, invalid ones left out.

    Pixels are dealt to tiles, those near a border to the next tile too, and nothing else is copied: one exchange of 1 + 4 radius / tile
    rows a pixel. In a tile the sums run along rows, then along columns. Places around which nothing is valid have no row.
    """
    home = lambda at: F.floor(at / tile)
    near = lambda at: F.explode(F.sequence(home(F.col(at) - radius), home(F.col(at) + radius)))
    x = F.col(value).cast("double")
    ok = F.col(valid) & x.isNotNull() if valid else x.isNotNull()
    rows = df.select(scene, "r", "c", *keep, F.when(ok, x).otherwise(0.0).alias("_1"), F.when(ok, x * x).otherwise(0.0).alias("_2"), ok.cast("long").alias("_n"))
    rows = rows.withColumn("_tr", near("r")).withColumn("_tc", near("c")).repartition(scene, "_tr", "_tc")

    def along(rows: DataFrame, line: str, at: str, size: int) -> DataFrame:
        w = Window.partitionBy(scene, "_tr", "_tc", line).orderBy(at).rangeBetween(-radius, radius)
        first, last = F.min(at).over(w), F.max(at).over(w)
        # beyond an edge its pixel stands again and again, as often as the window reaches out
        before = F.when(first == 0, F.greatest(radius - F.col(at), F.lit(0))).otherwise(0)
        after = F.when(last == size - 1, F.greatest(F.col(at) + radius - (size - 1), F.lit(0))).otherwise(0)
        total = lambda c: F.sum(c).over(w) + before * F.first(c).over(w) + after * F.last(c).over(w)
        return rows.select(scene, "r", "c", *keep, "_tr", "_tc", *(total(c).alias(c) for c in ("_1", "_2", "_n")))

    out = along(along(rows, "r", "c", width), "c", "r", height)
    own = (home(F.col("r")) == F.col("_tr")) & (home(F.col("c")) == F.col("_tc")) & (F.col("_n") > 0)
    return out.filter(own).select(scene, "r", "c", *keep, (F.col("_1") / F.col("_n")).alias("mean"), (F.col("_2") / F.col("_n")).alias("mean_sq"), F.col("_n").alias("n"))


def local_std(moments: DataFrame) -> Column:
    return F.sqrt(F.greatest(F.col("mean_sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))


def lee(df: DataFrame, value: str, radius: int, height: int, width: int, scene: str = "scene") -> DataFrame:
    """Speckle filter: mean + v / (v + median v) * (x - mean), v being the local variance and the median the scene's."""
    m = focal(df, value, radius, height, width, scene=scene, keep=[value]).withColumn("var", F.greatest(F.col("mean_sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    noise = m.groupBy(scene).agg(F.percentile("var", F.lit(0.5)).alias("noise"))
    w = F.when(F.col("var") + F.col("noise") > 0, F.col("var") / (F.col("var") + F.col("noise"))).otherwise(0.0)
    return m.join(noise, scene).select(scene, "r", "c", (F.col("mean") + w * (F.col(value) - F.col("mean"))).alias("filtered"))


def slope(df: DataFrame, value: str, cell: float, scene: str = "scene") -> DataFrame:
    """Gradients (central inside, one-sided at edges) and slope in degrees."""
    def along(line: str, order: str) -> Column:
        w = Window.partitionBy(scene, line).orderBy(order)
        back, on, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(back.isNull(), on - here).when(on.isNull(), here - back).otherwise((on - back) / 2) / cell

    out = df.select(scene, "r", "c", along("c", "r").alias("dr"), along("r", "c").alias("dc"))
    return out.withColumn("slope", F.degrees(F.atan(F.hypot("dr", "dc"))))


def erode(df: DataFrame, mask: str, scene: str = "scene") -> DataFrame:
    """Binary erosion by the cross of four neighbours, outside counting as false; edge is what it takes away."""
    by_row, by_col = Window.partitionBy(scene, "r").orderBy("c"), Window.partitionBy(scene, "c").orderBy("r")
    m = F.col(mask)
    kept = m
    for w in (by_row, by_col):
        kept = kept & F.coalesce(F.lag(mask).over(w), F.lit(False)) & F.coalesce(F.lead(mask).over(w), F.lit(False))
    return df.select(scene, "r", "c", m.alias("mask"), kept.alias("eroded"), (m & ~kept).alias("edge"))


def envelope(at: list[int], height: list[int]) -> tuple[list[int], list[float]]:
    """Of parabolas height[i]^2 + (x - at[i])^2, by rising at: the numbers of those that are least somewhere, and from where on each is."""
    kept: list[int] = []
    since: list[float] = []
    for i, (x, g) in enumerate(zip(at, height)):
        top = g * g + x * x
        start = -math.inf
        while kept:
            j = kept[-1]
            start = (top - height[j] * height[j] - at[j] * at[j]) / (2 * (x - at[j]))
            if start > since[-1]:
                break
            kept.pop()
            since.pop()
            start = -math.inf
        kept.append(i)
        since.append(start)
    return kept, since


def lowest(sites: list[dict]) -> tuple[list[int], list[int]]:
    """Columns in order, and the least g of each."""
    best: dict[int, int] = {}
    for x in sites:
        best[x["c"]] = min(best.get(x["c"], x["g"]), x["g"])
    at = sorted(best)
    return at, [best[c] for c in at]


def _envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a row: the true pixels' parabolas that are least somewhere."""
    for batch in batches:
        rows = []
        for sites in batch.column(4).to_pylist():
            at, height = lowest(sites)
            rows.append([{"c": at[i], "g": height[i]} for i in envelope(at, height)[0]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, batch.column(4).type), batch.column(5)], ["scene", "r", "block", "span", "sites", "cs"])


def _least_squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least parabola at each column of a block, by one scan of the envelope."""
    for batch in batches:
        which, columns, found = [], [], []
        for i, (sites, cs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            at, height = lowest(sites)
            kept, since = envelope(at, height)
            cs.sort()
            if kept:
                n = np.searchsorted(np.array(since), np.array(cs), side="right") - 1
                x = np.array([at[j] for j in kept], np.int64)[n]
                g = np.array([height[j] for j in kept], np.int64)[n]
                found.append(np.sqrt(((np.array(cs) - x) ** 2 + g * g).astype(np.float64)))
            else:
                found.append(np.full(len(cs), np.inf))
            which += [i] * len(cs)
            columns += cs
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(columns, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["scene", "r", "c", "distance"])


def distance(df: DataFrame, mask: str, cell: float = 1.0, scene: str = "scene", block: int | None = None) -> DataFrame:
    """Exact Euclidean distance of each pixel to the nearest true pixel of its scene; infinite where there is none.

    First the distance g within the column, by the last true row above and the first below. Along a row the answer is the lower envelope
    of the parabolas g^2 + (x - c)^2, built in one scan, so in time in proportion to the width. A row is cut into blocks of columns: each
    keeps the parabolas of its own envelope, and sends those on that may be least in another block, which is known from the lowest
    parabola of each block. So a row of any width is worked on by many tasks, and a task holds one block and what reaches it.
    """
    block = block or BLOCK
    kind = df.schema[scene].dataType.simpleString()
    up = Window.partitionBy(scene, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(scene, "c").orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    hit = F.when(F.col(mask), F.col("r"))
    g = df.select(F.col(scene).alias("scene"), "r", "c", F.least(F.col("r") - F.last(hit, ignorenulls=True).over(up), F.first(hit, ignorenulls=True).over(down) - F.col("r")).alias("g"))
    site = F.when(F.col("g").isNotNull(), F.struct(F.col("c").cast("long").alias("c"), F.col("g").cast("long").alias("g")))
    span = F.struct(F.min("c").cast("long").alias("a"), F.max("c").cast("long").alias("b"), F.min_by(site, "g").alias("low"))
    blocks = g.groupBy("scene", "r", F.floor(F.col("c") / block).alias("block")).agg(span.alias("span"), F.collect_list(site).alias("sites"), F.collect_list(F.col("c").cast("long")).alias("cs"))
    parts = "array<struct<c: long, g: long>>"
    lows = "struct<a: long, b: long, low: struct<c: long, g: long>>"
    own = blocks.mapInArrow(_envelopes, f"scene {kind}, r int, block long, span {lows}, sites {parts}, cs array<long>")
    others = own.withColumn("spans", F.collect_list(F.struct("block", "span")).over(Window.partitionBy("scene", "r")))
    square = lambda v: v * v

    def most(to: Column) -> Column:
        """The square that no column of a block exceeds: from the lowest parabolas of all blocks."""
        reach = lambda s: F.when(s["span"]["low"].isNotNull(), square(s["span"]["low"]["g"]) + square(F.greatest(F.abs(to["a"] - s["span"]["low"]["c"]), F.abs(to["b"] - s["span"]["low"]["c"]))))
        return F.array_min(F.transform("spans", reach))

    sent = others.select("scene", "r", F.col("block").alias("of"), "sites", "cs", F.explode(F.transform("spans", lambda s: F.struct(s["block"].alias("block"), s["span"].alias("to"), most(s["span"]).alias("most")))).alias("t"))
    gap = lambda x: F.greatest(F.lit(0).cast("long"), F.col("t.to.a") - x["c"], x["c"] - F.col("t.to.b"))
    here = F.col("of") == F.col("t.block")
    useful = F.filter("sites", lambda x: here | (square(x["g"]) + square(gap(x)) <= F.col("t.most")))
    sent = sent.select("scene", "r", F.col("t.block").alias("block"), useful.alias("sites"), F.when(here, F.col("cs")).alias("cs")).filter((F.size("sites") > 0) | F.col("cs").isNotNull())
    met = sent.groupBy("scene", "r", "block").agg(F.flatten(F.collect_list("sites")).alias("sites"), F.first("cs", ignorenulls=True).alias("cs")).drop("block")
    out = met.mapInArrow(_least_squares, f"scene {kind}, r int, c int, distance double")
    return out.select(F.col("scene").alias(scene), "r", "c", (F.col("distance") * cell).alias("distance"))


def boundary_edges(df: DataFrame, mask: str, valid: str | None = None, scene: str = "scene") -> DataFrame:
    """(scene, r, c, edge): what erosion takes from a mask, where it is valid."""
    e = erode(df, mask, scene)
    if valid is None:
        return e.select(scene, "r", "c", "edge")
    return e.join(df.select(scene, "r", "c", F.col(valid).alias("_ok")), [scene, "r", "c"]).select(scene, "r", "c", (F.col("edge") & F.col("_ok")).alias("edge"))


def boundary_f1(df: DataFrame, pred: str, ref: str, tolerances: Sequence[int] = (1, 2), valid: str | None = None, scene: str = "scene") -> DataFrame:
    """(scene, pred_edge, ref_edge, boundary_f1_1px, ...): the harmonic mean of the shares of either edge within so many pixels of the other.

    Every scene has a row; one without an edge on either side scores 0.
    """
    edges = {m: boundary_edges(df, m, valid, scene).filter("edge").select(scene, "r", "c") for m in (pred, ref)}
    out = df.select(scene).distinct()
    for own, other, name in ((pred, ref, "pred"), (ref, pred, "ref")):
        side = edges[own]
        for t in tolerances:
            steps = [s for s in offsets(t) if s[0] ** 2 + s[1] ** 2 <= t * t]
            reach = neighbours(edges[other], steps, [], scene).select(scene, "r", "c").distinct().withColumn(f"near{t}", F.lit(True))
            side = side.join(reach, [scene, "r", "c"], "left")
        out = out.join(side.groupBy(scene).agg(F.count("*").alias(f"{name}_edge"), *(F.count(f"near{t}").alias(f"{name}_hit{t}") for t in tolerances)), scene, "left")
    out = out.fillna(0, [c for c in out.columns if c != scene])
    share = lambda name, t: F.when(F.col(f"{name}_edge") > 0, F.col(f"{name}_hit{t}") / F.when(F.col(f"{name}_edge") > 0, F.col(f"{name}_edge"))).otherwise(0.0)

    def score(t: int) -> Column:
        p, r = share("pred", t), share("ref", t)
        return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0).alias(f"boundary_f1_{t}px")

    return out.select(scene, "pred_edge", "ref_edge", *(score(t) for t in tolerances))


def boundary_distances(df: DataFrame, pred: str, ref: str, valid: str | None = None, scene: str = "scene") -> DataFrame:
    """(scene, pred_edge, ref_edge, median_px, p95_px, most_px) of the distances from each edge to the other, both ways.

    Every scene has a row; where one of the edges is empty the distances are infinite.
    """
    edge = {m: boundary_edges(df, m, valid, scene) for m in (pred, ref)}
    sides = []
    for own, other in ((pred, ref), (ref, pred)):
        far = distance(edge[other], "edge", scene=scene)
        sides.append(edge[own].filter("edge").join(far, [scene, "r", "c"]).select(scene, F.col("distance").alias("d"), F.lit(own == pred).alias("first")))
    both = sides[0].unionByName(sides[1])
    counts = both.groupBy(scene).agg(F.count_if("first").alias("pred_edge"), F.count_if(~F.col("first")).alias("ref_edge"), F.percentile("d", F.lit(0.5)).alias("median_px"), F.percentile("d", F.lit(0.95)).alias("p95_px"), F.max("d").alias("most_px"))
    out = df.select(scene).distinct().join(counts, scene, "left").fillna(0, ["pred_edge", "ref_edge"])
    measured = (F.col("pred_edge") > 0) & (F.col("ref_edge") > 0)
    return out.select(scene, "pred_edge", "ref_edge", *(F.when(measured, F.col(c)).otherwise(float("inf")).alias(c) for c in ("median_px", "p95_px", "most_px")))


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers below n that each is connected to by links a-b.

    The greater of two linked roots is hung below the lesser and the trees are flattened, until all links lie within a
    tree: a few passes, however long the paths are.
    """
    root = np.arange(n)
    while len(a):
        low, top = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, top, low)
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def label_pixels(scene: np.ndarray, r: np.ndarray, c: np.ndarray, width: np.ndarray, eight: bool) -> np.ndarray:
    """Component of each true pixel (scene number, r, c), named by its least row-major place; neighbours are found by sorted places."""
    r, c = r.astype(np.int64), c.astype(np.int64)
    high, wide = int(r.max()) + 2, int(c.max()) + 2
    # a free column parts the rows and a free row the scenes
    spot, first, back = np.unique((scene.astype(np.int64) * high + r) * wide + c + 1, return_index=True, return_inverse=True)
    ends = []
    for step in (1, wide - 1, wide, wide + 1) if eight else (1, wide):
        at = np.searchsorted(spot, spot + step)
        at[at == len(spot)] = 0
        hit = np.flatnonzero(spot[at] == spot + step)
        ends.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    place = (r * width[scene] + c)[first]
    return place[least_roots(len(spot), a, b)][back]


#: Scenes of up to so many pixels a side are labelled in one row each; larger ones in tiles of this side.
WHOLE = 1024


def components(df: DataFrame, mask: str, eight: bool = True, scene: str = "scene", tile: int | None = None) -> DataFrame:
    """(scene, r, c, component) of true pixels, connected over eight or four neighbours; a component is named by its least row-major
    place.

    Scenes of at most WHOLE pixels a side are a row each. Larger ones (or all, with a tile size) are labelled tile by tile, and labels
    that touch over the tiles' borders are linked: their least label is found by rounds of joins (linked_roots), so a scene's
    links may be more than a task holds.
    """
    kind = df.schema[scene].dataType.simpleString()
    wide = df.groupBy(scene).agg((F.max("c") + 1).cast("int").alias("width"))
    if tile is None:
        side = df.agg(F.greatest(F.max("r"), F.max("c")).alias("side")).first()["side"]
        tile = WHOLE if side is not None and side >= WHOLE else None
    if tile is None:
        rows = df.groupBy(scene).agg((F.max("c") + 1).cast("int").alias("width"), F.collect_list(F.when(F.col(mask), F.struct("r", "c"))).alias("on"))
        return rows.mapInArrow(labels_of_rows(scene, eight), f"{scene} {kind}, r int, c int, component long")
    on = df.filter(mask).select(scene, "r", "c", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")).join(wide.hint("merge"), scene)
    rows = on.groupBy(scene, "tr", "tc").agg(F.first("width").alias("width"), F.collect_list(F.struct("r", "c")).alias("on")).drop("tr", "tc")
    local = stored(rows.mapInArrow(labels_of_rows(scene, eight), f"{scene} {kind}, r int, c int, component long"), "labels")
    edge = local.filter((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)) if eight or 0 in (a, b)))
    onward = edge.withColumn("s", F.explode(steps)).select(scene, (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("component").alias("other"))
    links = onward.join(edge.hint("merge"), [scene, "r", "c"]).filter("other <> component").select(scene, F.col("component").alias("a"), F.col("other").alias("b"))
    named = linked_roots(links, scene).withColumnRenamed("node", "component")
    return local.join(named.hint("merge"), [scene, "component"], "left").select(scene, "r", "c", F.coalesce("root", "component").alias("component"))


def linked_roots(links: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, node, root) of every node with a link (scene, a, b): the least node that it is connected to.

    Each node points to a node of its component that is not greater. In a round the greater of what two linked nodes point to is hung
    below the lesser, and pointers are followed twice; it ends when linked nodes point to the same, which is then the least. Links
    and pointers stay in stored tables. Joins are by sorting: the files of such tables are far smaller than their rows, so Spark would take them
    for small ones and send them whole through the driver.
    """
    links = stored(links.select(scene, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    nodes = links.select(scene, F.explode(F.array("a", "b")).alias("node")).distinct()
    now = stored(nodes.withColumn("root", F.col("node")), "roots")
    at = lambda table, node, root: table.select(scene, F.col("node").alias(node), F.col("root").alias(root)).hint("merge")
    while True:
        apart = links.join(at(now, "a", "ra"), [scene, "a"]).join(at(now, "b", "rb"), [scene, "b"]).select(scene, F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("low")).filter("root <> low")
        below = stored(apart.groupBy(scene, "root").agg(F.min("low").alias("low")), "below")
        if below.isEmpty():
            done(links, below)
            return now
        hung = stored(now.join(below.hint("merge"), [scene, "root"], "left").select(scene, "node", F.coalesce("low", "root").alias("root")), "hung")
        once = hung.join(at(hung, "root", "up"), [scene, "root"]).select(scene, "node", F.col("up").alias("root"))
        new = stored(once.join(at(hung, "root", "up"), [scene, "root"]).select(scene, "node", F.col("up").alias("root")), "roots")
        done(now, below, hung)
        now = new


def labels_of_rows(scene: str, eight: bool):
    """Label the true pixels (`on`) of each row, which is a scene or a tile, many rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, width, on = batch.column(0), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            flat, which = on.flatten(), np.repeat(np.arange(len(on)), on.value_lengths().to_numpy())
            if len(which):
                r, c = (flat.field(i).to_numpy() for i in range(2))
                label = label_pixels(which, r, c, width, eight)
                yield pa.RecordBatch.from_arrays([name.take(pa.array(which)), pa.array(r), pa.array(c), pa.array(label)], [scene, "r", "c", "component"])

    return run


def at_least(labelled: DataFrame, size: int, scene: str = "scene") -> DataFrame:
    """Pixels of components of at least so many pixels, with the size."""
    return labelled.withColumn("size", F.count("*").over(Window.partitionBy(scene, "component"))).filter(F.col("size") >= size)


def touching(labelled: DataFrame, seeds: DataFrame, scene: str = "scene") -> DataFrame:
    """Pixels of components that hold a seed pixel (scene, r, c)."""
    hit = labelled.join(seeds, [scene, "r", "c"], "left_semi").select(scene, "component").distinct()
    return labelled.join(hit, [scene, "component"], "left_semi")


def resample_nearest(df: DataFrame, value: str, factor: float, size: int, scene: str = "scene") -> DataFrame:
    """Values of a size x size target grid whose cells are `factor` source cells wide, taken at the target cells' centres.

    Each source pixel finds by arithmetic the target cells whose centres it holds: nothing is joined.
    """
    def cells(at: Column) -> Column:
        near = F.sequence(F.greatest(F.floor(at / factor - 0.5) - 1, F.lit(0)), F.least(F.ceil((at + 1) / factor - 0.5) + 1, F.lit(size - 1)))
        return F.filter(near, lambda t: F.floor((t + 0.5) * factor) == at)

    within = (F.floor(F.col("r") / factor - 0.5) - 1 <= size - 1) & (F.floor(F.col("c") / factor - 0.5) - 1 <= size - 1)
    rows = df.filter(within).select(scene, F.explode(cells(F.col("r"))).alias("tr"), "c", F.col(value).alias("value"))
    return rows.select(scene, F.col("tr").cast("int").alias("tr"), F.explode(cells(F.col("c"))).alias("tc"), "value").select(scene, "tr", F.col("tc").cast("int").alias("tc"), "value")


def block_mean(df: DataFrame, value: str, valid: str, factor: int, least_coverage: float, scene: str = "scene") -> DataFrame:
    """Mean of valid values over blocks of factor x factor pixels, their coverage, and validity by least coverage."""
    ok = F.col(valid)
    out = df.groupBy(scene, F.floor(F.col("r") / factor).cast("int").alias("tr"), F.floor(F.col("c") / factor).cast("int").alias("tc")).agg(F.avg(F.when(ok, F.col(value))).alias("value"), (F.count_if(ok) / F.count("*")).alias("coverage"))
    return out.withColumn("valid", F.col("coverage") >= least_coverage - 1e-7)


def block_mode(df: DataFrame, value: str, factor: int, scene: str = "scene") -> DataFrame:
    """Most frequent value of each block, the smaller on ties; nulls are left out."""
    keys = [scene, F.floor(F.col("r") / factor).cast("int").alias("tr"), F.floor(F.col("c") / factor).cast("int").alias("tc")]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(scene, "tr", "tc").orderBy(F.desc("n"), "value")
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def otsu(df: DataFrame, value: str, groups: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """Threshold of greatest between-class variance over equal bins of each group's range; the lowest bin wins ties.

    The rows are reduced to a histogram before anything is ordered.
    """
    g = list(groups)
    span = df.groupBy(*g).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    base = df.join(span, g) if g else df.crossJoin(span)
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    hist = base.groupBy(*g, b.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    hist = hist.withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * step)
    run = Window.partitionBy(*g).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*g)
    h = hist.select(*g, "bin", "x", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("x")).over(run).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("x")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    h = h.withColumn("score", F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0)))
    first = Window.partitionBy(*g).orderBy(F.desc("score"), "bin")
    return h.withColumn("k", F.row_number().over(first)).filter("k = 1").select(*g, F.col("x").alias("threshold"), "bin")
