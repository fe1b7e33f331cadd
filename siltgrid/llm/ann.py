"""Approximate nearest neighbours: adaptive dimension scan of inverted lists.

Vectors are rotated by one random orthogonal matrix, so that any leading columns are a fair sample of
a distance, and dealt to the list of their nearest centre. A query scans the lists of its nearest
centres in blocks of columns: after each block, the distance seen so far over k of D columns is tested
against the query's present k-th best; a candidate whose partial distance times D/k is beyond the
best by more than the test's margin is abandoned. Candidates that come to the last column are measured
exactly, in double precision, on the original vectors.

Equal vectors are one entry. It carries its least ids, one more than are asked for: no answer can hold
others, as ties go to the smaller id and a query leaves out only itself. So a group of copies of any
size is scanned once. Lists are cut into slices of bounded size by a hash of the vector and queries
into groups of bounded number; each slice meets each group in a task of its own.

The centres are fitted on at most SAMPLE rows, taken by least hash; every row is indexed. Vectors that
are null, zero, hold a null, NaN or infinity, or have another length than most take no part, as
candidates or queries. Rows of equal ids are separate candidates; a query leaves out all of its id.
Only the two named columns are read, so others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Rows on which centres are fitted, at most.
SAMPLE = 20_000
#: Mean entries of a list, the most lists, and the part of the lists that a query probes (at least LEAST_PROBES).
LIST_ROWS, MOST_LISTS, PROBED, LEAST_PROBES = 400, 4096, 0.75, 8
#: Entries and queries that meet in one task.
SLICE_ROWS, GROUP_QUERIES = 4000, 500
#: Columns of a block, and the test's margin: larger abandons later.
BLOCK, MARGIN = 16, 2.1
#: Entries of a slice that give the first bound, and of each stretch after them.
FIRST, STRETCH = 128, 1024


def rotation(size: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(11)
    found = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(found))
        full = counts > 0
        found[full] = sums[full] / counts[full, None]
    return found


def nearest(rows: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centres of each row, nearest first."""
    out = np.empty((len(rows), k), np.int64)
    norms = (to * to).sum(axis=1)
    for a in range(0, len(rows), 2048):
        d = norms - 2 * rows[a : a + 2048] @ to.T
        if k < len(to):
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(d, part, axis=1).argsort(axis=1, kind="stable")
            out[a : a + 2048] = np.take_along_axis(part, order, axis=1)
        else:
            out[a : a + 2048] = d.argsort(axis=1, kind="stable")
    return out


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype)


def entries(df: DataFrame, key: str, vector: str, least: int) -> DataFrame:
    """(v, ids, copies): distinct usable vectors as arrays of doubles with their least ids, in order."""
    v = F.col(vector).cast("array<double>")
    usable = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)"
    )
    # -0.0 and 0.0 are one value; adding zero makes them equal bits
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # a row's place among its copies: the filter goes into the shuffle's map side
    ranked = usable.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= least)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def scan(queries: np.ndarray, turned: np.ndarray, original: np.ndarray, rotated: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the k least (distance, id) of each query among a slice's entries, with early abandonment.

    All queries go over a stretch of entries together: the first block of columns as one product, the
    later ones for the pairs that are left.
    """
    n, size = rotated.shape
    counts = np.array([len(x) for x in ids])
    starts, flat = np.cumsum(counts) - counts, np.concatenate(ids).astype(np.int64)
    bound = np.full(len(queries), np.inf)
    at = np.zeros(0, np.int64)
    best = (at, at, np.zeros(0))
    head = slice(0, min(BLOCK, size))
    stretches = [0, *range(min(n, FIRST), n, STRETCH), n] if n else [0]
    for a, b in zip(stretches, stretches[1:]):
        q, c = turned[:, head], rotated[a:b, head]
        block = np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * q @ c.T, 0)
        seen = head.stop
        qi, ci = np.nonzero(block <= allowed(bound, seen, size)[:, None])
        partial, ci = block[qi, ci], ci + a
        while seen < size and len(qi):
            columns = slice(seen, min(seen + BLOCK, size))
            gap = rotated[ci, columns] - turned[qi, columns]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            seen = columns.stop
            left = partial <= allowed(bound, seen, size)[qi]
            qi, ci, partial = qi[left], ci[left], partial[left]
        gap = original[ci] - queries[qi]
        exact = np.sqrt((gap * gap).sum(axis=1))
        copies = counts[ci]
        each = np.repeat(np.arange(len(ci)), copies)
        place = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
        found = (np.append(best[0], qi[each]), np.append(best[1], flat[starts[ci[each]] + place]), np.append(best[2], exact[each]))
        order = np.lexsort((found[1], found[2], found[0]))
        found = tuple(x[order] for x in found)
        first = np.searchsorted(found[0], np.arange(len(queries)))
        rank = np.arange(len(order)) - first[found[0]]
        best = tuple(x[rank < k] for x in found)
        last = rank[rank < k] == k - 1
        bound[best[0][last]] = best[2][last]
    return best


def allowed(bound: np.ndarray, seen: int, size: int) -> np.ndarray:
    """The greatest partial sum of squares over `seen` columns at which a candidate is still held possible."""
    factor = seen / size * (1 + MARGIN / np.sqrt(seen)) ** 2 if seen < size else 1.0
    return bound * bound * factor * (1 + 1e-9) + 1e-9


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    stored = common.saved(entries(df, key, vector, k + 1).withColumn("size", F.size("v")), "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    usual = stored.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], out)
    size, n = usual["size"], usual["count"]
    base = stored.filter(F.col("size") == size)
    turn = rotation(size)
    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()])
    middle = centres(sample @ turn, max(1, min(MOST_LISTS, len(sample), -(-n // LIST_ROWS))))
    probes = min(len(middle), max(LEAST_PROBES, int(np.ceil(PROBED * len(middle)))))

    def to_lists(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            if len(page):
                yield pd.DataFrame({"list": nearest(matrix(page["v"]) @ turn, middle, 1)[:, 0], "v": page["v"].to_numpy(), "ids": page["ids"].to_numpy()})

    def to_probes(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            if len(page):
                found = nearest(matrix(page["v"]) @ turn, middle, probes)
                at = np.repeat(np.arange(len(page)), probes)
                yield pd.DataFrame({"list": found.ravel(), "v": page["v"].to_numpy()[at]})

    listed = common.saved(base.select("v", "ids").mapInPandas(to_lists, "list long, v array<double>, ids array<long>"), "lists")
    # queries: one for each distinct vector that has one; who asks is joined again at the end
    asking = df.select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")).filter(F.col("query_id") % every == 0)
    queries = asking.join(base.select("v"), "v", "left_semi").select("query_id", "v")
    probing = queries.select("v").distinct().mapInPandas(to_probes, "list long, v array<double>")
    slices = listed.groupBy("list").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("long").alias("slices"))
    asked = common.saved(probing, "probes")
    groups = asked.groupBy("list").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("long").alias("groups"))
    shape = slices.join(groups, "list")
    left = listed.join(shape, "list").withColumn("slice", F.pmod(F.xxhash64("v"), "slices")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("list", "slice", "group", "v", "ids")
    right = asked.join(shape, "list").withColumn("group", F.pmod(F.xxhash64("v", F.lit(1)), "groups")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select("list", "slice", "group", "v")

    def meet(entries_: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(entries_) or not len(asks):
            return pd.DataFrame({"v": [], "vec_id": [], "score": []})
        original, exact = matrix(entries_["v"]), matrix(asks["v"])
        number, ids, score = scan(exact, exact @ turn, original, original @ turn, [np.asarray(x) for x in entries_["ids"]], k + 1)
        return pd.DataFrame({"v": asks["v"].to_numpy()[number], "vec_id": ids, "score": score})

    met = left.groupBy("list", "slice", "group").cogroup(right.groupBy("list", "slice", "group")).applyInPandas(meet, "v array<double>, vec_id long, score double")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    answers = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    each = queries.distinct().join(answers, "v").select("query_id", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")).alias("found"))
    return each.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_dimension_scan(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_dimension_scan": op9_dimension_scan}
ORACLES: dict[str, str] = {}
