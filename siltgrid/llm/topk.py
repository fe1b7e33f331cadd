"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are the columns whose weight floor(scale * x) is not 0. Candidates
are dealt to blocks by a running number, so evenly, whatever their ids, vectors or copies, and queries
to groups; each block meets each group in one task. There the block is turned into postings (for each
term the slots that have it, with their weights), and each query scatters its terms one after the
other into a dense array of one score per slot. The k best of the array are taken by partition
selection, and the k best of each query are merged over the blocks: k rows for each query and block
travel. Every query row meets every candidate row: nothing is pruned or sampled.

Scores are exact: 64-bit integers, or Python's where a block's weights are so large that a product
or a sum could pass 64 bits; a score beyond 64 bits counts as the nearest 64-bit integer. Missing trailing components count as 0. Ties go to the smaller
id. Vectors that are null or hold a null, NaN or infinity take no part, nor do rows without an id;
zero and empty vectors do. Rows of equal ids are separate candidates, a query leaves out all of its
id, and repeated query rows (same id and vector) ask once. An empty table gives no rows. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SCALE = 10, 1024
#: Candidates of a block and queries of a group, on average.
BLOCK_ROWS, GROUP_QUERIES = 4096, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def weights(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: as 64-bit integers, or as Python's where one doesn't fit."""
    if not len(values) or np.abs(values).max() < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    # from 2^53 on a double is whole
    return np.array([int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.tolist()], object)


class Postings:
    """For each term its slots and their weights, slots in order of id."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, values: np.ndarray, scale: int) -> None:
        self.ids = ids
        weight = weights(values, scale)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        slot = np.repeat(np.arange(len(sizes)), sizes)
        filled = np.flatnonzero(weight != 0)
        order = filled[np.lexsort((slot[filled], term[filled]))]
        slot, term, weight = slot[order], term[order], weight[order]
        cuts = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
        self.of = {int(term[a]): (slot[a:b], weight[a:b]) for a, b in zip(cuts, [*cuts[1:], len(term)])}
        self.largest = int(abs(weight).max()) if len(weight) else 0

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The inner product with each slot's row, one term after the other."""
        terms = np.flatnonzero(query != 0).tolist()
        bound = self.largest * (sum(abs(int(query[t])) for t in terms))
        dense = np.zeros(len(self.ids), np.int64 if bound <= MOST else object)
        for t in terms:
            if t in self.of:
                slots, weight = self.of[t]
                dense[slots] += (weight if dense.dtype == np.int64 else weight.astype(object)) * int(query[t])
        return dense if dense.dtype == np.int64 else np.array([min(max(x, LEAST), MOST) for x in dense.tolist()], np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k highest scores, in no order; of equal ones the first slots."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.append(above, np.flatnonzero(scores == least)[: k - len(above)])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")


def top_inner_products(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose id is divisible by `every`."""
    # the running number follows from a row's place in its file, so a task that runs again deals alike
    rows = usable(df, key, vector).withColumn("number", F.monotonically_increasing_id())
    queries = usable(df, key, vector).filter(F.col("id") % every == 0).distinct()
    blocks, groups = (max(1, -(-x.count() // size)) for x, size in ((rows, block_rows), (queries, group_queries)))
    every_block, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, groups))
    left = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")).withColumn("group", every_group).select("block", "group", "id", "v")
    right = queries.withColumn("group", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("block", every_block).select("block", "group", "id", "v")

    def meet(candidates: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(candidates) and len(asks):
            candidates = candidates.sort_by("id").combine_chunks()
            v = candidates["v"].combine_chunks()
            postings = Postings(candidates["id"].to_numpy(), v.value_lengths().to_numpy(), v.flatten().to_numpy(), scale)
            for query_id, query in zip(asks["id"].to_pylist(), asks["v"].combine_chunks()):
                scores = postings.scores(weights(query.values.to_numpy(), scale))
                a, b = np.searchsorted(postings.ids, (query_id, query_id + 1))  # its own rows lie together
                ids = postings.ids
                if b > a:
                    scores, ids = np.delete(scores, slice(a, b)), np.delete(ids, slice(a, b))
                slots = best(scores, k)
                found.append((np.full(len(slots), query_id), ids[slots], scores[slots]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in columns))))

    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_term_at_a_time(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(common.table(spark, sf_dir, "embeddings"))


#: Every query row against every other row by a join on the component's number; HUGEINT sums are exact.
SQL = """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), w AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS w FROM e
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(CAST(q.w AS HUGEINT) * c.w) AS BIGINT) AS score
  FROM w q JOIN w c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op12_term_at_a_time": op12_term_at_a_time}
ORACLES = {"op12_term_at_a_time": SQL}
