"""Connected components of a table of links, by alternating stars.

A large star connects each node's larger neighbours to the least of its neighbours and itself; a
small star does so with the neighbours that are not larger. Alternated until nothing changes, they
leave each node linked to the least node of its component. Before each round, tasks contract the
links that they hold to trees, so dense groups shrink early. Links stay in Spark: a round is written
to the shared folder, and the one before is deleted.

The links of a hub are spread over tasks: a large star moves only the links of nodes that have a smaller
neighbour, and these meet their node's least neighbour by node and salt, of which each such node has SALTS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LINK = "a long, b long"
#: Parts over which the links of one node are dealt.
SALTS = 16


class Forest:
    """Union by least number, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.get(x, x)) != x:
            p[x] = p.get(up, up)
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def links(self) -> tuple[list[int], list[int]]:
        nodes = list(self.parent)
        roots = [self.root(x) for x in nodes]
        pairs = [(x, r) for x, r in zip(nodes, roots) if x != r]
        return [x for x, _ in pairs], [r for _, r in pairs]


def contract(links: DataFrame) -> DataFrame:
    """Replace each task's links by links to the least node of their tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(x, y)
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(common.tidied(run), LINK)


def _large_star(links: DataFrame) -> DataFrame:
    up = links.select(F.col("b").alias("a"), F.col("a").alias("b"))  # each link at its smaller end
    least = links.groupBy("a").agg(F.min("b").alias("m"))  # of the ends that have a smaller neighbour
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    moved = least.join(up.select("a").distinct(), "a", "left_semi").withColumn("salt", salts)
    salted = up.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(moved, ["a", "salt"], "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    onward = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(onward).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its least node. Links of a node to itself, repeated links and nulls count for nothing."""
    spark = links.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = common.scratch(spark, "links")
        df.write.parquet(path)
        out = spark.read.schema(LINK).parquet(path)
        return out, path, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path, mark = stored(contract(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(most_rounds):
        if not mark[0]:
            break
        new, new_path, new_mark = stored(_small_star(_large_star(now)))
        common.remove(spark, path)
        same, now, path, mark = new_mark == mark, new, new_path, new_mark
        if same:
            break
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
