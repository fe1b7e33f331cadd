"""Many small forests in one job: one for each fold, fitted on the rows of all other folds.

Every row is stored once, with its fold, features and a bootstrap weight for each tree. A level of all trees of all forests is one pass:
tasks find the nodes that their rows have come to and count both classes by (forest, tree, node, feature, bin), and one sum puts the
counts together. Windows over the bins give the impurity of each possible split, and the best one of a node is kept. What is
fitted (at most folds x trees x 2^depth nodes) is small; it goes with the tasks of the next pass and of predicting. A task holds the
counts of a level: folds x trees x 2^depth x features x bins pairs of numbers at most.

Bins are of equal width between the least and the greatest value that a forest's own rows have, so a fold has no part in what is
fitted for it. Bootstrap weights are Poisson draws by hash of the row's key, and the features that a node may use are drawn by hash, so
a fit repeats exactly; counts are whole numbers, so their order plays no part. Of equal splits the first feature and the lowest bin are
taken. Rows with a null or non-finite feature teach nothing and have no prediction. Both classes have the same mass in each forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltgrid.functions.expressions import finite

from .stored import done, stored

#: Cumulative chances of 0, 1, 2, 3 and 4 in a Poisson draw of mean 1.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(5))


@dataclass
class Forests:
    """features; splits: (fold, tree, node, feature, threshold); leaves: (fold, tree, node, p). A node's children are 2 node and 2 node + 1."""

    features: list[str]
    splits: pd.DataFrame
    leaves: pd.DataFrame


def draw(key: Sequence[str], *parts: Column | str) -> Column:
    """A number from 0 to 1 by hash of a row's key and more."""
    return (F.pmod(F.xxhash64(*key, *parts), F.lit(1 << 32)) / F.lit(float(1 << 32))).cast("double")


def fit(df: DataFrame, features: Sequence[str], label: str, fold: str, key: Sequence[str], trees: int = 20, depth: int = 6, leaf: int = 5, bins: int = 32, bootstrap: bool = True, every_feature: bool = False) -> Forests:
    """A forest for each value of `fold`, of the rows with another value."""
    names, spark = list(features), df.sparkSession
    ok = F.col(label).isNotNull() & F.col(fold).isNotNull()
    for f in names:
        ok = ok & finite(F.col(f))
    u = lambda t: draw(["id"], F.lit(t))
    times = lambda t: sum((F.when(u(t) >= p, 1).otherwise(0) for p in POISSON), F.lit(0)) if bootstrap else F.lit(1)
    rows = df.filter(ok).select(F.col(fold).alias("own"), F.col(label).cast("double").alias("y"), F.xxhash64(*key).alias("id"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)))
    rows = stored(rows.select("own", "y", *(f"x{i}" for i in range(len(names))), F.array(*(times(t).cast("tinyint") for t in range(trees))).alias("k")), "taught")
    spans = [f"{s}{i}" for i in range(len(names)) for s in ("low", "high")]
    by_fold = rows.groupBy("own").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *((F.min if s.startswith("low") else F.max)(f"x{s.lstrip('lowhigh')}").alias(s) for s in spans))
    by_fold = {r["own"]: r for r in by_fold.collect()}  # folds are few
    own = sorted(by_fold)
    facts = []
    for f in own:
        rest = [r for o, r in by_fold.items() if o != f]
        if rest:
            facts.append((f, sum(r["n"] for r in rest), sum(r["ones"] for r in rest), *((min if s.startswith("low") else max)(r[s] for r in rest) for s in spans)))
    if any(ones in (0, n) for _, n, ones, *_ in facts):
        raise ValueError("a forest needs two classes")
    low, high = (np.array([[f[3 + 2 * i + j] for i in range(len(names))] for f in facts]).reshape(len(facts), len(names)) for j in (0, 1))
    mass = [F.create_map(*(F.lit(v) for j, (_, n, ones, *_) in enumerate(facts) for v in (j, n / (2 * (ones if y else n - ones))))) for y in (0, 1)] if facts else None
    # by (forest, tree, node): the feature that a node is split by, or -1, and the last bin on the left
    feature, cut = (np.full((len(facts), trees, 2 << depth), v, np.int64) for v in (-1, 0))
    allowed = len(names) if every_feature else max(1, math.isqrt(len(names)))
    node = ["fold", "tree", "node"]
    splits = []
    for level in range(depth if facts else 0):
        sums = rows.mapInArrow(counted(own, low, high, bins, feature, cut, level), COUNTS).groupBy(*node, "feature", "bin").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
        upto, whole = Window.partitionBy(*node, "feature").orderBy("bin"), Window.partitionBy(*node, "feature")
        at = sums.select(*node, "feature", "bin", *(F.sum(c).over(w).alias(f"{c}{s}") for c in ("k0", "k1") for s, w in (("l", upto), ("t", whole))))
        masses = [m[F.col("fold")] for m in mass]
        parts = {s: (F.col(f"k0{s}"), F.col(f"k1{s}")) for s in "lt"}
        parts["r"] = tuple(t - l for l, t in zip(parts["l"], parts["t"]))

        def impurity(s: str) -> Column:  # weighted Gini
            zeros, ones = (k * m for k, m in zip(parts[s], masses))
            return 2 * ones * zeros / (zeros + ones)

        at = at.filter((sum(parts["l"]) >= leaf) & (sum(parts["r"]) >= leaf))
        if allowed < len(names):
            named = F.create_map(*(F.lit(v) for j, f in enumerate(facts) for v in (j, f[0])))[F.col("fold")].cast(df.schema[fold].dataType)
            drawn = F.array_sort(F.array(*(F.struct(draw([], named, F.col("tree"), F.col("node"), F.lit(i)).alias("u"), F.lit(i).alias("i")) for i in range(len(names)))))
            at = at.filter(F.array_contains(F.transform(F.slice(drawn, 1, allowed), lambda x: x["i"]), F.col("feature")))
        gain = impurity("t") - impurity("l") - impurity("r")
        best = at.groupBy(*node).agg(F.min(F.struct((-F.round(gain, 9)).alias("less"), "feature", "bin")).alias("s")).filter("s.less < 0")
        found = best.select(*node, "s.feature", "s.bin").toPandas()
        if found.empty:
            break
        place = tuple(found[c].to_numpy() for c in node)
        feature[place], cut[place] = found["feature"], found["bin"]
        splits.append(found)
    kinds = [f[0] for f in facts]
    leaves = rows.mapInArrow(counted(own, low, high, bins, feature, cut, None), COUNTS).groupBy(*node).agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).toPandas() if facts else pd.DataFrame(columns=[*node, "k0", "k1"])
    n, ones = (np.array([f[c] for f in facts])[leaves["fold"].to_numpy(np.int64)] if facts else np.zeros(0) for c in (1, 2))
    zeros, ones = leaves["k0"] * (n / (2 * (n - ones))), leaves["k1"] * (n / (2 * ones))
    leaves = leaves[node].assign(fold=[kinds[j] for j in leaves["fold"]], p=ones / (zeros + ones))
    split = pd.concat(splits) if splits else pd.DataFrame(columns=[*node, "feature", "bin"])
    threshold = [low[j, i] + (high[j, i] - low[j, i]) * (b + 1) / bins for j, i, b in zip(split["fold"], split["feature"], split["bin"])]
    done(rows)
    return Forests(names, split.assign(fold=[kinds[j] for j in split["fold"]], threshold=threshold).drop(columns="bin").reset_index(drop=True), leaves)


COUNTS = "fold int, tree int, node int, feature int, bin int, k0 long, k1 long"


def walked(x: np.ndarray, feature: np.ndarray, right, steps: int, tree: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The nodes that rows of x come to in trees (tree, node) of features; right(tree, node, values) says where they turn to the second child."""
    node = np.ones(len(row), np.int64)
    moving = np.arange(len(row))
    for _ in range(steps):
        of = feature[tree[moving], node[moving]]
        moving, of = moving[of >= 0], of[of >= 0]
        if not len(moving):
            break
        here = node[moving]
        node[moving] = 2 * here + right(tree[moving], here, x[row[moving], of])
    return node


def counted(own: list, low: np.ndarray, high: np.ndarray, bins: int, feature: np.ndarray, cut: np.ndarray, level: int | None):
    """Counts of both classes by (forest, tree, node, feature, bin) of a task's rows in the nodes of a level; by (forest, tree, node) where they end if there is none."""
    forests, trees, nodes = feature.shape
    width = low.shape[1]
    fits = np.where(high > low, high - low, np.inf)
    first, count = (0, nodes) if level is None else (1 << level, 1 << level)
    shape = (trees, count, 2) if level is None else (trees, count, width, bins, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(math.prod(shape), np.int64) for _ in range(forests)]
        for batch in batches:
            values = batch.column(0).dictionary_encode()
            at = np.array([own.index(v) for v in values.dictionary.to_pylist()], np.int64)[values.indices.to_numpy()]
            y = (batch.column(1).to_numpy() == 1).astype(np.int64)
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(width)], axis=1)
            k = batch.column(2 + width).flatten().to_numpy().reshape(len(y), trees)
            for f in range(forests):
                binned = np.minimum(np.floor((x - low[f]) / fits[f] * bins), bins - 1).astype(np.int64)
                row, tree = np.nonzero((k > 0) & (at != f)[:, None])
                node = walked(binned, feature[f], lambda t, n, b, f=f: b > cut[f, t, n], nodes.bit_length(), tree, row)
                here = np.flatnonzero((node >= first) & (node < first + count))
                row, tree = row[here], tree[here]
                place = tree * count + node[here] - first
                if level is not None:
                    place = ((place[:, None] * width + np.arange(width)) * bins + binned[row]).ravel()
                    row, tree = np.repeat(row, width), np.repeat(tree, width)
                sums[f] += np.bincount(place * 2 + y[row], k[row, tree], len(sums[f])).astype(np.int64)
        for f in range(forests):
            pairs = sums[f].reshape(-1, 2)
            hit = np.flatnonzero(pairs.any(axis=1))
            tree, node, *rest = np.unravel_index(hit, shape[:-1])
            of, b = rest or (np.zeros(len(hit)), np.zeros(len(hit)))
            columns = [np.full(len(hit), f), tree, node + first, of, b]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(pairs[hit, 0]), pa.array(pairs[hit, 1])], COUNT_NAMES)

    return run


COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def predict(model: Forests, df: DataFrame, fold: str, out: str = "p") -> DataFrame:
    """The rows with the mean over the trees of their own fold's forest, which has not seen them; null where a feature or the fold's forest lacks."""
    nodes = 2 * int(max(model.leaves["node"].max(), 1)) + 2 if len(model.leaves) else 2
    tables: dict = {}
    for f, part in model.leaves.groupby("fold"):
        numbers = {t: i for i, t in enumerate(part["tree"].drop_duplicates())}
        feature, threshold, p = np.full((len(numbers), nodes), -1, np.int64), np.zeros((len(numbers), nodes)), np.zeros((len(numbers), nodes))
        own = model.splits[model.splits["fold"] == f]
        place = own["tree"].map(numbers).to_numpy(np.int64), own["node"].to_numpy(np.int64)
        feature[place], threshold[place] = own["feature"].to_numpy(np.int64), own["threshold"].to_numpy(np.float64)
        p[part["tree"].map(numbers).to_numpy(np.int64), part["node"].to_numpy(np.int64)] = part["p"]
        tables[f] = feature, threshold, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([pc.cast(batch.column(n), pa.float64()).to_numpy(zero_copy_only=False) for n in model.features], axis=1)
            p = np.full(len(x), np.nan)
            known = np.isfinite(x).all(axis=1)
            values = batch.column(fold).dictionary_encode()
            kinds, at = values.dictionary.to_pylist(), values.indices.to_numpy(zero_copy_only=False)
            for j, f in enumerate(kinds):
                rows = np.flatnonzero((at == j) & known)
                if f not in tables or not len(rows):
                    continue
                feature, threshold, leaf = tables[f]
                total = np.zeros(len(rows))
                for t in range(len(feature)):
                    tree = np.full(len(rows), t)
                    total += leaf[t, walked(x, feature, lambda t, n, v, threshold=threshold: v >= threshold[t, n], nodes.bit_length(), tree, rows)]
                p[rows] = total / len(feature)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, mask=np.isnan(p))], [*batch.schema.names, out])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{out}` double")
