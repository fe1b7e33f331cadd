"""Forests by fold: a tree against plain Python, and what a fold may not know."""

import random

import pytest
from pyspark.sql import functions as F

from siltgrid.operators import trees


def data(spark, seed=1, flip=None):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        a, b = rng.uniform(0, 10), rng.gauss(0, 2)
        y = (a + b > 5) != (rng.random() < 0.1)
        fold = i % 4
        rows.append((i, fold, a, b, 1.0, (not y) if fold == flip else y))
    rows += [(900, 0, None, 1.0, 1.0, True), (901, 1, float("nan"), 1.0, 1.0, True)]
    return rows, spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, y boolean")


def plain_tree(rows, depth, leaf, bins):
    """{node: (feature, bin)} and {node: p} by the same rule, one node at a time."""
    n, ones = len(rows), sum(y for *_, y in rows)
    spans = [(min(r[0][i] for r in rows), max(r[0][i] for r in rows)) for i in range(3)]
    bin_of = lambda x, i: min(int((x - spans[i][0]) / (spans[i][1] - spans[i][0]) * bins), bins - 1) if spans[i][1] > spans[i][0] else 0
    weigh = lambda y: n / (2 * ones) if y else n / (2 * (n - ones))
    items = [([bin_of(x[i], i) for i in range(3)], y, weigh(y)) for x, y in rows]
    gini = lambda part: 2 * sum(w for _, y, w in part if y) * sum(w for _, y, w in part if not y) / sum(w for *_, w in part)
    cuts, leaves, todo = {}, {}, [(1, items, 0)]
    while todo:
        node, part, level = todo.pop()
        best = None
        for i in range(3):
            for b in range(bins):
                left, right = [x for x in part if x[0][i] <= b], [x for x in part if x[0][i] > b]
                if len(left) >= leaf and len(right) >= leaf:
                    key = (-round(gini(part) - gini(left) - gini(right), 9), i, b)
                    if key[0] < 0 and (best is None or key < best[0]):
                        best = key, left, right
        if best is None or level == depth:
            leaves[node] = sum(w for _, y, w in part if y) / sum(w for *_, w in part)
            continue
        cuts[node] = best[0][1:]
        todo += [(2 * node, best[1], level + 1), (2 * node + 1, best[2], level + 1)]
    return cuts, leaves, spans


def test_one_tree_for_each_fold_equals_plain_python(spark):
    rows, df = data(spark)
    model = trees.fit(df, ["a", "b", "c"], "y", "fold", ["id"], trees=1, depth=3, leaf=8, bins=16, bootstrap=False, every_feature=True)
    scored = {r.id: r.p for r in trees.predict(model, df, "fold").collect()}
    assert scored[900] is None and scored[901] is None
    for fold in range(4):
        cuts, leaves, spans = plain_tree([((a, b, c), y) for _, f, a, b, c, y in rows[:400] if f != fold], 3, 8, 16)
        got = model.splits[model.splits["fold"] == fold]
        want = {n: (i, pytest.approx(spans[i][0] + (spans[i][1] - spans[i][0]) * (b + 1) / 16)) for n, (i, b) in cuts.items()}
        assert dict(zip(got["node"], zip(got["feature"], got["threshold"]))) == want and len(want) > 3
        part = model.leaves[model.leaves["fold"] == fold]
        assert dict(zip(part["node"], part["p"])) == {n: pytest.approx(p) for n, p in leaves.items()}
        for i, f, a, b, c, _ in rows[:400]:
            if f == fold:
                node = 1
                while node in want:
                    node = 2 * node + ((a, b, c)[want[node][0]] >= want[node][1].expected)
                assert scored[i] == pytest.approx(leaves[node])


def test_a_fold_has_no_part_in_its_own_forest(spark):
    kinds = dict(trees=5, depth=4, leaf=3)
    plain, flipped = (trees.fit(data(spark, flip=f)[1], ["a", "b", "c"], "y", "fold", ["id"], **kinds) for f in (None, 2))
    rows = lambda m, f: sorted(map(tuple, m.splits[m.splits["fold"] == f].itertuples(index=False))) + sorted(map(tuple, m.leaves[m.leaves["fold"] == f].round(9).itertuples(index=False)))
    assert rows(plain, 2) == rows(flipped, 2) and rows(plain, 0) != rows(flipped, 0)
    _, df = data(spark)
    right = trees.predict(plain, df, "fold").filter("p is not null").select(F.avg(((F.col("p") >= 0.5) == F.col("y")).cast("int"))).first()[0]
    assert right > 0.8
    with pytest.raises(ValueError, match="two classes"):
        trees.fit(df.filter("y"), ["a"], "y", "fold", ["id"])


def test_samples_and_fits_compute_their_input_once(spark):
    from siltgrid.operators import forest

    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(len(b))
            yield b

    rows = [(s, r, r, float(s + r), r % 2) for s in range(4) for r in range(10)]
    df = spark.createDataFrame(rows, "scene long, r int, c int, v double, y int")
    sample = forest.block_sample(df.mapInPandas(counted, df.schema), "y", ["scene"], 3)
    assert len(sample.collect()) == 24 and n.value == 40
    n.value = 0
    forest.fit(df.mapInPandas(counted, df.schema), ["v"], "y", trees=2, depth=2)
    assert n.value == 40
    n.value = 0
    trees.fit(df.mapInPandas(counted, df.schema), ["v"], "y", "scene", ["scene", "r"], trees=1, depth=1)
    assert n.value == 40


def test_rows_are_stored_once_for_all_trees_and_levels(spark, monkeypatch):
    kept, real = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, tag: kept.append(df.count()) or real(df, tag))
    rows, df = data(spark)
    model = trees.fit(df, ["a", "b", "c"], "y", "fold", ["id"], trees=6, depth=4)
    assert sum(kept) == 400 and set(model.leaves["tree"]) == set(range(6))
    # folds of any type; rows of no fold teach nothing and have no prediction, nor has a fold without a forest
    named = df.withColumn("fold", F.concat(F.lit("f"), "fold")).unionByName(spark.createDataFrame([(950, None, 1.0, 1.0, 1.0, True)], "id long, fold string, a double, b double, c double, y boolean"))
    again = trees.fit(named, ["a", "b", "c"], "y", "fold", ["id"], trees=6, depth=4, every_feature=True)
    whole = trees.fit(df, ["a", "b", "c"], "y", "fold", ["id"], trees=6, depth=4, every_feature=True)
    assert [f"f{f}" for f in whole.leaves.sort_values(["fold", "tree", "node"])["fold"]] == again.leaves.sort_values(["fold", "tree", "node"])["fold"].tolist()
    p = {r.id: r.p for r in trees.predict(whole, df, "fold").collect()}
    q = {r.id: r.p for r in trees.predict(again, named.unionByName(named.limit(1).withColumn("id", F.lit(951)).withColumn("fold", F.lit("f9"))), "fold").collect()}
    assert q == p | {950: None, 951: None}


def test_forests_by_fold_compute_their_pixels_once(spark, monkeypatch):
    from siltgrid.plans import fitting_queries

    n, real = spark.sparkContext.accumulator(0), fitting_queries.model_input

    def counted(batches):
        for b in batches:
            n.add(len(b))
            yield b

    def watched(spark, sf):
        df = real(spark, sf)
        return df.mapInPandas(counted, df.schema)

    monkeypatch.setattr(fitting_queries, "model_input", watched)
    want = real(spark, "/root/testdata/sf0.001").count()
    assert fitting_queries.by_fold(spark, "/root/testdata/sf0.001").count() == want and n.value == want
