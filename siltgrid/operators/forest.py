"""Sampling by spatial block and random-forest water classification with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import done, stored

#: Settings of the published model: fixed values.
TREES, DEPTH, LEAF, SEED = 200, 12, 5, 20261004


def block_sample(df: DataFrame, label: str, block: Sequence[str], per_block: int, salt: str = "block", order: Sequence[str] = ("scene", "r", "c")) -> DataFrame:
    """At most per_block rows of each class in each block, by hash order, then as many of each class as the rarer one has. The order is the same at every run.

    What the blocks give is stored: it is counted twice before it is ranked, and each time all of df would be computed again.
    """
    h = F.md5(F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in order)))
    rows = df.withColumn("_h", h)
    w = Window.partitionBy(*block, label).orderBy("_h")
    rows = stored(rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_block), "blocks")
    n = rows.groupBy(label).count().agg(F.min("count").alias("_least"))  # one row
    # ranks come from counts of hash prefixes, so that no class is ordered in one task
    rows = rows.withColumn("_p", F.substring("_h", 1, 3))
    runs = rows.groupBy(label, "_p").count()
    before = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(label, "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy(label, "_p").orderBy("_h")
    ranked = rows.withColumn("_r", F.row_number().over(inner)).join(F.broadcast(runs), [label, "_p"])
    return ranked.crossJoin(n).filter(F.col("_b") + F.col("_r") <= F.col("_least")).drop("_h", "_k", "_p", "_b", "_r", "_least")


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> PipelineModel:
    """Forest with classes weighted to equal mass. The rows are stored, as fitting reads them several times."""
    from pyspark.ml import Pipeline

    df = stored(df.select(*features, label), "taught")
    n = df.count()
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError("a forest needs two classes")
    weight = F.coalesce(*(F.when(F.col(label) == k, n / (len(counts) * v)) for k, v in counts.items()))
    rows = df.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), forest]).fit(rows)
    done(df)
    return model


def predict(model: PipelineModel, df: DataFrame, valid: str | None = None) -> DataFrame:
    """Probability of water, null where invalid, and water from one half."""
    p = vector_to_array("probability").getItem(1)
    ok = F.col(valid) if valid else F.lit(True)
    scored = model.transform(df).withColumn("p_water", F.when(ok, p))
    return scored.withColumn("water", F.col("p_water") >= 0.5).drop("_x", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    trees = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, trees.featureImportances.toArray())], "feature string, importance double")
