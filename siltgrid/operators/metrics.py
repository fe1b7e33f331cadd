"""Confusion counts, derived accuracy figures, distributions and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` (or null) where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def confusion(df: DataFrame, groups: Sequence[str], pred: str = "pred", ref: str = "ref", valid: str | None = None, pixel_area: float = 0.04, empty: float | None = 0.0) -> DataFrame:
    """Counts of each group and what follows from them. One aggregation; zero denominators give `empty`."""
    p, r = F.col(pred), F.col(ref)
    ok = F.col(valid) if valid else F.lit(True)
    counts = df.groupBy(*groups).agg(
        F.count_if(p & r & ok).alias("tp"), F.count_if(p & ~r & ok).alias("fp"), F.count_if(~p & r & ok).alias("fn"), F.count_if(~p & ~r & ok).alias("tn")
    )
    return derived(counts, pixel_area, empty)


def derived(counts: DataFrame, pixel_area: float = 0.04, empty: float | None = 0.0) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    said, real = (tp + fp) * pixel_area, (tp + fn) * pixel_area
    return (
        counts.withColumn("precision", ratio(tp, tp + fp, empty))
        .withColumn("recall", ratio(tp, tp + fn, empty))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, empty))
        .withColumn("iou", ratio(tp, tp + fp + fn, empty))
        .withColumn("pred_ha", said)
        .withColumn("ref_ha", real)
        .withColumn("bias_ha", said - real)
        .withColumn("bias_pct", ratio(100 * (said - real), real, empty))
        .withColumn("fp_ha", fp * pixel_area)
        .withColumn("fn_ha", fn * pixel_area)
    )


def distribution(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, percentiles with linear interpolation, and range of finite values; an empty group has count 0 and nulls."""
    wanted = {"p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "least": 0.0, "most": 1.0}
    return percentiles(df, groups, value, wanted)


def pooled(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Medians over scenes, interquartile range, and figures from pooled counts."""
    sums = {k: F.sum(k) for k in ("tp", "fp", "fn", "tn")}
    out = scores.groupBy(*groups).agg(
        F.count("*").alias("scenes"),
        F.percentile("iou", F.lit(0.5)).alias("median_iou"),
        F.percentile("f1", F.lit(0.5)).alias("median_f1"),
        (F.percentile("iou", F.lit(0.75)) - F.percentile("iou", F.lit(0.25))).alias("iqr_iou"),
        F.percentile(F.abs("bias_pct"), F.lit(0.5)).alias("median_abs_bias"),
        F.min("iou").alias("worst_iou"),
        *(v.alias(k) for k, v in sums.items()),
    )
    return out.withColumn("pooled_iou", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("pooled_f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


#: Limits of the accuracy gate: fixed values.
GATE = {"rows": 5, "modes": 2, "fail_median": 0.35, "fail_scene": 0.25, "go_median": 0.50, "go_f1": 0.67, "go_scene_iou": 0.35, "go_scene_f1": 0.52, "go_bias": 25.0, "go_any_bias": 50.0, "go_mode": 0.45}


def gate(scores: DataFrame, mode: str, qa: dict[str, str | None]) -> DataFrame:
    """One row: GO, REFINE or FAIL, and the reasons. Five rows and both modes are asked for; QA other than absent or passed fails."""
    g = GATE
    bad = sorted(k for k, v in qa.items() if v not in (None, "pass", "passed"))
    by_mode = scores.groupBy(mode).agg(F.percentile("iou", F.lit(0.5)).alias("m")).agg(F.count("*").alias("modes"), F.min("m").alias("least_mode"))
    whole = scores.agg(
        F.count("*").alias("n"),
        F.percentile("iou", F.lit(0.5)).alias("iou"),
        F.percentile("f1", F.lit(0.5)).alias("f1"),
        F.count_if(F.col("iou") < g["fail_scene"]).alias("poor"),
        F.min("iou").alias("least_iou"),
        F.min("f1").alias("least_f1"),
        F.percentile(F.abs("bias_pct"), F.lit(0.5)).alias("bias"),
        F.max(F.abs("bias_pct")).alias("most_bias"),
    )
    one = whole.crossJoin(by_mode)  # two tables of one row
    short = (F.col("n") != g["rows"]) | (F.col("modes") != g["modes"])
    fail = short | (F.col("iou") < g["fail_median"]) | (F.col("poor") >= 2) | F.lit(bool(bad))
    refine = {
        "median iou": F.col("iou") < g["go_median"],
        "median f1": F.col("f1") < g["go_f1"],
        "scene iou": F.col("least_iou") < g["go_scene_iou"],
        "scene f1": F.col("least_f1") < g["go_scene_f1"],
        "median bias": F.col("bias") > g["go_bias"],
        "scene bias": F.col("most_bias") > g["go_any_bias"],
        "mode median": F.col("least_mode") < g["go_mode"],
    }
    any_refine = F.greatest(*refine.values())
    reasons = F.concat_ws("; ", F.when(short, "rows or modes"), F.when(F.col("iou") < g["fail_median"], "median iou below the floor"), F.when(F.col("poor") >= 2, "poor scenes"), *(F.when(c, k) for k, c in refine.items()), *(F.lit(f"qa {k}") for k in bad))
    return one.select(F.when(fail, "FAIL").when(any_refine, "REFINE").otherwise("GO").alias("status"), reasons.alias("reasons"), "n", "modes", F.col("iou").alias("median_iou"), F.col("f1").alias("median_f1"))
