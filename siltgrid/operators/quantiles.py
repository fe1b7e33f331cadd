"""Exact percentiles of few large groups, by narrowing histograms.

An exact percentile needs the values at one or two ranks. A histogram of each group tells which bins hold them;
a histogram of each such bin, over its own least and greatest value, narrows it again. Only the values of the last bins
are counted one by one, distinct values once. Each pass reads the rows again and leaves a table of a few rows for each group, so
no task gathers a group: what meets in one place is counts, and at the end the distinct values of one bin.

Values are interpolated linearly between the two ranks around q (n - 1). Null, NaN and infinite values are left out; a group without
any other has n = 0 and nulls. Null group keys are a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltgrid.functions.expressions import finite

from .stored import done, stored

#: Bins of a histogram, histograms one inside the other, and rows of a table of bins that is broadcast.
BINS, LEVELS, BROADCAST = 4096, 2, 200_000


def percentiles(df: DataFrame, groups: Sequence[str], value: str | Column, wanted: Mapping[str, float], bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """(groups, n, one column for each name in wanted), wanted being percentiles from 0 to 1."""
    key = F.struct(*(F.col(g) for g in groups)) if groups else F.struct(F.lit(0).alias("_all"))  # equal where both are null, too
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    every = df.select(key.alias("g"), x.alias("x"))
    good = every.filter(finite(F.col("x"))).select("g", (F.col("x") + F.lit(0.0)).alias("x"))
    last = F.col("n") - 1
    place = {name: F.lit(float(q)) * last for name, q in wanted.items()}
    asked = F.array_sort(F.array_distinct(F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))))
    spans = good.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    cells = stored(spans.select("g", F.lit(0).cast("long").alias("cell"), "low", "high", F.lit(0).cast("long").alias("before"), asked.alias("ranks"), "n"), "cells")
    n, kept = cells, [cells]

    def marked(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST else table

    def bin_of() -> Column:
        # halves, so that the widest span is finite
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        return F.when(F.col("high") > F.col("low"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("long")

    rows = good.withColumn("cell", F.lit(0).cast("long"))
    for _ in range(levels):
        at = rows.join(marked(cells.select("g", "cell", "low", "high")), ["g", "cell"]).select("g", "x", "cell", (F.col("cell") * bins + bin_of()).alias("inner"))
        counts = at.groupBy("g", "cell", "inner").agg(F.count("*").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("k").over(Window.partitionBy("g", "cell").orderBy("inner"))
        counts = counts.withColumn("upto", upto).join(marked(cells.select("g", "cell", "before", "ranks")), ["g", "cell"])
        start = F.col("before") + F.col("upto") - F.col("k")
        inside = F.filter("ranks", lambda r: (r >= start) & (r < start + F.col("k")))
        # under names of their own: a lambda would take a new column for the old one of its name
        narrowed = counts.select("g", F.col("inner").alias("cell"), "low", "high", start.alias("begin"), inside.alias("held")).filter(F.size("held") > 0)
        cells = stored(narrowed.withColumnsRenamed({"begin": "before", "held": "ranks"}), "cells")
        kept.append(cells)
        rows = at.join(marked(cells.select("g", F.col("cell").alias("inner"))), ["g", "inner"], "left_semi").select("g", "x", F.col("inner").alias("cell"))
    each = rows.groupBy("g", "cell", "x").agg(F.count("*").alias("k"))
    each = each.withColumn("upto", F.sum("k").over(Window.partitionBy("g", "cell").orderBy("x"))).join(marked(cells.select("g", "cell", "before", "ranks")), ["g", "cell"])
    start = F.col("before") + F.col("upto") - F.col("k")
    found = each.select("g", "x", F.explode(F.filter("ranks", lambda r: (r >= start) & (r < start + F.col("k")))).alias("rank"))
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p).cast("long")), F.element_at("at", F.ceil(p).cast("long"))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    got = stored(n.join(values, "g").select("g", "n", *(between(p).alias(name) for name, p in place.items())), "percentiles")
    done(*kept)
    names = every.select("g").distinct().join(got, "g", "left")
    return names.select(*(F.col(f"g.{c}").alias(c) for c in groups), F.coalesce("n", F.lit(0)).cast("long").alias("n"), *wanted)
