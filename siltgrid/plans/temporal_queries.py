"""Queries on gauge readings (events) and acquisition records (orders)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltgrid.operators import temporal
from siltgrid.sources.tables import read

from .raster_queries import rounded
from .registry import query

STAGES = [("rise", "peak", "2024-01-02 00:00:00", "2024-01-05 12:00:00"), ("low", "trough", "2024-01-05 12:00:00", "2024-01-11 00:00:00"), ("second", "peak", "2024-01-11 00:00:00", "2024-01-16 06:00:00"), ("fall", "trough", "2024-01-16 06:00:00", "2024-01-29 00:00:00")]
STAGES_SQL = "st AS (SELECT stage, kind, a::TIMESTAMP AS a, b::TIMESTAMP AS b FROM (VALUES " + ", ".join(f"('{s}', '{k}', '{a}', '{b}')" for s, k, a, b in STAGES) + ") t(stage, kind, a, b))"


def stages(spark):
    return spark.createDataFrame(STAGES, "stage string, kind string, a string, b string").select("stage", "kind", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))


@query("w01_acquisition_gaps", "SELECT o_custkey, o_orderkey, o_orderdate, previous, round((epoch_us(o_orderdate) - epoch_us(previous)) / 86400e6, 6) AS gap_days FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous IS NOT NULL")
def acquisition_gaps(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    out = o.withColumn("previous", F.lag("o_orderdate").over(w)).filter("previous is not null")
    return rounded(out.withColumn("gap_days", (temporal.seconds(F.col("o_orderdate")) - temporal.seconds(F.col("previous"))) / 86400), "gap_days")


@query("a13_coverage_by_year", "SELECT coalesce(a.y, b.y) AS year, coalesce(a.n, 0)::BIGINT AS ordered, coalesce(b.n, 0)::BIGINT AS shipped FROM (SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY 1) b ON a.y = b.y")
def coverage_by_year(spark, sf):
    a = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("ordered"))
    b = read(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("shipped"))
    return a.join(b, "year", "full").select("year", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ordered", "shipped")))


@query("w04_first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, sf):
    return temporal.first_per_key(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("w02_lead_lag_comparison", "SELECT conv_id, turn, role, length(text) AS chars, lead(role) OVER w AS next_role, length(text) - lag(length(text)) OVER w AS change FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lead_lag(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", n.alias("chars"), F.lead("role").over(w).alias("next_role"), (n - F.lag(n).over(w)).alias("change"))


@query("j09_stage_range_join", f"WITH {STAGES_SQL} SELECT stage, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events JOIN st ON ts >= a AND ts < b GROUP BY 1, 2")
def stage_range_join(spark, sf):
    joined = temporal.in_intervals(read(spark, sf, "events").select("ts", "event_type", "value"), "ts", stages(spark), "a", "b", 86400)
    return rounded(joined.groupBy("stage", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")), "mean", "least", "most")


EXTREMA_SQL = f"{STAGES_SQL}, ex AS (SELECT stage, kind, event_type, ts, value, event_id FROM events JOIN st ON ts >= a AND ts < b QUALIFY row_number() OVER (PARTITION BY stage, event_type ORDER BY CASE WHEN kind = 'trough' THEN value ELSE -value END, ts, event_id) = 1)"


def extrema(spark, sf):
    joined = temporal.in_intervals(read(spark, sf, "events").select("ts", "event_type", "value", "event_id"), "ts", stages(spark), "a", "b", 86400)
    sign = F.when(F.col("kind") == "trough", F.col("value")).otherwise(-F.col("value"))
    return temporal.first_per_key(joined, ["stage", "event_type"], [sign, F.col("ts"), F.col("event_id")]).select("stage", "kind", "event_type", "ts", "value", "event_id")


@query("w08_stage_extremum", f"WITH {EXTREMA_SQL} SELECT * FROM ex")
def stage_extremum(spark, sf):
    return extrema(spark, sf)


@query("j10_anchor_offsets", f"WITH {EXTREMA_SQL} SELECT e.event_id, ex.stage, round((epoch_us(e.ts) - epoch_us(ex.ts)) / 3.6e9, 2) AS offset_hours FROM events e JOIN st ON e.ts >= a AND e.ts < b JOIN ex ON ex.stage = st.stage AND ex.event_type = e.event_type")
def anchor_offsets(spark, sf):
    ev = temporal.in_intervals(read(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", stages(spark), "a", "b", 86400)
    # four stages by the event types: a bounded side
    anchors = extrema(spark, sf).select("stage", "event_type", F.col("ts").alias("anchor"))
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("anchor").cast("timestamp"))) / 3.6e9
    return ev.join(anchors, ["stage", "event_type"]).select("event_id", "stage", (F.round(hours, 2) + F.lit(0.0)).alias("offset_hours"))


@query("j11_as_of_purchase", "SELECT c.event_id, c.ts, p.ts AS as_of, p.value AS value FROM (SELECT * FROM events WHERE event_type <> 'purchase') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON p.user_id = c.user_id AND c.ts >= p.ts")
def as_of_purchase(spark, sf):
    e = read(spark, sf, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    rest = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(rest, bought, ["user_id"], "ts", "ts", ["value"]).select("event_id", "ts", "as_of", "value")


@query(
    "j11_step_lookup",
    """WITH t AS (SELECT unnest(range(0, 10)) * 10 AS start, unnest(range(0, 10)) * 5 + 100 AS gain)
SELECT event_id, max(start)::INT AS step, arg_max(gain, start)::INT AS gain, count(start) = 0 AS outside FROM events LEFT JOIN t ON value >= start AND value < 100 GROUP BY event_id""",
)
def step_lookup(spark, sf):
    """The last entry of a gain table at or before each value; values outside its support say so. The table is a constant of ten rows."""
    table = spark.createDataFrame([(10 * k, 100 + 5 * k) for k in range(10)], "start int, gain int")
    entries = F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct("start", "gain"))).alias("entries")))
    known = F.filter("entries", lambda e: (e["start"] <= F.col("value")) & (F.col("value") < 100))
    found = F.try_element_at(known, F.lit(-1))
    rows = read(spark, sf, "events").select("event_id", "value").crossJoin(entries).select("event_id", found.alias("e"))
    return rows.select("event_id", F.col("e.start").alias("step"), F.col("e.gain").alias("gain"), F.col("e").isNull().alias("outside"))


@query("j12_best_match", "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6, 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(l_discount, 100), l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def best_match(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount")
    best = temporal.first_per_key(li, ["l_orderkey"], [F.coalesce("l_discount", F.lit(100.0)), F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.abs(temporal.seconds(F.col("l_shipdate")) - temporal.seconds(F.col("o_orderdate"))) / 86400
    return rounded(best.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", days.alias("days")), "days")


HOURLY_SQL = """h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2), sp AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1)"""


@query("w14_hourly_mean", f"WITH {HOURLY_SQL} SELECT sp.event_type, sp.hour, round(mean, 6) AS mean, coalesce(n, 0)::BIGINT AS n FROM sp LEFT JOIN h USING (event_type, hour)")
def hourly_mean(spark, sf):
    return rounded(temporal.hourly(read(spark, sf, "events"), ["event_type"], "ts", "value").withColumn("hour", F.col("hour").cast("timestamp_ntz")), "mean")


@query("w06_median_deviation", "SELECT event_type, day, round(m, 6) AS m, round(m - median(m) OVER (PARTITION BY event_type), 6) + 0.0::DOUBLE AS deviation, round(100 * (m - median(m) OVER (PARTITION BY event_type)) / median(m) OVER (PARTITION BY event_type), 6) + 0.0::DOUBLE AS deviation_pct FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS m FROM events GROUP BY 1, 2)")
def median_deviation(spark, sf):
    d = read(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("m"))
    w = Window.partitionBy("event_type")
    mid = F.percentile("m", F.lit(0.5)).over(w)
    return rounded(d.select("event_type", "day", "m", (F.col("m") - mid).alias("deviation"), (100 * (F.col("m") - mid) / mid).alias("deviation_pct")), "m", "deviation", "deviation_pct")


@query("a08_stability", "WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS m FROM events GROUP BY 1, 2), x AS (SELECT *, median(m) OVER (PARTITION BY event_type) AS mid FROM d) SELECT event_type, round(any_value(mid), 6) AS median, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(100 * stddev_samp(m) / avg(m), 6) AS cv_pct, round(100 * (max(m) - min(m)) / avg(m), 6) AS range_pct, arg_max(day, abs(m - mid)) AS most_off FROM x GROUP BY event_type")
def stability(spark, sf):
    d = read(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("m"))
    x = d.withColumn("mid", F.percentile("m", F.lit(0.5)).over(Window.partitionBy("event_type")))
    out = x.groupBy("event_type").agg(F.first("mid").alias("median"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), (100 * F.stddev_samp("m") / F.avg("m")).alias("cv_pct"), (100 * (F.max("m") - F.min("m")) / F.avg("m")).alias("range_pct"), F.max_by("day", F.abs(F.col("m") - F.col("mid"))).alias("most_off"))
    return rounded(out, "median", "mean", "std", "cv_pct", "range_pct")


@query("x01_hourly_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_tumbling(spark, sf):
    from siltgrid.streaming import windows

    out = windows.tumbling(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "mean"), "mean")


@query("f11_time_formats", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact, strftime(ts, '%Y-%m-%d') AS day, date_trunc('second', ts) AS floored, year(ts)::INT AS year FROM events")
def time_formats(spark, sf):
    return read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("compact"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("floored"), F.year("ts").alias("year"))


@query("f20_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, list_sort(json_keys(props)) AS keys FROM events".replace("list_sort(json_keys(props)) AS keys", "array_to_string(list_sort(json_keys(props)), ',') AS keys"))
def json_columns(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(m["missing"], F.lit("none")).alias("missing"), F.array_join(F.sort_array(F.map_keys(m)), ",").alias("keys"))
