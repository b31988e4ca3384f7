"""Latency statistics, and what the engine adds: windows, sessions, frames, rollups, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import generate, stats
from ..operators._stored import shared_dir
from ..streaming import streams
from .base import table


def latency_percentiles(spark, sf):
    return stats.latency(table(spark, sf, "events"), "event_type", "value")


_LATENCY_SQL = """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY event_type)
  SELECT event_type, n, mean, lo, hi, """ + ", ".join(f"v[(floor(n * {q}) + 1)::INTEGER] AS p{int(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM s"


def latency_exclusive(spark, sf):
    return stats.latency_exclusive(table(spark, sf, "events"), "event_type", "value")


_EXCLUSIVE_SQL = """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
  SELECT event_type, n, """ + ", ".join(f"round(v[floor((n + 1) * {q})::INTEGER] + ((n + 1) * {q} - floor((n + 1) * {q})) * (v[floor((n + 1) * {q})::INTEGER + 1] - v[floor((n + 1) * {q})::INTEGER]), 4) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM s"


def load_report(spark, sf):
    """Requests and error rate by hour."""
    e = table(spark, sf, "events")
    x = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("requests"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))
    return x.withColumn("error_rate", F.round(F.col("errors") / F.col("requests"), 6))


def top_errors(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(5)


def stream_windows(spark, sf):
    return streams.windows(table(spark, sf, "events"))


def user_sessions(spark, sf):
    x = streams.sessions(table(spark, sf, "events"))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


_SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
  s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
  SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY user_id"""


def frames(spark, sf):
    """Moving means and quartiles of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean3"), F.ntile(4).over(w).alias("quartile"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


def rollup(spark, sf):
    x = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return x


def cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


def approx_users(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


def weighted_domains(spark, sf):
    x = generate.weighted_choice(table(spark, sf, "orders").select("o_orderkey"), {"astronomy": 0.5, "physics": 0.3, "general": 0.2}, "domain", "o_orderkey")
    return x.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_U = "('0x' || substr(md5('42|' || o_orderkey), 1, 12))::BIGINT / 281474976710656.0"

def latency_sketches(spark, sf):
    """Quantiles from the sketches of a stream's hours, merged by day and then in all, and whether their ranks are as near as promised."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = shared_dir(spark, "sketches")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parque[t]")
    # What a late hour still gets is written when the watermark passes it; a run that ends gives what there is.
    streams.run_to_table(streams.latency_sketches(stream), out, shared_dir(spark, "sketches-state"), mode="complete", each=lambda batch, _: batch.write.mode("overwrite").parquet(out))
    at = (0.5, 0.95, 0.99)
    got = streams.merged_quantiles(spark.read.parquet(out), at=at)
    x = stats.ranked(e, "event_type", "value").join(got.select("event_type", "windows", "quantiles"), "event_type")
    reached = [F.max(F.when(F.col("value") <= F.col("quantiles")[i], F.col("upto") / F.col("x.n"))) for i in range(len(at))]
    below = [F.coalesce(F.max(F.when(F.col("value") < F.col("quantiles")[i], F.col("upto") / F.col("x.n"))), F.lit(0.0)) for i in range(len(at))]
    near = [((low <= p + _RANK_ERROR) & (up >= p - _RANK_ERROR)).alias(f"near_p{int(p * 100)}") for p, up, low in zip(at, reached, below, strict=True)]
    return x.alias("x").groupBy("event_type").agg(F.max("n").alias("n"), F.max("windows").alias("windows"), *near)


#: How far a quantile's rank may be off, as a share of all values.
_RANK_ERROR = 0.005
_SKETCH_SQL = """SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS windows, true AS near_p50, true AS near_p95, true AS near_p99 FROM events WHERE value IS NOT NULL GROUP BY event_type"""


QUERIES = {
    "latency_sketches": (latency_sketches, _SKETCH_SQL),
    "latency_percentiles": (latency_percentiles, _LATENCY_SQL),
    "latency_exclusive": (latency_exclusive, _EXCLUSIVE_SQL),
    "load_report": (load_report, "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1"),
    "top_errors": (top_errors, "SELECT (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, k LIMIT 5"),
    "extras_stream_windows": (stream_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
    "extras_sessions": (user_sessions, _SESSION_SQL),
    "extras_frames": (frames, """SELECT o_orderkey, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3, (ntile(4) OVER w)::INTEGER AS quartile,
  date_diff('day', lag(o_orderdate) OVER w, o_orderdate)::INTEGER AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""),
    "extras_rollup": (rollup, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "extras_cube": (cube, "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "extras_approx_users": (approx_users, None),
    "weighted_domains": (weighted_domains, f"SELECT CASE WHEN {_U} < 0.5 THEN 'astronomy' WHEN {_U} < 0.8 THEN 'physics' ELSE 'general' END AS domain, count(*) AS n FROM orders GROUP BY 1"),
}
