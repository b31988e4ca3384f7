"""The same transforms over streams: traffic windows, sessions, dedup, lint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import qlang


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with zone, and on a stream the watermark."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if events.isStreaming else x


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; works on tables and, with a watermark, on streams."""
    x = _timed(events, late)
    x = x.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user and session."""
    x = _timed(events, late)
    x = x.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """A row for each key; on a stream the state is dropped with the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


#: Numbers that a level of a quantile sketch keeps; the rank of its quantiles is off by about 1.7 / SKETCH_K (99 in 100 times).
SKETCH_K = 800


def latency_sketches(events: DataFrame, by: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, by, n, sketch`` of each window of a stream or table: a quantile sketch of some kilobytes instead of the
    values, so that state stays small, and that merges with others (A12 to A15). Nulls and values that aren't numbers don't count."""
    x = _timed(events, late).where(F.col(value).isNotNull() & ~F.isnan(value))
    x = x.groupBy(F.window("ts", size), by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))
    return x.select(F.col("window.start").alias("start"), by, "n", "sketch")


def merged_quantiles(sketches: DataFrame, by: str = "event_type", at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``by, n, windows, quantiles`` over all windows of ``latency_sketches``: the sketches of any part of them can be merged."""
    x = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    return x.select(by, "n", "windows", F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(p)) for p in at]).alias("quantiles"))


def linted(queries: DataFrame) -> DataFrame:
    return queries.withColumn("errors", qlang.lint(F.col("query"))).withColumn("valid", F.size("errors") == 0)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable | None = None) -> None:
    """Process what is there and stop; a run goes on where the last one ended."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    (w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()).awaitTermination()
