"""Counts, latencies and overlap metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.qlang import once


def distribution(df: DataFrame, by: str) -> DataFrame:
    """``by, n, pct`` (A1)."""
    x = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def indexed_quantile(ordered: Column, q: float) -> Column:
    """``sorted[int(n * q)]`` of a sorted array, the last at most."""
    n = F.size(ordered)
    return F.element_at(ordered, F.least(F.floor(n * q).cast("int") + 1, n))


def exclusive_quantile(ordered: Column, q: float) -> Column:
    """Interpolation at ``(n + 1) q`` between neighbours."""
    n = F.size(ordered)
    at = (n + 1) * F.lit(q)
    lo = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), n - 1))
    a, b = F.element_at(ordered, lo), F.element_at(ordered, lo + 1)
    return a + (at - lo) * (b - a)


def ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, times, upto, n``: each distinct value with its cumulative count. Repeats are
    counted before the window, so a group's rows never meet, only its distinct values."""
    from pyspark.sql.window import Window

    x = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy(by)
    return x.withColumn("upto", F.sum("times").over(w.orderBy(value))).withColumn("n", F.sum("times").over(w))


def latency(df: DataFrame, by: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """``n, mean, lo, hi`` and ``sorted[int(n q)]`` for each quantile, by group."""
    x = ranked(df, by, value)
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value))).alias(f"p{int(q * 100)}") for q in quantiles]
    mean = F.round(F.sum(F.col(value) * F.col("times")) / F.sum("times"), 4).alias("mean")
    return x.groupBy(by).agg(F.sum("times").alias("n"), mean, F.min(value).alias("lo"), F.max(value).alias("hi"), *at)


def latency_exclusive(df: DataFrame, by: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles interpolated at ``(n + 1) q``, by group."""
    x = ranked(df, by, value)
    out = []
    for q in quantiles:
        spot = (F.col("n") + 1) * F.lit(q)
        lo = F.greatest(F.lit(1), F.least(F.floor(spot), F.col("n") - 1))
        a, b = (F.min(F.when(F.col("upto") >= lo + d, F.col(value))) for d in (0, 1))
        frac = F.max(spot - lo)
        out.append(F.round(F.coalesce(a + frac * (b - a), a), 4).alias(f"p{int(q * 100)}"))
    return x.groupBy(by).agg(F.sum("times").alias("n"), *out)


def overlap(expected: Column, found: Column) -> Column:
    """``jaccard, precision, recall`` of two sets; both empty: 1, one empty: 0."""
    sizes = lambda s: F.struct(F.size(F.array_intersect(s["e"], s["f"])).alias("both"), F.size(F.array_union(s["e"], s["f"])).alias("union"), F.size(F.array_distinct(s["e"])).alias("e"), F.size(F.array_distinct(s["f"])).alias("f"))

    def scores(n: Column) -> Column:
        part = lambda of: F.when((n["e"] == 0) & (n["f"] == 0), 1.0).when((n["e"] == 0) | (n["f"] == 0), 0.0).otherwise(F.round(n["both"] / of, 6))
        return F.struct(part(n["union"]).alias("jaccard"), part(n["f"]).alias("precision"), part(n["e"]).alias("recall"))

    return once(once(F.struct(expected.alias("e"), found.alias("f")), sizes), scores)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 with 0 for 0/0 (A4)."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return tuple(F.round(x, 6) for x in (p, r, f1))
