"""Span and query evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import qlang
from .stats import prf
from .validate import invalid_values


def exact_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per span with ``tp, fp, fn``: spans ``(doc_id, start, end, type)`` match one to one
    (J10). Equal spans are interchangeable, so counts by key say it all and no pair is made."""
    key = ["doc_id", "start", "end", "type"]
    x = pred.select(*key, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*key, F.lit(0).alias("p"), F.lit(1).alias("g")))
    x = x.groupBy(*key).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return x.select(*key, F.least("p", "g").alias("tp"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"))


def span_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``type, tp, fp, fn, precision, recall, f1`` by type and, type ``(all)``, over all (A4)."""
    x = exact_matches(pred, gold).rollup("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping("type").alias("g"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    kind = F.when(F.col("g") == 1, "(all)").otherwise(F.col("type"))
    return x.select(kind.alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], p.alias("precision"), r.alias("recall"), f.alias("f1"))


def overlaps(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of one type in one document with intersection over union of at least ``least``:
    ``doc_id, type, p_ord, g_ord, iou``; both sides have ``ord`` (J11).

    Two such spans differ in length by the factor ``least`` at most and start near one another. A gold span lies
    in one cell of a grid by the power of two of its length; a prediction looks into the few cells of the few powers that it can match, so
    pairs are made of near spans of like length only, however many a document has."""
    g = gold.where("end > start").select("doc_id", "type", F.col("start").alias("g0"), F.col("end").alias("g1"), F.col("ord").alias("g_ord"))
    power = lambda n: F.floor(F.log2(n) + 1e-9).cast("int")
    g = g.withColumn("power", power(F.col("g1") - F.col("g0"))).withColumn("cell", F.floor(F.col("g0") / F.pow(F.lit(2.0), "power")))
    n = F.col("end") - F.col("start")
    x = pred.where("end > start").select("doc_id", "type", "start", "end", F.col("ord").alias("p_ord"))
    x = x.withColumn("power", F.explode(F.sequence(F.greatest(power(n * least), F.lit(0)), power(n / least))))
    size = F.pow(F.lit(2.0), "power")
    away = (1 - least) * F.greatest(n, 2 * size)
    x = x.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - away) / size), F.floor((F.col("start") + away) / size))))
    x = x.join(g, ["doc_id", "type", "power", "cell"]).where("start < g1 and g0 < end")
    inter = F.least("end", "g1") - F.greatest("start", "g0")
    iou = inter / (F.col("end") - F.col("start") + F.col("g1") - F.col("g0") - inter)
    return x.select("doc_id", "type", "p_ord", "g_ord", F.round(iou, 6).alias("iou")).where(F.col("iou") >= least)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's candidate pairs in order those of which both sides are free."""
    for batch in batches:
        rows, kept = [], []
        for i, pairs in enumerate(batch.column(1).to_pylist()):
            p_seen, g_seen = set(), set()
            for c in pairs:
                if c["p_ord"] not in p_seen and c["g_ord"] not in g_seen:
                    p_seen.add(c["p_ord"])
                    g_seen.add(c["g_ord"])
                    rows.append(i)
                    kept.append(c)
        kind = batch.column(1).type.value_type
        p, g = (pa.array([c[n] for c in kept], kind.field(n).type) for n in ("p_ord", "g_ord"))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), p, g], names=["doc_id", "p_ord", "g_ord"])


def partial_matches(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches among ``overlaps``, predictions in their order each taking the first
    free gold span (J11): one pass over a document's own candidate pairs."""
    x = overlaps(pred, gold, least)
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in ("doc_id", "p_ord", "g_ord"))
    x = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p_ord", "g_ord"))).alias("c"))
    return x.mapInArrow(_greedy, kinds)


def verdict(now: Column, base: Column) -> Column:
    """tie, better, worse or both_wrong; a missing baseline flag counts as right."""
    b = F.coalesce(base, F.lit(True))
    return F.when(now & b, "tie").when(now & ~b, "better").when(~now & b, "worse").otherwise("both_wrong")


def query_summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Validity and mean overlap over the valid rows of ``results (valid, jaccard, precision, recall)``."""
    g = results.groupBy(by) if by else results.groupBy()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("valid"), F.col(c))), F.lit(0.0)), 6).alias(f"mean_{c}")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("validity"), *[mean(c) for c in ("jaccard", "precision", "recall")])


def rollup_pass(results: DataFrame) -> DataFrame:
    """Passed and total by category, by category and subcategory, and overall."""
    x = results.rollup("category", "subcategory").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("int")).alias("passed"))
    return x.withColumn("rate", F.round(F.col("passed") / F.col("total"), 6))


def token_scores(rows: DataFrame) -> DataFrame:
    """``label, tp, fp, fn`` over ``(truth, guess)`` tags other than the ignored ones (A5): a wrong type is a
    false positive of its type and a false negative of the true one."""
    x = rows.where(F.col("truth") != "-100").select(F.explode(F.array(F.struct(F.col("truth").alias("label"), (F.col("truth") == F.col("guess")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("truth") != F.col("guess")).cast("int").alias("fn")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("tp"), (F.col("truth") != F.col("guess")).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("r")).select("r.*").where("label <> 'O'")
    x = x.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return x.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def annotation_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spans before and after by document and the change (J2, A11); a missing old row has none."""
    x = new.join(old.select("doc_id", F.col("spans").alias("old")), "doc_id", "left")
    a, b = F.coalesce(F.size("old"), F.lit(0)), F.size("spans")
    a = F.greatest(a, F.lit(0))
    return x.select("doc_id", a.alias("before"), b.alias("after"), (a - b).alias("removed"), F.round(F.coalesce(F.try_divide(100.0 * (a - b), a), F.lit(0.0)), 4).alias("reduction_pct"))


def running_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value))))


def case_passed(query: Column, behaviour: Column, expected: Column, forbidden: Column) -> Column:
    """Whether an answer to a golden case is as it should be (Z20): without forbidden pieces, or as the expected behaviour
    asks, or, where a query is expected, sound and with allowed values only. A case that expects nothing fails."""
    sound, values_ok = F.size(qlang.lint(query)) == 0, F.size(invalid_values(query)) == 0
    n_calls = F.size(qlang.calls(query))
    count = lambda c: F.length(query) - F.length(F.replace(query, F.lit(c), F.lit("")))
    as_asked = (
        F.when(behaviour == "no_operator", sound & (n_calls == 0))
        .when(behaviour == "single_operator", sound & (n_calls <= 1))
        .when(behaviour == "valid_response", sound | ~query.startswith("ERROR"))
        .when(behaviour == "balanced_parens", sound & (count("(") == count(")")))
        .when(behaviour.isin("valid_database_only", "valid_property_only"), sound & values_ok)
        .otherwise(sound)
    )
    clean = F.size(qlang.forbidden_found(query, forbidden)) == 0
    passed = F.when(F.size(forbidden) > 0, clean & sound).when(F.coalesce(behaviour, F.lit("")) != "", as_asked).when(F.coalesce(expected, F.lit("")) != "", sound & values_ok)
    return F.coalesce(passed, F.lit(False))
