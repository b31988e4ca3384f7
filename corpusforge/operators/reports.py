"""Small reports over datasets, predictions and evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import qlang
from .validate import bare_values, invalid_values


def dataset_stats(sets: dict[str, DataFrame]) -> DataFrame:
    """``source, category, n`` over named sets of examples."""
    out = None
    for name, df in sets.items():
        x = df.select(F.lit(name).alias("source"), F.coalesce("category", F.lit("unknown")).alias("category"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


def counts(tables: dict[str, DataFrame], sums: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``measure, n``: the rows of each table, and the sums of a column of others."""
    out = None
    for name, df, n in [*((k, v, F.count(F.lit(1))) for k, v in tables.items()), *((k, v, F.coalesce(F.sum(c), F.lit(0))) for k, (v, c) in (sums or {}).items())]:
        one = df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("measure"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def quality_report(pairs: DataFrame, query: str = "ads_query") -> DataFrame:
    """``measure, n``: examples, sound ones, errors, wrong values and bare text values."""
    q = F.col(query)
    x = pairs.select(qlang.lint(q).alias("e"), F.size(invalid_values(q)).alias("v"), F.size(bare_values(q)).alias("b"))
    one = x.agg(F.count(F.lit(1)).alias("examples"), F.sum((F.size("e") == 0).cast("long")).alias("sound"), F.sum("v").alias("wrong_values"), F.sum("b").alias("bare_values"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in one.columns])))


def prediction_stats(spans: DataFrame) -> DataFrame:
    """``type, spans, documents, mean_confidence, per_document`` of predicted spans, type null for all."""
    x = spans.rollup("type").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return x.withColumn("per_document", F.round(F.col("spans") / F.col("documents"), 4))


def linking_stats(links: DataFrame) -> DataFrame:
    """``match_type, n, pct``."""
    x = links.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))
    return x.join(F.broadcast(x.agg(F.sum("n").alias("total")))).select("match_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row ``rows, changed`` of a fix."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col(before).eqNullSafe(F.col(after))).cast("long")).alias("changed"))


def result_filter(results: DataFrame, view: str) -> DataFrame:
    """Evaluation rows ``(syntax_ok, semantic_ok)`` of one view: all, syntax, semantic, both."""
    bad_syntax, bad_meaning = ~F.coalesce("syntax_ok", F.lit(False)), ~F.coalesce("semantic_ok", F.lit(False))
    return results.where({"all": F.lit(True), "syntax": bad_syntax, "semantic": bad_meaning, "both": bad_syntax & bad_meaning}[view])


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key."""
    return df.where(F.col(key) == value).limit(1)


def examples_for_report(df: DataFrame, good: Column, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of either kind (W18): the feature is the limit. The rows are read once, and each
    task keeps its own first rows of a kind before they meet."""
    nth = F.row_number().over(Window.partitionBy("good").orderBy(order))
    x = df.withColumn("good", good).withColumn("_n", nth).where(F.col("_n") <= n)
    # A row that is neither good nor bad is no example; said of its place, as a test of ``good`` would be moved below the window and computed twice.
    return x.where(F.when(F.col("good").isNotNull(), F.col("_n")) <= n).drop("_n")


def apply_reviews(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs with the reviewed query where text and query are the reviewed ones."""
    r = reviews.groupBy("natural_language", "ads_query").agg(F.min("fixed_query").alias("_f"))
    return pairs.join(r, ["natural_language", "ads_query"], "left").withColumn("ads_query", F.coalesce("_f", "ads_query")).drop("_f")


def until_enough(make: Callable[[int], DataFrame], key: str, least_total: int, least_each: int, most_rounds: int = 20) -> DataFrame:
    """Rounds of generation by seed until the total and each value of ``key`` suffice (W14, Z14); an error
    if ``most_rounds`` don't. Each round's table should be stored by ``make``."""
    out = None
    for seed in range(most_rounds):
        x = make(seed)
        out = x if out is None else out.unionByName(x)
        n, least = out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.min("n")).first()
        if (n or 0) >= least_total and (least or 0) >= least_each:
            return out
    raise RuntimeError(f"{most_rounds} rounds gave {n or 0} rows, the rarest {key} {least or 0}: {least_total} and {least_each} were wanted")


def spot_check(records: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` records in the order of a hash, with their wrong spans."""
    from .annotate import offset_errors

    x = records.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))).limit(n)
    return x.withColumn("errors", offset_errors(F.col("text"), F.col("spans")))


def confidence(intent: Column) -> Column:
    """How sure the extraction of an intent is (N6): 0.9 with author, operator or years; 0.7 with other
    constraints or three topic words, 0.5 with two, else 0.3."""
    some = lambda *names: sum((F.size(intent[n]) for n in names), F.lit(0)) > 0
    words = F.aggregate(F.concat(intent["free_text_terms"], intent["or_terms"]), F.lit(0), lambda n, t: n + F.size(F.split(t, " ")))
    firm = some("authors") | intent["operator"].isNotNull() | intent["year_from"].isNotNull() | intent["year_to"].isNotNull()
    return F.when(firm, 0.9).when(some("property", "doctype", "bibgroup", "collection") | (words >= 3), 0.7).when(words >= 2, 0.5).otherwise(0.3)


def has_content(intent: Column) -> Column:
    """Whether an intent says anything."""
    lists = ("authors", "free_text_terms", "or_terms", "property", "doctype", "bibgroup", "collection")
    return (sum((F.size(intent[n]) for n in lists), F.lit(0)) > 0) | intent["year_from"].isNotNull() | intent["year_to"].isNotNull() | intent["operator"].isNotNull()
