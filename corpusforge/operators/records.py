"""Record conversions: pairs, chat examples, labels, annotated rows, abstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_md5, strip_html
from .enrich import domains_of, vocabulary_of

SYSTEM = 'Convert natural language to ADS search query. Output JSON: {"query": "..."}'


def _first(df: DataFrame, *names: str) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit("")) if have else F.lit("")


def normalize_pairs(df: DataFrame) -> DataFrame:
    """``natural_language, ads_query, category`` from either naming of the columns."""
    category = F.coalesce("category", F.lit("unknown")) if "category" in df.columns else F.lit("unknown")
    return df.select(_first(df, "natural_language", "nl").alias("natural_language"), _first(df, "ads_query", "query").alias("ads_query"), category.alias("category"))


def to_chat(pairs: DataFrame, date: str = "2025-12-15") -> DataFrame:
    """``messages`` of a training example."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.concat(F.lit("Query: "), "natural_language", F.lit(f"\nDate: {date}"))
    answer = F.concat(F.lit('{"query": '), F.expr("regexp_extract(to_json(named_struct('q', ads_query)), '^\\\\{\"q\":(.*)\\\\}$', 1)"), F.lit("}"))
    return pairs.select(F.array(said("system", F.lit(SYSTEM)), said("user", user), said("assistant", answer)).alias("messages"))


def from_pair_labels(rows: DataFrame) -> DataFrame:
    """Enrichment records of labelled pairs ``(example_id, user_text, labels)``: confidence 0.9, spans where the place is known."""
    ok = F.filter("labels", lambda v: v["start_char"].isNotNull() & v["end_char"].isNotNull())
    spans = F.transform(ok, lambda v: F.struct(v["text_span"].alias("surface"), v["start_char"].alias("start"), v["end_char"].alias("end"), v["entity_type"].alias("type"), v["entity_id"].alias("canonical_id"), vocabulary_of(v["entity_id"]).alias("source_vocabulary"), F.lit(0.9).alias("confidence")))
    topics = F.transform(F.filter("labels", lambda v: v["entity_type"] == "topic"), lambda v: F.struct(v["entity_id"].alias("concept_id"), v["text_span"].alias("label"), vocabulary_of(v["entity_id"]).alias("source_vocabulary"), F.lit(0.9).alias("confidence")))
    return rows.select(short_md5(F.lit("pair"), F.col("example_id").cast("string")).alias("id"), F.col("user_text").alias("text"), F.lit("user_query").alias("text_type"), spans.alias("spans"), topics.alias("topics"))


def from_annotations(rows: DataFrame, prefix: str = "annotated") -> DataFrame:
    """Enrichment records of reviewed abstracts ``(bibcode, abstract_clean, spans)``, topics once by concept, with domains."""
    spans = F.transform("spans", lambda s: F.struct(s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["canonical_id"].alias("canonical_id"), F.coalesce(s["source_vocabulary"], vocabulary_of(s["canonical_id"])).alias("source_vocabulary"), F.coalesce(s["confidence"], F.lit(1.0)).alias("confidence")))
    x = rows.select(short_md5(F.lit(prefix), F.col("bibcode")).alias("id"), F.col("abstract_clean").alias("text"), F.lit("abstract").alias("text_type"), spans.alias("spans"))
    named = F.filter("spans", lambda s: (s["type"] == "topic") & s["canonical_id"].isNotNull())
    seen = lambda acc, s: F.exists(acc, lambda t: t["canonical_id"] == s["canonical_id"])
    once = F.aggregate(named, F.expr("filter(spans, s -> false)"), lambda acc, s: F.when(seen(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    topics = F.transform(once, lambda s: F.struct(s["canonical_id"].alias("concept_id"), s["surface"].alias("label"), s["source_vocabulary"].alias("source_vocabulary"), s["confidence"].alias("confidence")))
    return x.withColumn("topics", topics).withColumn("domains", domains_of(F.transform("spans", lambda s: s["source_vocabulary"])))


def parse_abstracts(docs: DataFrame, domain: str) -> DataFrame:
    """Abstract records of API documents; those without an abstract go (P10), and the clean text."""
    x = docs.where(F.coalesce("abstract", F.lit("")).isin("", "Not Available") == F.lit(False))
    title = F.coalesce(F.get("title", F.lit(0)), F.lit(""))
    return x.select("bibcode", title.alias("title"), "abstract", strip_html(F.col("abstract")).alias("abstract_clean"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.lit(domain).alias("domain_category"))


def unit(vector: Column) -> Column:
    """A vector of length one; a zero vector stays (M5)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda v: v.cast("double") / norm)).otherwise(F.transform(vector, lambda v: v.cast("double")))


def extract_log(log: DataFrame, category: str, target: int, column: str = "query") -> DataFrame:
    """Distinct decoded log queries of a category, ``target`` of them in the order of a hash."""
    from .curate import clean_log_query, log_category, skip_query

    x = log.select(clean_log_query(F.coalesce(F.try_url_decode(F.col(column)), F.col(column))).alias("query")).where(F.length("query").between(3, 300)).distinct()
    x = x.where(~skip_query(F.col("query")) & (log_category(F.col("query")) == category))
    return x.orderBy(F.md5(F.col("query").cast("binary")), "query").limit(target)
