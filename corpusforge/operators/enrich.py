"""Enrichment records: conversion, coverage and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_md5
from .curate import keep_first

# Id prefixes of the vocabularies, and the domain of each.
DOMAINS = {"uat": "astronomy", "sweet": "earthscience", "gcmd": "earthscience", "ror": "multidisciplinary", "planetary": "planetary"}


def vocabulary_of(identifier: Column) -> Column:
    """The vocabulary that an id's prefix names, else ``unknown`` (P5)."""
    head = F.lower(F.split_part(identifier, F.lit(":"), F.lit(1)))
    return F.when(head.isin(*DOMAINS), head).otherwise("unknown")


def domains_of(vocabularies: Column) -> Column:
    """Sorted distinct domains, ``unknown`` if there is none."""
    table = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    found = F.array_sort(F.array_distinct(F.filter(F.transform(vocabularies, lambda v: F.element_at(table, v)), lambda d: d.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def from_snippets(snippets: DataFrame) -> DataFrame:
    """Records of generated snippets: spans with confidence 1, topics from topic spans."""
    spans = F.transform("spans", lambda s: F.struct(s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["canonical_id"].alias("canonical_id"), vocabulary_of(s["canonical_id"]).alias("source_vocabulary"), F.lit(1.0).alias("confidence")))
    x = snippets.select(short_md5(F.lit("snippet"), F.col("id").cast("string")).alias("id"), "text", F.lit("snippet").alias("text_type"), spans.alias("spans"))
    return x.withColumn("topics", F.array_distinct(F.transform(F.filter("spans", lambda s: s["type"] == "topic"), lambda s: F.struct(s["canonical_id"].alias("concept_id"), s["surface"].alias("label"), s["source_vocabulary"].alias("source_vocabulary"), F.lit(1.0).alias("confidence")))))


def slot_labels(user_text: Column, slots: Column) -> Column:
    """A label for each slot ``(name, value)``: type by the slot's name, the place of the value in the text."""

    def label(s: Column) -> Column:
        n = F.lower(s["name"])
        kind = F.when(n.rlike("topic|subject|concept"), "topic").when(n.rlike("author"), "author").when(n.rlike("inst|aff|entity"), "institution").when(n.rlike("date"), "date_range")
        at = F.instr(F.lower(user_text), F.lower(s["value"])) - 1
        start = F.when(at >= 0, at)
        ident = F.concat(kind, F.lit(":"), F.replace(F.lower(s["value"]), F.lit(" "), F.lit("_")))
        return F.struct(ident.alias("entity_id"), kind.alias("entity_type"), s["value"].alias("text_span"), start.alias("start_char"), (start + F.length(s["value"])).alias("end_char"))

    return F.filter(F.transform(slots, label), lambda x: x["entity_type"].isNotNull())


def build(records: DataFrame) -> DataFrame:
    """Records with spans or topics, one for each text, the first by ``ord``."""
    x = records.where((F.size("spans") > 0) | (F.size("topics") > 0))
    return keep_first(x, F.md5(F.col("text").cast("binary")), "ord")


def coverage(records: DataFrame) -> DataFrame:
    """``dimension, value, n``: records by text type, spans by type, vocabulary mentions over spans and topics, and over spans only."""
    kinds = records.select(F.lit("text_type").alias("dimension"), F.col("text_type").alias("value"))
    spans = records.select(F.explode("spans").alias("s"))
    by_type = spans.select(F.lit("span_type").alias("dimension"), F.col("s.type").alias("value"))
    vocab = records.select(F.explode(F.concat(F.transform("spans", lambda s: s["source_vocabulary"]), F.transform("topics", lambda t: t["source_vocabulary"]))).alias("value")).select(F.lit("vocabulary").alias("dimension"), "value")
    only = spans.select(F.lit("span_vocabulary").alias("dimension"), F.col("s.source_vocabulary").alias("value"))
    x = kinds.unionByName(by_type).unionByName(vocab).unionByName(only)
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def group_by_domain(entries: DataFrame) -> DataFrame:
    """One row per domain tag of an entry, ``untagged`` if there is none."""
    tags = F.when(F.size(F.coalesce("domain_tags", F.expr("cast(array() as array<string>)"))) == 0, F.array(F.lit("untagged"))).otherwise(F.col("domain_tags"))
    return entries.withColumn("domain", F.explode(tags))
