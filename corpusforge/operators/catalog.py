"""Vocabulary records to catalog entries; hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import concept_id, path_id, safe_double
from ._stored import beside, store

_NONE = "cast(array() as array<string>)"


def distinct_aliases(label: Column, aliases: Column) -> Column:
    """Trimmed aliases without empty ones, repeats in other case, and the label itself, in order."""
    good = F.filter(F.transform(F.coalesce(aliases, F.expr(_NONE)), lambda a: F.trim(a)), lambda a: a != "")
    keep = lambda acc, a: F.exists(acc, lambda b: F.lower(b) == F.lower(a)) | (F.lower(a) == F.lower(label))
    return F.aggregate(good, F.expr(_NONE), lambda acc, a: F.when(keep(acc, a), acc).otherwise(F.concat(acc, F.array(a))))


def topics(raw: DataFrame) -> DataFrame:
    """Topic entries of concept records ``(uri, prefLabel, altLabels, broader, narrower)``; records without id or label go."""
    ids = lambda c: F.filter(F.transform(F.coalesce(c, F.expr(_NONE)), concept_id), lambda i: i.isNotNull() & (i != ""))
    x = raw.select(
        concept_id(F.col("uri")).alias("source_id"),
        F.trim("prefLabel").alias("label"),
        distinct_aliases(F.trim("prefLabel"), F.col("altLabels")).alias("aliases"),
        ids(F.col("broader")).alias("parents"),
        ids(F.col("narrower")).alias("children"),
    )
    return x.where("source_id is not null and label is not null and label <> ''").withColumn("id", F.concat(F.lit("uat:"), "source_id"))


def organizations(raw: DataFrame, active_only: bool = True) -> DataFrame:
    """Entity entries of registry records ``(id, status, names array<struct<value,types>>, locations, country)``
    (P13, P14, F29): the label is the display name, else an acronym, else any first name; a missing status is active."""
    of = lambda kind: F.filter("names", lambda n: F.array_contains(n["types"], kind))
    first = lambda a: F.get(a, F.lit(0))["value"]
    label = F.coalesce(first(of("ror_display")), first(of("label")), first(of("acronym")), F.get("names", F.lit(0))["value"])
    place = F.get(F.filter(F.transform("locations", lambda p: p["country_name"]), lambda c: c.isNotNull()), F.lit(0))
    x = raw.where(F.coalesce(F.lower("status"), F.lit("active")).isin("active") | F.lit(not active_only))
    x = x.select(F.concat(F.lit("ror:"), concept_id(F.col("id"))).alias("id"), label.alias("label"), distinct_aliases(label, F.transform("names", lambda n: n["value"])).alias("aliases"), F.coalesce(place, F.col("country")).alias("country"))
    return x.where("label is not null")


def planetary(raw: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Feature entries of gazetteer rows ``(feature_id, clean_name, target, type, diameter, center_lat, center_lon, approval)``; the first row
    of an id counts (P12, W6, X23)."""
    x = raw.where(F.lower("target").isin([t.lower() for t in targets])) if targets else raw
    x = x.select(
        F.concat(F.lit("planetary:"), F.lower("target"), F.lit(":"), F.trim(F.col("feature_id").cast("string"))).alias("id"),
        F.trim("clean_name").alias("label"),
        F.lower(F.trim(F.split_part("type", F.lit(","), F.lit(1)))).alias("feature_type"),
        *[safe_double(F.col(c).cast("string")).alias(c) for c in ("diameter", "center_lat", "center_lon")],
        "ord",
    )
    x = x.where("label is not null and label <> ''")
    return x.groupBy("id").agg(F.min_by(F.struct("label", "feature_type", "diameter", "center_lat", "center_lon"), "ord").alias("r")).select("id", "r.*")


def tree_paths(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``id, path, depth, path_id`` of every node under the roots of ``edges (id, parent, name)``, of any depth.

    Each round joins a node with its ancestor, whose path goes in front of its own, so the stretch
    that is known doubles: a tree of depth n takes log2(n) joins. Nodes whose line ends at an id that
    isn't there are left out; a cycle is an error. An id with several parents has a path by each."""
    x = store(edges.select("id", F.col("parent").alias("up"), F.array("name").alias("path")), "tree")
    done, rounds, most = x.where("up is null"), 0, max(2, x.count()).bit_length() + 1
    open_ = x.where("up is not null")
    while not open_.isEmpty():
        if rounds > most:
            raise ValueError("parents form a cycle")
        above = x.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        nxt = store(open_.join(above, "up").select("id", F.col("next").alias("up"), F.concat("before", "path").alias("path")), "tree")
        x = done.unionByName(nxt)
        done, open_ = x.where("up is null"), nxt.where("up is not null")
        rounds += 1
    out = done.select("id", "path", (F.size("path") - 1).alias("depth"))
    return out.withColumn("path_id", path_id(F.col("path")))


def triples_to_entries(triples: DataFrame) -> DataFrame:
    """``id, label, parents, children`` of an ontology's ``(s, p, o)`` rows (P16): the label is the preferred one, else any label."""
    short = F.element_at(F.split("p", "[/#]"), -1)
    x = triples.withColumn("p", short)
    of = lambda *ps: F.array_sort(F.collect_set(F.when(F.col("p").isin(*ps), F.col("o"))))
    x = x.groupBy("s").agg(F.min(F.when(F.col("p") == "prefLabel", F.col("o"))).alias("pref"), F.min(F.when(F.col("p") == "label", F.col("o"))).alias("any"), of("subClassOf", "broader").alias("parents"), of("narrower").alias("children"))
    x = x.withColumn("label", F.coalesce("pref", "any", F.regexp_replace(concept_id(F.col("s")), r"([a-z])([A-Z])", "$1 $2")))
    down = triples.withColumn("p", short).where(F.col("p").isin("subClassOf", "broader")).groupBy(F.col("o").alias("s")).agg(F.collect_set(F.col("s")).alias("down"))
    x = x.join(down, "s", "left").withColumn("children", F.array_sort(F.array_union("children", F.coalesce("down", F.expr(_NONE)))))
    return x.select(F.concat(F.lit("sweet:"), concept_id(F.col("s"))).alias("id"), "label", "parents", "children")


def classify_entries(entries: DataFrame, stopwords: list[str], common: DataFrame) -> DataFrame:
    """``entries`` with ``reason`` (F17): too short, stopword, frequent single word, or kept; ``borderline``
    for kept labels of four to six letters. ``common (word)`` is the table of frequent words."""
    x = entries.withColumn("_l", F.lower(F.trim("label")))
    x = x.join(beside(common.select(F.lower("word").alias("_l"), F.lit(True).alias("_c")).distinct()), "_l", "left")
    reason = F.when(F.length("_l") < 4, "too_short").when(F.col("_l").isin(*stopwords), "stopword").when(F.coalesce("_c", F.lit(False)), "high_frequency").otherwise("kept")
    return x.withColumn("reason", reason).withColumn("borderline", (F.col("reason") == "kept") & F.length("_l").between(4, 6)).drop("_l", "_c")
