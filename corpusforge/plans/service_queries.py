"""Queries over services, sinks and ontologies: what they read is derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog
from ..operators._stored import shared_dir
from ..sources import hashed, rdfxml, search
from ..streaming import limits, streams
from . import base
from .base import PAIRS_SQL, table

_RULED = "corpusforge.sources.search:ruled"
_STORED = "corpusforge.sources.search:stored"


def _service(spark, ranked, sort: str) -> dict:
    """A service that answers from ``ranked (query, bibcode, abstract, size)``: the pages that can be asked for."""
    folder = shared_dir(spark, "answers")
    found = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    order = Window.partitionBy("query").orderBy("size", "bibcode")
    most = _WANTED * search.OVER_FETCH * search.PAGES
    top = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    doc = F.to_json(F.struct(F.col("bibcode").cast("string").alias("bibcode"), "abstract"))
    search.store_answers(top.join(F.broadcast(found), "query").select("query", (F.col("nth") - 1).alias("rank"), "found", doc.alias("doc")), folder, sort)
    return {"folder": folder}


_WANTED = 25


def search_sample(spark, sf):
    """Abstracts by language, then of any language, from the pages of a service."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("bibcode"), "lang", "text", F.col("n_chars").alias("size"))
    abstract = F.when(F.col("bibcode") % 17 == 0, None).when(F.col("bibcode") % 13 == 0, "Not Available").otherwise(F.col("text"))
    d = d.select(F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.lit("lang:*"))).alias("query"), "bibcode", abstract.alias("abstract"), "size")
    service = _service(spark, d, "size asc")
    queries = [{"name": n, "query": f"lang:{n}", "wanted": _WANTED} for n in ("de", "en", "es", "fr", "*")]
    pages = search.pages(spark, queries, _STORED, service, sort="size asc", delay=0)
    return search.sample(pages, queries).select("name", "rank", "bibcode")


_SAMPLE_SQL = f"""WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'Not Available' ELSE text END AS abstract, n_chars FROM documents),
  q AS (SELECT lang AS name, * FROM d UNION ALL SELECT '*', * FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_chars, doc_id) - 1 AS rank FROM q WHERE name IN ('de', 'en', 'es', 'fr', '*') QUALIFY rank < {_WANTED * 9}),
  k AS (SELECT name, rank, doc_id FROM r WHERE abstract IS NOT NULL AND abstract <> 'Not Available' AND length(abstract) >= 100),
  l AS (SELECT * FROM k WHERE name <> '*' QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) <= {_WANTED}),
  a AS (SELECT * FROM k WHERE name = '*' AND doc_id NOT IN (SELECT doc_id FROM l) QUALIFY row_number() OVER (ORDER BY rank) <= {_WANTED})
  SELECT name, rank::INTEGER AS rank, doc_id::VARCHAR AS bibcode FROM (SELECT * FROM l UNION ALL SELECT * FROM a)"""


def result_sets(spark, sf):
    """The first 20 documents of each source, asked of a service for every label's document."""
    d = table(spark, sf, "documents")
    service = _service(spark, d.select("source", F.col("doc_id").alias("bibcode"), F.lit("").alias("abstract"), (-F.col("n_chars")).alias("size")).withColumn("query", F.concat(F.lit("source:"), "source")), "score desc")
    asked = table(spark, sf, "labels").join(d.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.concat(F.lit("source:"), F.col("source")).alias("query"))
    return search.result_sets(asked, 20, _STORED, service).groupBy("rank", "bibcode").agg(F.count(F.lit(1)).alias("times"))


_SETS_SQL = """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20)
  SELECT r.rank::INTEGER AS rank, r.doc_id::VARCHAR AS bibcode, count(*) AS times FROM labels JOIN documents d USING (doc_id) JOIN r USING (source) GROUP BY r.rank, r.doc_id"""


def remote_checks(spark, sf):
    """Queries that a service accepts, accepts in vain or refuses, and those that it is never asked about."""
    p = base.pairs(spark, sf).select("id", F.when(F.col("id") % 10 == 9, F.concat("ads_query", F.lit("("))).otherwise(F.col("ads_query")).alias("query"))
    rules = [["trending", 200, 0, ""], ["memo", 400, 0, "unknown doctype"], ["citations", 429, 0, ""], ["#0*[0-9]*5\\b", 500, 0, ""], ["Refereed", 401, 0, ""], ["eprint", 400, 0, ""]]
    x = search.remote_check(p, _RULED, {"rules": rules}, back_off=0.0, retries=1)
    return x.groupBy("valid", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("warning", F.lit("")).alias("warning")).agg(F.count(F.lit(1)).alias("n"))


_REMOTE_SQL = (
    "WITH "
    + PAIRS_SQL
    + r""", c AS (SELECT id, CASE WHEN id % 10 = 9 THEN 'Unbalanced parentheses' WHEN contains(ads_query, 'trending') THEN '' WHEN contains(ads_query, 'memo') THEN 'parse error: unknown doctype'
    WHEN contains(ads_query, 'citations') THEN 'API rate limit exceeded' WHEN regexp_matches(ads_query, '#0*[0-9]*5\b') THEN 'API error: HTTP 500' WHEN contains(ads_query, 'Refereed') THEN 'Invalid API key' WHEN contains(ads_query, 'eprint') THEN 'parse error: Unknown parse error' ELSE '' END AS error,
    CASE WHEN id % 10 <> 9 AND contains(ads_query, 'trending') THEN 'Query returned 0 results' ELSE '' END AS warning FROM pairs)
  SELECT error = '' AS valid, error, warning, count(*) AS n FROM c GROUP BY ALL"""
)


def rate_limited_validation(spark, sf):
    """Requests of five accounts through token buckets and caches that a stream keeps."""
    limits.state_store(spark)
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 1e6
    query = F.concat(F.lit("user:"), "user_id", F.lit(" k:"), F.col("event_id") % 7)
    events = spark.read.parquet(f"{sf}/events.parquet")
    x = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")  # a pattern, as a stream takes no single file
    x = x.select(F.col("event_type").alias("account"), F.col("event_id").alias("id"), query.alias("query"), at.alias("at"))
    x = limits.validated(x, _RULED, {"rules": [["k:3", 400, 0, "k"], ["k:5", 200, 0, ""]]}, rate=0.001)
    out = shared_dir(spark, "validated")
    streams.run_to_table(x, out, shared_dir(spark, "validated-state"))
    return spark.read.parquet(out).select("account", "id", "tier", "from_cache", F.round("waited", 2).alias("waited"))


_LIMIT_SQL = """WITH RECURSIVE e AS (SELECT event_type AS account, event_id AS id, user_id, event_id % 7 AS k, (epoch_us(ts) - 1704067200000000) / 1e6 AS due FROM events),
  h AS (SELECT *, row_number() OVER (PARTITION BY account, user_id, k ORDER BY due, id) > 1 AS hit FROM e),
  m AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY due, id) AS n FROM h WHERE NOT hit),
  b AS (
    SELECT account, id, n, due, 9.0::DOUBLE AS tokens, due AS last FROM m WHERE n = 1
    UNION ALL
    SELECT account, id, n, due, CASE WHEN t >= 1 THEN t - 1 ELSE 0 END, CASE WHEN t >= 1 THEN now ELSE now + (1 - t) / 0.001 END
    FROM (SELECT m.account, m.id, m.n, m.due, greatest(m.due, b.last) AS now, least(10.0, b.tokens + (greatest(m.due, b.last) - b.last) * 0.001) AS t FROM b JOIN m ON m.account = b.account AND m.n = b.n + 1)
  )
  SELECT h.account, h.id, CASE k WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS tier, hit AS from_cache, round(coalesce(last - b.due, 0.0), 2) AS waited FROM h LEFT JOIN b ON h.account = b.account AND h.id = b.id"""


def hashed_shards(spark, sf):
    """Documents without their texts as JSON lines, a file for each thousand ids, and whether the files still have their digests (K1 to K4, K8)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / 1000).alias("shard"))
    out = shared_dir(spark, "lines")
    hashed.write_lines(d, out, "doc_id", "shard", one_file=True)
    return hashed.verified(spark, out).select(F.col("part").alias("shard"), "lines", "bytes", "sha256", "sound")


_HASHED_SQL = """WITH l AS (SELECT doc_id, doc_id // 1000 AS shard, '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"shard":' || (doc_id // 1000) || '}' || chr(10) AS line FROM documents),
  t AS (SELECT shard, count(*) AS lines, string_agg(line, '' ORDER BY doc_id) AS body FROM l GROUP BY shard)
  SELECT shard::VARCHAR AS shard, lines, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256, true AS sound FROM t"""


def ontology_rdfxml(spark, sf):
    """Entries of an ontology that comes as RDF/XML documents of a hundred classes."""
    head = '<?xml version="1.0"?><!DOCTYPE r [<!ENTITY o "http://o.org/x">]><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xml:base="&o;">'
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, F.format_string('><rdfs:label xml:lang="en">%s &amp; co</rdfs:label>', "p_name")).when(k % 3 == 1, F.format_string(' rdfs:label="%s">', "p_name")).otherwise(F.format_string("><rdfs:label><![CDATA[%s]]></rdfs:label><skos:prefLabel>P%s</skos:prefLabel>", "p_name", k))
    kind = F.format_string('<rdfs:subClassOf rdf:resource="#T%s"/>', "p_type")
    size = F.format_string('<rdfs:subClassOf><owl:Class rdf:ID="S%s"><rdfs:label>size %s</rdfs:label></owl:Class></rdfs:subClassOf>', "p_size", "p_size")
    element = F.concat(F.format_string('<owl:Class rdf:about="#C%s"', k), label, kind, F.when(k % 2 == 0, size).otherwise(""), F.lit("</owl:Class>"))
    docs = table(spark, sf, "part").groupBy(F.floor(k / 100).alias("doc")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(element)), ""), F.lit("</rdf:RDF>")).alias("value"))
    x = catalog.triples_to_entries(rdfxml.triples(docs))
    return x.select("id", "label", F.array_join("parents", " ").alias("parents"), F.size("children").alias("n_children"))


_RDF_SQL = """WITH t AS (SELECT 'C' || p_partkey AS s, CASE p_partkey % 3 WHEN 0 THEN p_name || ' & co' WHEN 1 THEN p_name ELSE 'P' || p_partkey END AS label,
    array_to_string(list_sort(CASE WHEN p_partkey % 2 = 0 THEN ['http://o.org/x#T' || p_type, 'http://o.org/x#S' || p_size] ELSE ['http://o.org/x#T' || p_type] END), ' ') AS parents FROM part)
  SELECT 'sweet:' || s AS id, label, parents, 0 AS n_children FROM t
  UNION ALL SELECT 'sweet:S' || p_size, 'size ' || p_size, '', count(*)::INTEGER FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size"""


QUERIES = {
    "search_sample": (search_sample, _SAMPLE_SQL),
    "result_sets": (result_sets, _SETS_SQL),
    "remote_checks": (remote_checks, _REMOTE_SQL),
    "rate_limited_validation": (rate_limited_validation, _LIMIT_SQL),
    "hashed_shards": (hashed_shards, _HASHED_SQL),
    "ontology_rdfxml": (ontology_rdfxml, _RDF_SQL),
}
