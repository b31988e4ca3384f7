"""Queries over spans, catalogs, links and enrichment records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import acronym, strip_diacritics, strip_punctuation, swap_hyphen_space
from ..operators import alias, annotate, catalog, enrich, evaluate, generate, link
from .base import PAIRS_SQL, table
from .text_queries import _SPANS


def _words(spark, sf):
    """Word spans of the benchmark: ``doc_id, ord, start, end, type, word``, cut by their lengths."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.split("text", " ").alias("ws"))
    ends = F.aggregate("ws", F.expr("cast(array() as array<int>)"), lambda a, w: F.concat(a, F.array((F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) + 1 + F.length(w)).cast("int"))))
    x = b.select("doc_id", F.posexplode(F.arrays_zip("ws", ends.alias("e"))).alias("ord", "w"))
    n = F.length("word")
    return x.select("doc_id", "ord", F.col("w.ws").alias("word"), F.col("w.e").alias("end")).select("doc_id", "ord", (F.col("end") - n).alias("start"), "end", F.when(n % 3 == 0, "topic").when(n % 3 == 1, "author").otherwise("institution").alias("type"), "word")


_WORDS = """w AS (SELECT item_id AS doc_id, unnest(range(len(string_split(text, ' ')))) AS ord, unnest(string_split(text, ' ')) AS word FROM benchmark),
  s AS (SELECT doc_id, ord, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS e FROM w),
  g AS (SELECT doc_id, ord, (e - length(word))::INTEGER AS start, e::INTEGER AS "end", CASE length(word) % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'author' ELSE 'institution' END AS type, word FROM s)"""
#: Predicted spans: every fifth is missing, every seventh has another type, every eleventh is two longer.
_PRED = """p AS (SELECT doc_id, ord, start, CASE WHEN ord % 11 = 3 THEN "end" + 2 ELSE "end" END AS "end", CASE WHEN ord % 7 = 2 THEN 'topic' ELSE type END AS type FROM g WHERE ord % 5 <> 4)"""


def _predicted(gold):
    end = F.when(F.col("ord") % 11 == 3, F.col("end") + 2).otherwise(F.col("end"))
    return gold.where("ord % 5 <> 4").withColumn("end", end).withColumn("type", F.when(F.col("ord") % 7 == 2, "topic").otherwise(F.col("type"))).drop("word")


def span_prf_by_type(spark, sf):
    g = _words(spark, sf)
    return evaluate.span_scores(_predicted(g), g)


_PRF_SQL = f"""WITH {_WORDS}, {_PRED}, k AS (SELECT doc_id, start, "end", type, 1 AS p, 0 AS g FROM p UNION ALL SELECT doc_id, start, "end", type, 0, 1 FROM g),
  c AS (SELECT type, sum(p) AS p, sum(g) AS g FROM k GROUP BY doc_id, start, "end", type),
  r AS (SELECT coalesce(type, '(all)') AS type, sum(least(p, g)) AS tp, sum(greatest(p - g, 0)) AS fp, sum(greatest(g - p, 0)) AS fn FROM c GROUP BY ROLLUP (type))
  SELECT type, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM r"""


def span_iou_candidates(spark, sf):
    g = _words(spark, sf)
    return evaluate.overlaps(_predicted(g), g)


_IOU_SQL = f"""WITH {_WORDS}, {_PRED}, x AS (SELECT p.doc_id, p.type, p.ord AS p_ord, g.ord AS g_ord, least(p."end", g."end") - greatest(p.start, g.start) AS i, p."end" - p.start AS a, g."end" - g.start AS b
  FROM p JOIN g ON p.doc_id = g.doc_id AND p.type = g.type AND p.start < g."end" AND g.start < p."end")
  SELECT doc_id, type, p_ord, g_ord, round(i / (a + b - i), 6) AS iou FROM x WHERE i / (a + b - i) >= 0.5"""


def _phrases(spark, sf):
    """Phrases of one to five words from every word on, so that they nest and cross, and guesses that begin or end a word off."""
    g = _words(spark, sf).select("doc_id", "ord", "start", "end")
    last = g.select("doc_id", F.col("ord").alias("last"), F.col("end").alias("last_end"))
    p = g.withColumn("last", F.col("ord") + F.col("ord") % 5).join(last, ["doc_id", "last"])
    gold = p.select("doc_id", "ord", "start", F.col("last_end").alias("end"), F.when(F.col("ord") % 7 < 4, "x").otherwise("y").alias("type"))
    guess = gold.where("ord % 6 <> 5").withColumn("start", F.when(F.col("ord") % 4 == 1, F.greatest(F.col("start") - 6, F.lit(0))).otherwise(F.col("start")))
    return guess.withColumn("end", F.when(F.col("ord") % 3 == 1, F.col("end") + 5).otherwise(F.col("end"))), gold


def span_iou_match(spark, sf):
    return evaluate.partial_matches(*_phrases(spark, sf), 0.4)


_MATCH_SQL = f"""WITH RECURSIVE {_WORDS}, gold AS (SELECT a.doc_id, a.ord, a.start, b."end", CASE WHEN a.ord % 7 < 4 THEN 'x' ELSE 'y' END AS type FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.ord = a.ord + a.ord % 5),
  guess AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 1 THEN greatest(start - 6, 0) ELSE start END AS start, CASE WHEN ord % 3 = 1 THEN "end" + 5 ELSE "end" END AS "end", type FROM gold WHERE ord % 6 <> 5),
  x AS (SELECT p.doc_id, p.ord AS p_ord, g.ord AS g_ord, least(p."end", g."end") - greatest(p.start, g.start) AS i, p."end" - p.start + g."end" - g.start AS total
    FROM guess p JOIN gold g ON p.doc_id = g.doc_id AND p.type = g.type AND p.start < g."end" AND g.start < p."end"),
  c AS (SELECT doc_id, p_ord, list(g_ord ORDER BY g_ord) AS gs, row_number() OVER (PARTITION BY doc_id ORDER BY p_ord) AS n FROM x WHERE round(i / (total - i), 6) >= 0.4 GROUP BY doc_id, p_ord),
  f AS (
    SELECT doc_id, 0::BIGINT AS n, -1::BIGINT AS p_ord, NULL::BIGINT AS g_ord, []::BIGINT[] AS taken FROM (SELECT DISTINCT doc_id FROM c)
    UNION ALL
    SELECT doc_id, n, p_ord, free[1], CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END
    FROM (SELECT c.doc_id, c.n, c.p_ord, f.taken, list_filter(c.gs, lambda v: NOT list_contains(f.taken, v)) AS free FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
  )
  SELECT doc_id, p_ord, g_ord FROM f WHERE g_ord IS NOT NULL"""


def bio_islands(spark, sf):
    """Spans of a tag table made from word types: B- opens, I- goes on (M3)."""
    g = _words(spark, sf)
    tag = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("B-"), "type")).when(F.col("ord") % 4 == 3, "O").otherwise(F.concat(F.lit("I-"), "type"))
    t = g.select("doc_id", F.col("ord").alias("pos"), "start", "end", tag.alias("tag"), (1.0 / (F.col("ord") + 1)).alias("confidence"))
    return annotate.bio_islands(t).withColumn("confidence", F.round("confidence", 6))


_BIO_SQL = f"""WITH {_WORDS}, t AS (SELECT doc_id, ord AS pos, start, "end", CASE ord % 4 WHEN 0 THEN 'B' WHEN 3 THEN 'O' ELSE 'I' END AS h, type, 1.0 / (ord + 1) AS confidence FROM g),
  l AS (SELECT *, CASE WHEN h = 'O' THEN '' ELSE type END AS k, lag(h) OVER w AS h0, lag(CASE WHEN h = 'O' THEN '' ELSE type END) OVER w AS k0 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  c AS (SELECT *, CASE WHEN h = 'I' AND k = k0 AND h0 <> 'O' THEN 0 ELSE 1 END AS cut FROM l),
  i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c)
  SELECT doc_id, min(k) AS type, min(start) AS start, max("end") AS "end", round(arg_min(confidence, pos), 6) AS confidence FROM i GROUP BY doc_id, island HAVING max((cut = 1 AND h = 'B')::INTEGER) = 1"""


def token_metrics(spark, sf):
    g = _words(spark, sf)
    guess = F.when(F.col("ord") % 7 == 2, "topic").when(F.col("ord") % 5 == 4, "O").otherwise(F.col("type"))
    return evaluate.token_scores(g.select(F.col("type").alias("truth"), guess.alias("guess")))


_TOKEN_SQL = f"""WITH {_WORDS}, t AS (SELECT type AS a, CASE WHEN ord % 7 = 2 THEN 'topic' WHEN ord % 5 = 4 THEN 'O' ELSE type END AS b FROM g),
  r AS (SELECT a AS label, (a = b)::INTEGER AS tp, 0 AS fp, (a <> b)::INTEGER AS fn FROM t UNION ALL SELECT b, 0, (a <> b)::INTEGER, 0 FROM t),
  z AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM r WHERE label <> 'O' GROUP BY label)
  SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM z"""


def reannotation_delta(spark, sf):
    """Spans of documents by two vocabularies, before and after."""
    from .text_queries import _vocabulary

    d, v = table(spark, sf, "documents").select("doc_id", "text"), _vocabulary(spark, sf)
    old = annotate.annotate(d, annotate.keyword_index(v))
    new = annotate.annotate(d, annotate.keyword_index(v.where("ord >= 10")))
    return evaluate.annotation_delta(old, new)


def _entries(spark, sf):
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    return p.select(F.concat(F.lit("uat:"), F.col("ord").cast("string")).alias("id"), F.col("p_name").alias("label"), F.array(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("aliases"), F.lit("topic").alias("type"), "ord")


def _mentions(spark, sf):
    """Part names as mentions: as they are, with hyphens, with a letter left out, or of another type."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k % 4 == 2, F.expr("substring(p_name, 2)")).otherwise(F.col("p_name"))
    return p.select(k.alias("span_id"), s.alias("surface"), F.when(k % 4 == 3, "author").otherwise("topic").alias("type"))


def link_exact(spark, sf):
    return link.link_exact(_mentions(spark, sf), link.linking_index(_entries(spark, sf))).select("span_id", "canonical_id", "match_type")


_MENTIONS = """m AS (SELECT p_partkey AS span_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN substr(p_name, 2) ELSE p_name END AS surface, CASE WHEN p_partkey % 4 = 3 THEN 'author' ELSE 'topic' END AS type FROM part),
  e AS (SELECT p_name, min(p_partkey) AS ord FROM part GROUP BY p_name), x AS (SELECT lower(p_name) AS s, ord FROM e UNION SELECT lower(replace(p_name, ' ', '-')), ord FROM e)"""


#: A name without its first letter is as similar to the whole one as (2n - 2) / (2n - 1), which is enough from four letters on; nothing has the type of the fourth kind.
_CASCADE = """c AS (SELECT span_id, CASE WHEN type = 'topic' AND lower(surface) IN (SELECT s FROM x) THEN 'exact' WHEN type = 'topic' THEN 'fuzzy' ELSE 'unlinked' END AS match_type FROM m)"""


def link_cascade(spark, sf):
    return link.link_cascade(_mentions(spark, sf), link.linking_index(_entries(spark, sf))).select("span_id", "canonical_id", "match_type")


#: What is like a name without its first letter is that name more than any other.
_CASCADE_SQL = f"""WITH {_MENTIONS}, {_CASCADE}, f AS (SELECT s, min(ord) AS ord FROM x GROUP BY s), o AS (SELECT p_partkey AS span_id, e.ord FROM part JOIN e USING (p_name))
  SELECT c.span_id, CASE match_type WHEN 'exact' THEN 'uat:' || f.ord WHEN 'fuzzy' THEN 'uat:' || o.ord END AS canonical_id, match_type
  FROM c JOIN m ON c.span_id = m.span_id JOIN o ON o.span_id = c.span_id LEFT JOIN f ON f.s = lower(m.surface)"""


def embed_argmax(spark, sf):
    """The best catalog vector of each vector's label, among every 25th."""
    e = table(spark, sf, "embeddings")
    cat = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("canonical_id"), F.col("label").alias("type"), "embedding", F.col("vec_id").alias("ord"))
    return link.link_embedding(e.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("span_id"), F.col("label").alias("type"), "embedding"), cat, least=0.2)


_EMBED_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS span_id, b.vec_id AS canonical_id, round(list_cosine_similarity(a.v, b.v), 6) AS confidence FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 25 <> 0 AND b.vec_id % 25 = 0)
  SELECT span_id, canonical_id, confidence, 'embedding' AS match_type FROM s WHERE confidence >= 0.2 QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY confidence DESC, canonical_id) = 1"""


def alias_expand(spark, sf):
    x = alias.expand_catalog(_entries(spark, sf).select("id", F.initcap("label").alias("label"), "aliases"))
    return x.select("id", F.array_join("aliases", "|").alias("aliases"), "added")


_ALIAS_SQL = """WITH e AS (SELECT min(p_partkey) AS k, p_name FROM part GROUP BY p_name)
  SELECT 'uat:' || k AS id, replace(upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:], ' ', '-') || '|' || upper(p_name[1]) || upper(split_part(p_name, ' ', 2)[1]) AS aliases, 1 AS added FROM e"""


def name_forms(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select("doc_id", F.col("text").alias("t"))
    return w.select("doc_id", strip_diacritics(F.col("t")).alias("plain"), swap_hyphen_space(F.col("t")).alias("swapped"), strip_punctuation(F.col("t")).alias("bare"), acronym(F.col("t")).alias("short"))


_ACC = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def keyword_index(spark, sf):
    x = annotate.keyword_index(_entries(spark, sf))
    return x.select("surface_lc", "canonical_id", "type")


def tree_paths(spark, sf):
    """Region, nation, supplier as a hierarchy."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.col("s_name").alias("name"))
    return catalog.tree_paths(spark, r.unionByName(n).unionByName(s)).select("id", "path_id", "depth")


_TREE_SQL = """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
  t AS (SELECT id, replace(name, ' ', '_') AS path_id, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, path_id || '/' || replace(name, ' ', '_'), depth + 1 FROM t JOIN e ON e.parent = t.id) SELECT id, path_id, depth FROM t"""


def catalog_topics(spark, sf):
    """Topic entries of part rows as concept records."""
    p = table(spark, sf, "part")
    raw = p.select(F.concat(F.lit("http://example.org/uat/"), F.col("p_partkey").cast("string")).alias("uri"), F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("prefLabel"), F.array("p_brand", F.lower("p_brand"), "p_name", F.lit(" ")).alias("altLabels"), F.array(F.concat(F.lit("http://example.org/uat/"), F.col("p_size").cast("string"))).alias("broader"), F.lit(None).cast("array<string>").alias("narrower"))
    x = catalog.topics(raw)
    return x.select("id", "label", F.array_join("aliases", "|").alias("aliases"), F.array_join("parents", "|").alias("parents"), F.size("children").alias("n_children"))


def catalog_organizations(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    k = F.col("s_suppkey")
    name = lambda v, *t: F.struct(v.alias("value"), F.array(*[F.lit(x) for x in t]).alias("types"))
    names = F.when(k % 2 == 0, F.array(name(F.concat(F.lit("S"), k.cast("string")), "acronym"), name(F.col("s_name"), "label", "ror_display"))).otherwise(F.array(name(F.concat(F.lit("S"), k.cast("string")), "acronym")))
    status = F.when(k % 5 == 0, "inactive").when(k % 5 == 1, "active")
    raw = s.select(F.concat(F.lit("https://ror.org/"), k.cast("string")).alias("id"), status.alias("status"), names.alias("names"), F.array(F.struct(F.when(k % 3 > 0, F.col("n_name")).alias("country_name"))).alias("locations"), F.lit("unknown").alias("country"))
    return catalog.organizations(raw).select("id", "label", F.array_join("aliases", "|").alias("aliases"), "country")


def planetary_features(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select((F.col("p_partkey") % 500).alias("feature_id"), F.col("p_name").alias("clean_name"), F.col("p_brand").alias("target"), F.concat("p_type", F.lit(", x")).alias("type"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("string")).otherwise("none").alias("diameter"), F.lit("1.5").alias("center_lat"), F.lit(" 2 ").alias("center_lon"), F.lit("Adopted").alias("approval"), F.col("p_partkey").alias("ord"))
    return catalog.planetary(raw)


def ontology_entries(spark, sf):
    n = table(spark, sf, "nation")
    base = "http://example.org/x/"
    s, o = F.concat(F.lit(base), "n_name"), F.concat(F.lit(base + "R"), F.col("n_regionkey").cast("string"))
    t = n.select(s.alias("s"), F.lit("http://rdf/#subClassOf").alias("p"), o.alias("o")).unionByName(n.select(s.alias("s"), F.lit("http://rdf/#label").alias("p"), F.lower("n_name").alias("o")))
    t = t.unionByName(table(spark, sf, "region").select(F.concat(F.lit(base + "R"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("http://skos/#prefLabel").alias("p"), F.col("r_name").alias("o")))
    x = catalog.triples_to_entries(t)
    return x.select("id", "label", F.size("parents").alias("n_parents"), F.size("children").alias("n_children"))


_ONTO_SQL = """SELECT 'sweet:' || n_name AS id, lower(n_name) AS label, 1 AS n_parents, 0 AS n_children FROM nation
  UNION ALL SELECT 'sweet:R' || r_regionkey, r_name, 0, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::INTEGER FROM region"""


def vocabulary_reasons(spark, sf):
    e = _entries(spark, sf).select("id", F.split_part("label", F.lit(" "), F.lit(2)).alias("label"))
    common = table(spark, sf, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).agg(F.count(F.lit(1)).alias("n")).where("word like 'w%'")
    return catalog.classify_entries(e, ["ring", "bolt"], common).groupBy("reason", "borderline").agg(F.count(F.lit(1)).alias("n"))


_REASONS_SQL = """WITH e AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS l FROM part), r AS (SELECT CASE WHEN length(l) < 4 THEN 'too_short' WHEN l IN ('ring', 'bolt') THEN 'stopword' WHEN l LIKE 'w%' THEN 'high_frequency' ELSE 'kept' END AS reason, l FROM e)
  SELECT reason, reason = 'kept' AND length(l) BETWEEN 4 AND 6 AS borderline, count(*) AS n FROM r GROUP BY ALL"""


def enrichment_coverage(spark, sf):
    """Snippets made of entries, as records, deduplicated and counted."""
    s = generate.snippets(_entries(spark, sf), ["A study of {label} in clusters", "{label} and its uses"])
    r = enrich.from_snippets(s).withColumn("ord", F.col("id"))
    return enrich.coverage(enrich.build(r))


_COVER_SQL = """WITH n AS (SELECT count(DISTINCT p_name) AS n FROM part) SELECT unnest(['text_type', 'span_type', 'vocabulary', 'span_vocabulary']) AS dimension, unnest(['snippet', 'topic', 'uat', 'uat']) AS value, unnest([n, n, 2 * n, n]) AS n FROM n"""


def pair_labels(spark, sf):
    """Labels of filled slots with their places in the request."""
    from .base import pairs

    x = pairs(spark, sf).withColumn("slots", F.array(F.struct(F.lit("topic").alias("name"), F.split_part("natural_language", F.lit(" about "), F.lit(2)).alias("value")), F.struct(F.lit("author_name").alias("name"), F.regexp_extract("natural_language", r"by (\S+)", 1).alias("value")), F.struct(F.lit("year").alias("name"), F.lit("1999").alias("value"))))
    x = x.select("id", F.explode(enrich.slot_labels(F.col("natural_language"), F.col("slots"))).alias("l"))
    return x.select("id", "l.entity_type", "l.start_char", "l.end_char")


_LABELS_SQL = """, l AS (SELECT id, natural_language AS n, 'topic' AS entity_type, split_part(natural_language, ' about ', 2) AS v FROM pairs UNION ALL SELECT id, natural_language, 'author', regexp_extract(natural_language, 'by (\\S+)', 1) FROM pairs)
  SELECT id, entity_type, (strpos(lower(n), lower(v)) - 1)::INTEGER AS start_char, (strpos(lower(n), lower(v)) - 1 + length(v))::INTEGER AS end_char FROM l"""


def domain_groups(spark, sf):
    n = table(spark, sf, "nation").withColumn("domain_tags", F.when(F.col("n_nationkey") % 3 == 0, F.expr("cast(array() as array<string>)")).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("astronomy"))).otherwise(F.array(F.lit("astronomy"), F.lit("earth"))))
    return enrich.group_by_domain(n).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def char_tags(spark, sf):
    """BIO tags of the first word of each benchmark text, by character and by token (M1, M2)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    first = F.length(F.regexp_extract("text", r"^(\S+)", 1))
    spans = F.array(F.struct(F.lit(0).alias("start"), first.alias("end"), F.lit("entity").alias("type")))
    x = b.withColumn("tags", annotate.char_tags(F.col("text"), spans)).withColumn("tokens", annotate.token_tags(F.col("text"), F.col("tags")))
    return x.select("doc_id", F.size(F.filter("tags", lambda t: t != "O")).alias("inside"), F.size("tokens").alias("n_tokens"), F.get("tokens", F.lit(0))["tag"].alias("first_tag"))



QUERIES = {
    "span_prf_by_type": (span_prf_by_type, _PRF_SQL),
    "span_iou_candidates": (span_iou_candidates, _IOU_SQL),
    # Words don't overlap, so a word's own span is the only one that can be its match.
    "span_iou_match": (span_iou_match, _MATCH_SQL),
    "bio_islands": (bio_islands, _BIO_SQL),
    "token_metrics": (token_metrics, _TOKEN_SQL),
    "reannotation_delta": (reannotation_delta, _SPANS + """, g AS (SELECT doc_id, count(*)::INTEGER AS b, count(*) FILTER (length(w) >= 10)::INTEGER AS a FROM s GROUP BY doc_id)
  SELECT doc_id, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(b - a, 0) AS removed, round(coalesce(100.0 * (b - a) / b, 0), 4) AS reduction_pct FROM documents LEFT JOIN g USING (doc_id)"""),
    "link_exact": (link_exact, f"WITH {_MENTIONS} SELECT span_id, 'uat:' || min(ord) AS canonical_id, 'exact' AS match_type FROM m JOIN x ON lower(surface) = s WHERE type = 'topic' GROUP BY span_id"),
    "link_cascade": (link_cascade, _CASCADE_SQL),
    "embed_argmax": (embed_argmax, _EMBED_SQL),
    "alias_expand": (alias_expand, _ALIAS_SQL),
    "name_forms": (name_forms, f"""WITH w AS (SELECT doc_id, text AS t FROM documents), p AS (SELECT *, list_filter(string_split_regex(trim(t), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ('a', 'an', 'and', 'the', 'of', 'for', 'in', 'on', 'at', 'to', 'by')) AS ws FROM w)
  SELECT doc_id, translate(t, '{_ACC}', '{_PLAIN}') AS plain, CASE WHEN contains(t, '-') THEN replace(t, '-', ' ') WHEN contains(t, ' ') THEN replace(t, ' ', '-') ELSE t END AS swapped, trim(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS bare,
  CASE WHEN len(ws) >= 2 AND len(ws) <= 10 THEN (array_to_string(list_transform(ws, lambda w: replace(upper(w[1]), 'ẞ', 'SS')), '')) END AS short FROM p"""),
    "keyword_index": (keyword_index, """WITH e AS (SELECT p_name, min(p_partkey) AS ord FROM part GROUP BY p_name), x AS (SELECT lower(p_name) AS s, ord FROM e UNION ALL SELECT lower(replace(p_name, ' ', '-')), ord FROM e)
  SELECT s AS surface_lc, 'uat:' || min(ord) AS canonical_id, 'topic' AS type FROM x WHERE length(s) >= 4 GROUP BY s"""),
    "tree_paths": (tree_paths, _TREE_SQL),
    "catalog_topics": (catalog_topics, "SELECT 'uat:' || p_partkey AS id, p_name AS label, p_brand AS aliases, p_size::VARCHAR AS parents, 0 AS n_children FROM part WHERE p_partkey % 10 > 0"),
    "catalog_organizations": (catalog_organizations, "SELECT 'ror:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'S' || s_suppkey END AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey ELSE '' END AS aliases, CASE WHEN s_suppkey % 3 > 0 THEN n_name ELSE 'unknown' END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0"),
    "planetary_features": (planetary_features, """SELECT 'planetary:' || lower(p_brand) || ':' || (p_partkey % 500) AS id, p_name AS label, lower(p_type) AS feature_type, CASE WHEN p_size % 7 > 0 THEN p_size::DOUBLE END AS diameter, 1.5::DOUBLE AS center_lat, 2.0::DOUBLE AS center_lon
  FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand), p_partkey % 500 ORDER BY p_partkey) = 1"""),
    "ontology_entries": (ontology_entries, _ONTO_SQL),
    "vocabulary_reasons": (vocabulary_reasons, _REASONS_SQL),
    "enrichment_coverage": (enrichment_coverage, _COVER_SQL),
    "pair_labels": (pair_labels, "WITH " + PAIRS_SQL + _LABELS_SQL),
    "domain_groups": (domain_groups, "WITH t AS (SELECT unnest(CASE n_nationkey % 3 WHEN 0 THEN ['untagged'] WHEN 1 THEN ['astronomy'] ELSE ['astronomy', 'earth'] END) AS domain FROM nation) SELECT domain, count(*) AS n FROM t GROUP BY domain"),
    "char_tags": (char_tags, "SELECT item_id AS doc_id, length(regexp_extract(text, '^(\\S+)', 1))::INTEGER AS inside, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n_tokens, 'B-institution' AS first_tag FROM benchmark"),
}
