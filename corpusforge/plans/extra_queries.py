"""Queries over the smaller record, report and generation functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qlang
from ..operators import alias, catalog, curate, evaluate, generate, link, records, reports, retrieval
from . import base
from .base import FAULTY_SQL, PAIRS_SQL, table
from .pair_queries import _LINT_SQL
from .span_queries import _entries
from .text_queries import _STRIP


def pair_label_records(spark, sf):
    """Records of labelled requests: a topic with its place and an author without one."""
    label = lambda kind, text, ident, a: F.struct(text.alias("text_span"), F.lit(kind).alias("entity_type"), ident.alias("entity_id"), a.alias("start_char"), (a + F.length(text)).alias("end_char"))
    x = base.pairs(spark, sf).withColumn("topic", F.split_part("natural_language", F.lit(" about "), F.lit(2)))
    topic = label("topic", F.col("topic"), F.concat(F.lit("uat:"), "category"), F.instr("natural_language", " about ") + 6)
    author = label("author", F.lit("someone"), F.lit("ror:1"), F.lit(None).cast("int"))
    r = records.from_pair_labels(x.select(F.col("id").alias("example_id"), F.col("natural_language").alias("user_text"), F.array(topic, author).alias("labels")))
    span = F.get("spans", F.lit(0))
    return r.select("id", "text_type", F.size("spans").alias("n_spans"), F.size("topics").alias("n_topics"), (F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"]) == span["surface"]).alias("exact"), span["source_vocabulary"].alias("vocabulary"))


_LABELLED_SQL = "WITH " + PAIRS_SQL + """ SELECT substr(md5('pair:' || id), 1, 12) AS id, 'user_query' AS text_type, 1 AS n_spans, 1 AS n_topics, true AS exact, 'uat' AS vocabulary FROM pairs"""


def parsed_abstracts(spark, sf):
    """Pages as documents of an API: those without an abstract go, the others get a clean text."""
    k = F.col("page_id")
    d = table(spark, sf, "pages").select(k.cast("string").alias("bibcode"), F.array(F.col("url")).alias("title"), F.when(k % 7 == 0, "Not Available").when(k % 7 == 1, "").when(k % 7 > 2, F.col("html")).alias("abstract"), F.when(k % 2 == 0, 1999).alias("year"), F.lit(None).cast("int").alias("citation_count"))
    x = records.parse_abstracts(d, "astronomy")
    return x.select("bibcode", "title", F.md5(F.col("abstract_clean").cast("binary")).alias("clean"), (F.col("abstract_clean") != F.col("abstract")).alias("changed"), "year", "citation_count", "domain_category")


_ABSTRACTS_SQL = f"""SELECT page_id::VARCHAR AS bibcode, url AS title, md5({_STRIP}) AS clean, {_STRIP} <> html AS changed, CASE WHEN page_id % 2 = 0 THEN 1999 ELSE 0 END AS year, 0 AS citation_count, 'astronomy' AS domain_category
  FROM pages WHERE page_id % 7 > 2"""


def syntax_findings(spark, sf):
    """Malformed calls, parentheses and forbidden pieces of queries."""
    q = F.when(F.col("id") % 3 == 0, F.concat(F.lit("citationsAbs:x "), F.col("ads_query"))).otherwise(F.col("ads_query"))
    x = base.faulty(spark, sf).select(q.alias("q"))
    bad = F.concat(qlang.syntax_issues(F.col("q")), F.transform(qlang.forbidden_found(F.col("q"), F.array(F.lit("FOO:"), F.lit("nowhere"), F.lit("doctype:memo"))), lambda p: F.concat(F.lit("forbidden "), p)))
    return x.select(F.explode(bad).alias("finding")).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


_FINDINGS_SQL = (
    "WITH "
    + FAULTY_SQL
    + """, f AS (SELECT unnest(list_filter([CASE WHEN id % 3 = 0 THEN 'Malformed operator: citationsabs:' END, CASE WHEN id % 11 = 6 THEN 'Unbalanced parentheses' END, CASE WHEN id % 11 = 2 THEN 'forbidden FOO:' END, CASE WHEN id % 11 = 5 THEN 'forbidden doctype:memo' END], lambda x: x IS NOT NULL)) AS finding FROM faulty)
  SELECT finding, count(*) AS n FROM f GROUP BY finding"""
)


def point_lookup(spark, sf):
    return reports.point_lookup(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


def best_orders(spark, sf):
    """The dearest order of each customer, the first of equals."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", -4).alias("price"))
    return link.argmax_first(o, "o_custkey", "price", "o_orderkey").select("o_custkey", "o_orderkey")


def retrieval_boosts(spark, sf):
    """What features in common add to a score."""
    none = F.expr("cast(array() as array<string>)")
    k = F.col("id")
    intent = F.struct(F.when(k % 7 > 0, F.array("author")).otherwise(none).alias("authors"), F.col("y").alias("year_from"), F.lit(None).cast("int").alias("year_to"), "operator", "doctype", "property", none.alias("bibgroup"), none.alias("collection"))
    feats = F.struct(F.lit("citations").alias("operator"), F.array(F.lit("citations"), F.lit("similar")).alias("operators"), (k % 2 == 0).alias("has_author"), (k % 3 == 0).alias("has_year"), F.array(F.lit("article"), F.lit("eprint")).alias("doctypes"), F.array(F.lit("Refereed")).alias("properties"), none.alias("bibgroups"), none.alias("collections"))
    category = F.when(k % 4 == 0, "operator").when(k % 4 == 1, "author").when(k % 4 == 2, "property").otherwise("content")
    x = base.intents(spark, sf).select("id", retrieval.boosts(intent, feats, category).alias("boost"))
    return x.groupBy("boost").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_BOOST_SQL = (
    "WITH "
    + PAIRS_SQL
    + """, b AS (SELECT id, CASE operator WHEN 'citations' THEN 5.0 WHEN 'similar' THEN 3.0 ELSE 0 END + CASE WHEN id % 7 > 0 AND id % 2 = 0 THEN 2.0 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1.5 ELSE 0 END
  + 1.5 * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END + 1.5 * (p <> '')::INTEGER + CASE WHEN operator IS NOT NULL AND id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 > 0 AND id % 4 = 1 THEN 1 ELSE 0 END
  + CASE WHEN p <> '' AND id % 4 = 2 THEN 1 ELSE 0 END AS boost FROM intents) SELECT boost::DOUBLE AS boost, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1"""
)


def polite_requests(spark, sf):
    """Requests with a prefix or suffix, as a hash decides."""
    x = base.pairs(spark, sf)
    return x.select("id", generate.stopword_noise(F.initcap(F.split_part("natural_language", F.lit(" about "), F.lit(2))), F.col("id").cast("string")).alias("text"))


_U = "('0x' || substr(md5('{}|' || id), 1, 12))::BIGINT / 281474976710656.0"
_POLITE_SQL = (
    "WITH "
    + PAIRS_SQL
    + f""", t AS (SELECT id, array_to_string(list_transform(string_split(split_part(natural_language, ' about ', 2), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t, {_U.format(42)} AS u, {_U.format(43)} AS v FROM pairs)
  SELECT id, CASE WHEN u < 0.3 THEN ['please find ', 'show me ', 'I am looking for ', 'can you find '][floor(v * 4)::INTEGER + 1] || lower(t[1]) || t[2:] WHEN u < 0.6 THEN t || [' please', ' if possible', ' thanks'][floor(v * 3)::INTEGER + 1] ELSE t END AS text FROM t"""
)


def spot_check(spark, sf):
    """Twenty documents in the order of a hash, and whether their first word stands where it should (Z13): the feature is the number."""
    start = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)
    first = F.regexp_extract("text", r"^(\S+)", 1)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.struct(first.alias("surface"), start.alias("start"), (start + F.length(first)).alias("end"))).alias("spans"))
    return reports.spot_check(d).select("id", F.size("errors").alias("n_errors"))


_SPOT_SQL = """WITH d AS (SELECT doc_id, text, regexp_extract(text, '^(\\S+)', 1) AS w FROM documents ORDER BY md5('42|' || doc_id) LIMIT 20)
  SELECT doc_id AS id, CASE WHEN substr(text, (doc_id % 2)::INTEGER + 1, length(w)) = w THEN 0 ELSE 1 END AS n_errors FROM d"""


def intents_with_content(spark, sf):
    """Intents that say anything, by what they have."""
    k, none = F.col("id"), F.expr("cast(array() as array<string>)")
    some = lambda r, c: F.when(k % 9 == r, F.array(F.lit(c))).otherwise(none)
    i = F.struct(some(0, "a").alias("authors"), some(1, "t").alias("free_text_terms"), some(2, "t").alias("or_terms"), some(3, "article").alias("doctype"), some(4, "refereed").alias("property"), none.alias("bibgroup"), none.alias("collection"), F.when(k % 9 == 5, 1999).alias("year_from"), F.when(k % 9 == 6, 1999).alias("year_to"), F.when(k % 9 == 7, "citations").alias("operator"))
    return base.intents(spark, sf).groupBy(reports.has_content(i).alias("content")).agg(F.count(F.lit(1)).alias("n"))


def rounds_until_enough(spark, sf):
    """Rounds of nations by seed until there are sixty in all and ten of each region."""
    n = table(spark, sf, "nation")
    out = reports.until_enough(lambda seed: n.select(F.lit(seed).alias("round"), "n_regionkey", "n_name"), "n_regionkey", 60, 10)
    return out.groupBy("round").agg(F.count(F.lit(1)).alias("n"))


def build_stats(spark, sf):
    """Counts of what the steps of a build made: entries and their new names, snippets, families of pairs, tree levels."""
    e = _entries(spark, sf)
    more = alias.expand_catalog(e.select("id", F.initcap("label").alias("label"), "aliases"))
    pairs = generate.synthetic_pairs(e, {"content": ("find {x}", 'abs:"{x}"'), "reviews": ("reviews of {x}", 'reviews(abs:"{x}")')}, "ord")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    tree = catalog.tree_paths(spark, r.unionByName(n))
    return reports.counts({"entries": e, "snippets": generate.snippets(e, ["{label}"]), "pairs": pairs, "tree": tree}, {"aliases": (more, "added"), "levels": (tree, "depth")})


_BUILD_SQL = """WITH e AS (SELECT count(DISTINCT p_name) AS n FROM part), t AS (SELECT count(*) AS n FROM region), u AS (SELECT count(*) AS n FROM nation)
  SELECT unnest(['entries', 'snippets', 'pairs', 'tree', 'aliases', 'levels']) AS measure, unnest([e.n, e.n, 2 * e.n, t.n + u.n, e.n, u.n])::BIGINT AS n FROM e, t, u"""


def golden_cases(spark, sf):
    """Golden cases by expected behaviour, and how many the faulty queries pass."""
    k, none = F.col("id"), F.expr("cast(array() as array<string>)")
    kinds = ("no_operator", "single_operator", "valid_response", "passthrough", "balanced_parens", "ambiguous", "valid_property_only")
    behaviour = F.get(F.array(*[F.lit(v) for v in kinds]), (k % 8).cast("int"))
    forbidden = F.when(k % 13 == 0, F.array(F.lit("FOO:"), F.lit("(abs:x"))).otherwise(none)
    x = base.faulty(spark, sf).select(F.when(k % 13 == 0, "forbidden").otherwise(F.coalesce(behaviour, F.lit("query"))).alias("behaviour"), evaluate.case_passed(F.col("ads_query"), behaviour, F.lit("x"), forbidden).alias("passed"))
    return x.groupBy("behaviour").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("passed"))


_GOLDEN_SQL = (
    _LINT_SQL
    + """, c AS (SELECT e.id, len(errors) = 0 AS ok, id % 11 IN (5, 7) AS wrong, operator IS NOT NULL AS called FROM e JOIN intents USING (id)),
  g AS (SELECT CASE WHEN id % 13 = 0 THEN 'forbidden' ELSE coalesce(['no_operator', 'single_operator', 'valid_response', 'passthrough', 'balanced_parens', 'ambiguous', 'valid_property_only'][id % 8 + 1], 'query') END AS behaviour, * FROM c)
  SELECT behaviour, count(*) AS n, sum((CASE behaviour WHEN 'forbidden' THEN ok AND id % 11 NOT IN (2, 6) WHEN 'no_operator' THEN ok AND NOT called WHEN 'valid_response' THEN true WHEN 'valid_property_only' THEN ok AND NOT wrong WHEN 'query' THEN ok AND NOT wrong ELSE ok END)::INTEGER)::BIGINT AS passed
  FROM g GROUP BY behaviour"""
)


def curate_years(spark, sf):
    """Pairs whose query names years that the request doesn't, by century and by year."""
    last = F.regexp_extract("ads_query", r"TO (\d{4})", 1)
    nl = F.when(F.col("id") % 3 == 0, F.concat("natural_language", F.lit(" until "), last)).otherwise(F.col("natural_language"))
    p = base.pairs(spark, sf).withColumn("natural_language", nl)
    over = lambda whole: F.exists(curate.problems(F.col("natural_language"), F.col("ads_query"), whole), lambda i: i["issue"] == "over_inference")
    return p.groupBy(over(False).alias("by_century"), over(True).alias("by_year")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "golden_cases": (golden_cases, _GOLDEN_SQL),
    # A request names the first year of a range that ends two years later, every third one the last as well.
    "curate_years": (curate_years, "WITH " + PAIRS_SQL + " SELECT id % 3 > 0 AND y < 2000 AND y + 2 >= 2000 AS by_century, id % 3 > 0 AS by_year, count(*) AS n FROM intents GROUP BY ALL"),
    "pair_label_records": (pair_label_records, _LABELLED_SQL),
    "parsed_abstracts": (parsed_abstracts, _ABSTRACTS_SQL),
    "syntax_findings": (syntax_findings, _FINDINGS_SQL),
    "point_lookup": (point_lookup, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7"),
    "best_orders": (best_orders, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) = 1"),
    "retrieval_boosts": (retrieval_boosts, _BOOST_SQL),
    "polite_requests": (polite_requests, _POLITE_SQL),
    "spot_check": (spot_check, _SPOT_SQL),
    "intents_with_content": (intents_with_content, "WITH " + PAIRS_SQL + " SELECT id % 9 < 8 AS content, count(*) AS n FROM intents GROUP BY 1"),
    "rounds_until_enough": (rounds_until_enough, "SELECT k::INTEGER AS round, count(*) AS n FROM nation, range(3) AS r(k) GROUP BY k"),
    "build_stats": (build_stats, _BUILD_SQL),
}
