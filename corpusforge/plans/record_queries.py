"""Queries over validation, record conversion and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qlang, vocab
from ..operators import link, records, reports, validate
from . import base
from .base import FAULTY_SQL, PAIRS_SQL, sql_list, table
from .pair_queries import _LINT_SQL
from .span_queries import _CASCADE, _MENTIONS


def local_validation(spark, sf):
    x = validate.validate_local(base.faulty(spark, sf))
    return x.groupBy("status", "error_type").agg(F.count(F.lit(1)).alias("n"))


_VALID_SQL = (
    _LINT_SQL
    + f""", v AS (SELECT e.id, e.errors, list_filter(list_transform(string_split_regex(regexp_replace(array_to_string(regexp_extract_all(ads_query, '(?i)\\b(?:doctype|property):\\s*(\\([^)]+\\)|[^\\s()]+)', 1), ' OR '), '[()]', '', 'g'), '(?i)\\s+OR\\s+'), lambda v: trim(v)),
    lambda v: v <> '' AND NOT list_contains({sql_list(sorted({x.lower() for f in ('doctype', 'property') for x in vocab.ENUMS[f]}))}, lower(v))) AS bad FROM e JOIN faulty USING (id)),
  k AS (SELECT CASE WHEN len(errors) + len(bad) = 0 THEN 'valid' ELSE 'quarantine' END AS status, CASE WHEN len(errors) = 0 THEN CASE WHEN len(bad) > 0 THEN 'invalid_field_value' END
    WHEN contains(errors[1], 'Unbalanced quotes') THEN 'unbalanced_quotes' WHEN contains(errors[1], 'Unbalanced parentheses') THEN 'unbalanced_parentheses' WHEN contains(errors[1], 'Unbalanced brackets') THEN 'unbalanced_brackets'
    WHEN contains(errors[1], 'Unknown field') THEN 'unknown_field' WHEN contains(lower(errors[1]), 'boolean operator') OR contains(lower(errors[1]), 'cannot start with') THEN 'invalid_boolean' ELSE 'syntax_error' END AS error_type FROM v)
  SELECT status, error_type, count(*) AS n FROM k GROUP BY ALL"""
)


def cached_validation(spark, sf):
    """A cache made from half of the pairs, of two versions, the later entry failing some."""
    p = base.pairs(spark, sf)
    seen = p.where("id % 2 = 0").groupBy(qlang.canonicalize(F.col("ads_query")).alias("q")).agg(F.min("id").alias("i"))
    entry = lambda v, at, ok: F.struct(validate.canonical_hash(F.col("q"), v).alias("query_hash"), F.lit(v).alias("validator_version"), ok.alias("valid"), F.lit(3).alias("tier"), F.when(~ok, "parse error").alias("error"), F.lit(at).alias("cached_at"))
    cache = seen.select(F.inline(F.array(entry("1", 1, F.lit(False)), entry("2", 1, F.lit(False)), entry("2", 2, F.col("i") % 3 > 0))))
    x = validate.validate_cached(p, cache, "2")
    return x.groupBy("valid", "tier", validate.remote_error(F.coalesce("error", F.lit("none"))).alias("error")).agg(F.count(F.lit(1)).alias("n"))


_CACHED_SQL = (
    "WITH "
    + PAIRS_SQL
    + """, c AS (SELECT ads_query, min(id) AS i FROM pairs WHERE id % 2 = 0 GROUP BY ads_query)
  SELECT i % 3 > 0 AS valid, CASE WHEN i IS NULL THEN 1 ELSE 3 END AS tier, CASE WHEN i % 3 = 0 THEN 'parse_error' ELSE 'api_error' END AS error, count(*) AS n FROM pairs LEFT JOIN c USING (ads_query) GROUP BY ALL"""
)


def chat_examples(spark, sf):
    m = F.col("messages")
    x = records.to_chat(records.normalize_pairs(base.pairs(spark, sf)))
    return x.select(m[1]["content"].alias("user_text"), m[2]["content"].alias("answer"), F.size(m).alias("n"))


_CHAT_SQL = "WITH " + PAIRS_SQL + """ SELECT 'Query: ' || natural_language || chr(10) || 'Date: 2025-12-15' AS user_text, '{"query": ' || to_json(ads_query) || '}' AS answer, 3 AS n FROM pairs"""


def value_suggestions(spark, sf):
    bad = base.faulty(spark, sf).select(F.explode(qlang.wrong_values(F.col("ads_query"), "property")).alias("value")).unionByName(spark.createDataFrame([("refer",), ("open",), ("catalogue",), ("xyz",), ("EPRINTS",)], "value string"))
    x = validate.suggestions(bad, "property")
    return x.select("value", F.array_join("suggestions", "|").alias("suggestions"))


_SUGGEST_SQL = f"""WITH v AS (SELECT unnest(['nonsense', 'refer', 'open', 'catalogue', 'xyz', 'EPRINTS']) AS value), p AS (SELECT unnest({sql_list(sorted(vocab.PROPERTIES))}) AS w),
  s AS (SELECT value, w, CASE WHEN starts_with(w, lower(value)) OR starts_with(lower(value), w) THEN 0 WHEN contains(w, lower(value)) OR contains(lower(value), w) THEN 1 WHEN length(w) > 2 AND length(value) > 2 AND w[1:3] = lower(value)[1:3] THEN 2 END AS near FROM v, p),
  r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY near, w) AS k FROM s WHERE near IS NOT NULL)
  SELECT v.value, coalesce(string_agg(w, '|' ORDER BY k) FILTER (k <= 3), '') AS suggestions FROM v LEFT JOIN r ON r.value = v.value GROUP BY v.value"""


def syntax_counters(spark, sf):
    return validate.syntax_counters(base.faulty(spark, sf))


_COUNTERS_SQL = (
    "WITH "
    + FAULTY_SQL
    + """ SELECT count(*) FILTER (contains(ads_query, '"')) AS quoted_phrases, count(*) FILTER (contains(ads_query, '[') AND contains(ads_query, ' TO ')) AS ranges,
  count(*) FILTER (contains(ads_query, ' OR ')) AS boolean_or, count(*) FILTER (contains(ads_query, ' AND ')) AS boolean_and, count(*) FILTER (contains(ads_query, ' NOT ')) AS boolean_not,
  0::BIGINT AS author_spaced_initial, 0::BIGINT AS author_initial, count(*) AS author_quoted, 0::BIGINT AS author_bare, 0::BIGINT AS first_author FROM faulty"""
)


def bare_fields(spark, sf):
    x = base.pairs(spark, sf).withColumn("q", F.when(F.col("id") % 4 == 0, F.regexp_replace("ads_query", '"', "")).otherwise(F.col("ads_query")))
    return x.select(F.explode(validate.bare_values(F.col("q"))).alias("bare")).groupBy(F.split_part("bare", F.lit(":"), F.lit(1)).alias("field")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bare").alias("distinct_values"))


_BARE_SQL = "WITH " + PAIRS_SQL + """, b AS (SELECT unnest(regexp_extract_all(replace(ads_query, '"', ''), '\\b((?:author|abs):[^\\s()]+)', 1)) AS bare FROM pairs WHERE id % 4 = 0)
  SELECT split_part(bare, ':', 1) AS field, count(*) AS n, count(DISTINCT bare) AS distinct_values FROM b GROUP BY 1"""


def trigger_phrases(spark, sf):
    x = base.pairs(spark, sf).withColumn("nl", F.concat(F.when(F.col("id") % 8 == 0, "papers citing ").when(F.col("id") % 8 == 1, "references in ").when(F.col("id") % 8 == 2, "popular and trending ").otherwise("work like "), "natural_language"))
    x = x.select(F.explode(validate.trigger_phrases(F.col("nl"), qlang.calls(F.col("ads_query")))).alias("t"))
    return x.groupBy("t.operator", "t.phrase").agg(F.count(F.lit(1)).alias("n"))


_TRIGGER_SQL = "WITH " + PAIRS_SQL + """, t AS (SELECT unnest(CASE id % 8 WHEN 0 THEN [{'o': 'citations', 'p': 'papers citing'}, {'o': 'citations', 'p': 'citing papers'}] WHEN 1 THEN [{'o': 'references', 'p': 'references in'}]
  WHEN 2 THEN [{'o': 'trending', 'p': 'trending'}, {'o': 'trending', 'p': 'popular'}] WHEN 3 THEN [{'o': 'similar', 'p': 'like'}] ELSE [] END) AS t FROM pairs)
  SELECT t.o AS operator, t.p AS phrase, count(*) AS n FROM t GROUP BY ALL"""


def paper_resolution(spark, sf):
    """Hints of requests that point at a paper, and the dearest part with all their words."""
    x = base.intents(spark, sf).withColumn("text", F.concat(F.lit("papers citing the paper on "), "topic"))
    x = x.where(validate.needs_resolution(F.col("operator"), F.lit(None).cast("string"), F.col("text"))).select("id", validate.paper_hint(F.col("text")).alias("hint"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("bibcode"), F.col("p_name").alias("title"), F.round(F.col("p_retailprice") * 100).cast("long").alias("citation_count"))
    return x.join(validate.resolve(x, p), "id", "left")


_RESOLVE_SQL = "WITH " + PAIRS_SQL + """, b AS (SELECT p_name, arg_max(p_partkey, (round(p_retailprice * 100)::BIGINT, p_partkey)) AS bibcode FROM part GROUP BY p_name)
  SELECT id, topic AS hint, bibcode FROM intents JOIN b ON topic = p_name WHERE operator IN ('citations', 'references', 'similar')"""


def dashboard_join(spark, sf):
    """Documents with the last prediction of each, missing ones empty (J1), and how many spans they have."""
    ann = table(spark, sf, "documents").select("doc_id", "lang")
    pred = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("at"), "quality").unionByName(table(spark, sf, "labels").where("toxic = 0").select("doc_id", F.lit(2).alias("at"), (F.col("quality") + 10).alias("quality")))
    return ann.join(link.last_wins(pred, "doc_id", "at"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


_DASH_SQL = """SELECT doc_id, lang, coalesce(CASE WHEN toxic = 0 THEN quality + 10 ELSE quality END, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)"""


def record_checks(spark, sf):
    p = base.pairs(spark, sf)
    x = p.select(F.col("id").cast("string").alias("pair_id"), F.col("natural_language").alias("user_text"), F.when(F.col("id") % 9 > 0, F.col("ads_query")).alias("ads_query"), F.lit("t").alias("template_id"), F.create_map(F.lit("topic"), F.col("category")).alias("filled_slots"), F.array(F.when(F.col("id") % 10 > 0, "e")).alias("validation_errors"), (F.col("id") % 6).cast("int").alias("validation_tier"), F.when(F.col("id") % 4 == 0, "2026-13-45").otherwise("2026-01-02T03:04:05Z").alias("created_at"))
    return x.select(F.explode(validate.record_errors(x, "pair")).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


_CHECKS_SQL = "WITH " + PAIRS_SQL + """, v AS (SELECT unnest(list_filter([CASE WHEN id % 9 = 0 THEN 'ads_query is required' END, CASE WHEN id % 10 = 0 THEN 'validation_errors has a null item' END, CASE WHEN id % 6 > 3 THEN 'validation_tier is outside 0 to 3' END,
  CASE WHEN id % 4 = 0 THEN 'created_at is no ISO time' END], lambda x: x IS NOT NULL)) AS violation FROM pairs) SELECT violation, count(*) AS n FROM v GROUP BY violation"""


def acceptance_gate(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return validate.acceptance(counts, 100, 20)


def unique_counts(spark, sf):
    return base.pairs(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("natural_language").alias("texts"), F.countDistinct("ads_query").alias("queries"))


def unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    u = records.unit(F.col("embedding"))
    return e.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm"), F.round(u[0], 6).alias("first"))


def log_extraction(spark, sf):
    log = base.pairs(spark, sf).select(F.url_encode(F.regexp_replace("ads_query", "#0+", " ")).alias("query"))
    return records.extract_log(log, "author", 50)


def annotated_records(spark, sf):
    """Reviewed abstracts as records (P7, P10): documents with a topic twice and an organization."""
    d = table(spark, sf, "documents").where("n_chars >= 40")
    s = lambda a, b, kind, ident: F.struct(F.substring(F.col("text"), a + 1, b - a).alias("surface"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(kind).alias("type"), ident.alias("canonical_id"), F.lit(None).cast("string").alias("source_vocabulary"), F.lit(None).cast("double").alias("confidence"))
    topic = F.concat(F.lit("sweet:"), F.col("lang"))
    x = d.select(F.col("doc_id").cast("string").alias("bibcode"), F.col("text").alias("abstract_clean"), F.array(s(0, 5, "topic", topic), s(6, 9, "topic", topic), s(10, 14, "entity", F.lit("ROR:1"))).alias("spans"))
    y = records.from_annotations(x)
    return y.groupBy(F.array_join("domains", ",").alias("domains"), F.size("topics").alias("topics"), F.size("spans").alias("spans")).agg(F.count(F.lit(1)).alias("n"))


def syntax_accuracy(spark, sf):
    """Sound outputs by operator."""
    x = base.faulty(spark, sf).withColumn("operator", F.coalesce(F.get(qlang.calls(F.col("ads_query")), F.lit(0)), F.lit("none")))
    return x.groupBy("operator").agg(F.count(F.lit(1)).alias("n"), F.sum(validate.sound_syntax(F.col("ads_query")).cast("long")).alias("sound"))


_SOUND_SQL = (
    "WITH "
    + FAULTY_SQL
    + """ SELECT coalesce(nullif(regexp_extract(ads_query, '\\b(citations|references|trending|similar)\\(', 1), ''), 'none') AS operator, count(*) AS n,
  sum((length(replace(ads_query, '(', '')) = length(replace(ads_query, ')', '')))::INTEGER)::BIGINT AS sound FROM faulty GROUP BY 1"""
)


def dataset_stats(spark, sf):
    p = base.pairs(spark, sf)
    return reports.dataset_stats({"train": p.where("id % 10 > 0"), "val": p.where("id % 10 = 0")})


def quality_report(spark, sf):
    return reports.quality_report(base.faulty(spark, sf))


_QUALITY_SQL = (
    _LINT_SQL
    + """, s AS (SELECT len(errors) = 0 AS ok, CASE id % 11 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS w, CASE WHEN id % 11 = 6 THEN 1 ELSE 0 END AS b FROM e),
  t AS (SELECT count(*) AS e, sum(ok::INTEGER)::BIGINT AS s, sum(w)::BIGINT AS w, sum(b)::BIGINT AS b FROM s)
  SELECT unnest(['examples', 'sound', 'wrong_values', 'bare_values']) AS measure, unnest([e, s, w, b]) AS n FROM t"""
)


def prediction_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"), (F.col("n_chars") % 100 / 100.0).alias("confidence"))
    return reports.prediction_stats(d.unionByName(d.where("doc_id % 2 = 0")))


_PREDICTION_SQL = """WITH d AS (SELECT doc_id, lang AS type, n_chars % 100 / 100.0::DOUBLE AS confidence FROM documents), u AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE doc_id % 2 = 0)
  SELECT type, count(*) AS spans, count(DISTINCT doc_id) AS documents, round(avg(confidence), 4) AS mean_confidence, round(count(*) / count(DISTINCT doc_id), 4) AS per_document FROM u GROUP BY ROLLUP (type)"""


def linking_stats(spark, sf):
    from .span_queries import _entries, _mentions

    return reports.linking_stats(link.link_cascade(_mentions(spark, sf), link.linking_index(_entries(spark, sf))))


def result_views(spark, sf):
    r = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("syntax_ok"), (F.col("toxic") == 0).alias("semantic_ok"))
    out = None
    for view in ("all", "syntax", "semantic", "both"):
        x = reports.result_filter(r, view).agg(F.count(F.lit(1)).alias("n")).select(F.lit(view).alias("view"), "n")
        out = x if out is None else out.unionByName(x)
    return out


_VIEWS_SQL = """SELECT 'all' AS view, count(*) AS n FROM labels UNION ALL SELECT 'syntax', count(*) FILTER (coalesce(quality, 0) <> 1) FROM labels UNION ALL SELECT 'semantic', count(*) FILTER (coalesce(toxic, 1) <> 0) FROM labels
  UNION ALL SELECT 'both', count(*) FILTER (coalesce(quality, 0) <> 1 AND coalesce(toxic, 1) <> 0) FROM labels"""


def reviewed_pairs(spark, sf):
    p = base.pairs(spark, sf)
    r = p.where("id % 5 = 0").select("natural_language", "ads_query", F.concat("ads_query", F.lit(" AND abs:new")).alias("fixed_query"))
    x = p.withColumn("old", F.col("ads_query"))
    return reports.changes(reports.apply_reviews(x, r), "old", "ads_query")


_REVIEWED_SQL = "WITH " + PAIRS_SQL + """, k AS (SELECT DISTINCT natural_language, ads_query FROM pairs WHERE id % 5 = 0)
  SELECT count(*) AS rows, count(k.ads_query) AS changed FROM pairs LEFT JOIN k USING (natural_language, ads_query)"""


def report_examples(spark, sf):
    x = base.faulty(spark, sf).select("id", (F.size(qlang.lint(F.col("ads_query"))) == 0).alias("ok"))
    return reports.examples_for_report(x, F.col("ok"), "id", 5).select("id", "good")


_EXAMPLES_SQL = _LINT_SQL + " SELECT id, len(errors) = 0 AS good FROM e QUALIFY row_number() OVER (PARTITION BY len(errors) = 0 ORDER BY id) <= 5"


QUERIES = {
    "dataset_stats": (dataset_stats, "WITH " + PAIRS_SQL + " SELECT CASE WHEN id % 10 > 0 THEN 'train' ELSE 'val' END AS source, category, count(*) AS n FROM pairs GROUP BY ALL"),
    "quality_report": (quality_report, _QUALITY_SQL),
    "prediction_stats": (prediction_stats, _PREDICTION_SQL),
    "linking_stats": (linking_stats, f"WITH {_MENTIONS}, {_CASCADE} SELECT match_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY match_type"),
    "result_views": (result_views, _VIEWS_SQL),
    "reviewed_pairs": (reviewed_pairs, _REVIEWED_SQL),
    "report_examples": (report_examples, _EXAMPLES_SQL),
    "syntax_accuracy": (syntax_accuracy, _SOUND_SQL),
    "local_validation": (local_validation, _VALID_SQL),
    "cached_validation": (cached_validation, _CACHED_SQL),
    "chat_examples": (chat_examples, _CHAT_SQL),
    "value_suggestions": (value_suggestions, _SUGGEST_SQL),
    "syntax_counters": (syntax_counters, _COUNTERS_SQL),
    "bare_fields": (bare_fields, _BARE_SQL),
    "trigger_phrases": (trigger_phrases, _TRIGGER_SQL),
    "paper_resolution": (paper_resolution, _RESOLVE_SQL),
    "dashboard_join": (dashboard_join, _DASH_SQL),
    "record_checks": (record_checks, _CHECKS_SQL),
    "acceptance_gate": (acceptance_gate, "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT sum(n)::BIGINT AS total, min(n) AS smallest, sum(n) >= 100 AND min(n) >= 20 AS passed FROM c"),
    "unique_counts": (unique_counts, "WITH " + PAIRS_SQL + " SELECT count(*) AS rows, count(DISTINCT natural_language) AS texts, count(DISTINCT ads_query) AS queries FROM pairs"),
    "unit_vectors": (unit_vectors, "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM e"),
    "log_extraction": (log_extraction, "WITH " + PAIRS_SQL + """, q AS (SELECT DISTINCT regexp_replace(ads_query, '#0+', ' ') AS query FROM pairs WHERE NOT regexp_matches(ads_query, '^(citations|references|similar|trending)\\('))
  SELECT query FROM q WHERE NOT contains(query, '0000') ORDER BY md5(query), query LIMIT 50"""),
    "annotated_records": (annotated_records, "SELECT 'earthscience,multidisciplinary' AS domains, 1 AS topics, 3 AS spans, count(*) AS n FROM documents WHERE n_chars >= 40"),
}
