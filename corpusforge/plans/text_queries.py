"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, udfs
from ..operators import annotate, curate, evaluate, retrieval, stats
from .base import table, tokens_sql


def bm25_topk(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(q, table(spark, sf, "documents").select("doc_id", "text"), 5)


_BM25_SQL = f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents), q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark),
  s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM t), d AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS token FROM t), f AS (SELECT token, count(*) AS df FROM d GROUP BY token),
  r AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / greatest(a, 1)))) AS score FROM q JOIN d USING (token) JOIN f USING (token), s GROUP BY query_id, doc_id)
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id))::INTEGER AS rank, doc_id, round(score, 4) AS score FROM r WHERE score > 0 QUALIFY rank <= 5"""


def doc_freq(spark, sf):
    return retrieval.document_frequency(retrieval.token_rows(table(spark, sf, "documents"), "doc_id", F.col("text")))


def corpus_size(spark, sf):
    x = retrieval.corpus_size(table(spark, sf, "documents"), F.col("text"))
    return x.withColumn("avg_tokens", F.round("avg_tokens", 6))


def norm_dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return curate.keep_first(d, text.squash(F.col("text")), "doc_id").select("doc_id")


def dedup_md5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return curate.keep_first(d, F.md5(F.col("text").cast("binary")), "doc_id").select("doc_id")


def category_distribution(spark, sf):
    return stats.distribution(table(spark, sf, "documents"), "lang")


def split_train_val_test(spark, sf):
    return curate.split(table(spark, sf, "documents").select("doc_id"), "doc_id")


def quality_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    ok = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & (F.col("n_chars") >= 100)
    return d.withColumn("kept", ok).groupBy("lang", "kept").agg(F.count(F.lit(1)).alias("n"))


def left_join_verdict(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 3 > 0).alias("now")).join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("base")), "doc_id", "left")
    return d.groupBy(evaluate.verdict(F.col("now"), F.col("base")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def antijoin_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return curate.new_only(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "text", "doc_id").select("doc_id")


def exclude_sampled(spark, sf):
    """Documents without a label, at most three a source, by length."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")
    return curate.quota_sample(d, "source", [F.desc("n_chars"), F.col("doc_id")], 3)


def quota_sample(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("c_mktsegment", "o_orderkey", "o_totalprice")
    return curate.quota_sample(o, "c_mktsegment", [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


def html_strip(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("clean"))


_STRIP = "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)</?[A-Za-z][A-Za-z0-9]*(?:[^>]*)?>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


#: The pages' other entities, which the exact scan decodes too.
_DECODED = "(replace(replace(html, '&copy;', '©'), '&middot;', '·'),"


def html_clean_stats(spark, sf):
    p = table(spark, sf, "pages").withColumn("clean", text.strip_html(F.col("html")))
    return p.agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("clean") != F.col("html")).cast("int")).alias("changed"), F.sum(F.length("html") - F.length("clean")).alias("removed_chars"))


def url_parts(spark, sf):
    u = F.col("url")
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract(u, r"^(https?)://", 1).alias("scheme"), F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), text.concept_id(F.regexp_replace(u, r"[?#].*$", "")).alias("last_part"))


def url_decode(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.url_decode(F.concat(F.col("url"), F.lit("%20a+b%2Fc"))).alias("decoded"))


def chat_format(spark, sf):
    c = table(spark, sf, "conversations")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.md5(F.array_join(m, "\n").cast("binary")).alias("digest"))


def conv_pairs(spark, sf):
    """The first user text of a conversation and the assistant's first answer."""
    c = table(spark, sf, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    x = c.groupBy("conv_id").agg(first("user").alias("input"), first("assistant").alias("expected"))
    return x.where("input is not null and expected is not null")


def text_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.short_md5(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"))


def _vocabulary(spark, sf):
    """Entries for annotation: every word of the benchmark of six ASCII letters and more."""
    w = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))).alias("label")).distinct()
    return w.select(F.concat(F.lit("uat:"), "label").alias("id"), "label", F.expr("cast(array() as array<string>)").alias("aliases"), F.lit("topic").alias("type"), F.length("label").alias("ord"))


#: Every place of a benchmark word of six letters and more that stands between other characters, by pieces of the text.
_SPANS = """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark),
  r AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS surface, unnest(range(len(l))) AS i FROM r),
  p AS (SELECT doc_id, surface, (sum(length(surface)) OVER (PARTITION BY doc_id ORDER BY i) - length(surface))::INTEGER AS start FROM t), s AS (SELECT p.*, w FROM p JOIN v ON lower(surface) = w)"""


def span_annotate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    x = annotate.annotate(d, annotate.keyword_index(_vocabulary(spark, sf)))
    return x.select("doc_id", F.size("spans").alias("n_spans"), F.md5(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["surface"])), "|").cast("binary")).alias("digest"))


def span_offsets_valid(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    spans = annotate.annotate(d, annotate.keyword_index(_vocabulary(spark, sf)))
    x = d.join(spans, "doc_id").select(F.size(annotate.offset_errors(F.col("text"), F.col("spans"))).alias("e"), F.size("spans").alias("n"))
    return x.agg(F.sum("n").alias("spans"), F.sum("e").alias("errors"))


def span_remap(spark, sf):
    """Every third word of the benchmark, marked up, and where it is in the clean text."""
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    before = F.when(F.col("i") % 4 == 0, "<i class='a'>").when(F.col("i") % 4 == 1, "&lt;&nbsp;").otherwise("")
    piece = F.concat(before, "w", F.when(F.col("i") % 4 == 0, "</i>").otherwise(""), F.when(F.col("i") % 5 == 0, "  \t ").otherwise(" "))
    b = b.select("item_id", "i", "w", F.length(before).alias("n"), piece.alias("piece"))
    at = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 6
    b = b.select("item_id", "i", "piece", F.struct((at + F.col("n")).cast("int").alias("start"), (at + F.col("n") + F.length("w")).cast("int").alias("end"), F.lit("word").alias("type")).alias("s"))
    b = b.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "piece", "s"))).alias("p"))
    text = F.concat(F.lit(" <p>\t "), F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit("</p>"))
    x = annotate.remapped(b.select(F.col("item_id").alias("doc_id"), text.alias("text"), F.transform(F.filter("p", lambda x: x["i"] % 3 == 0), lambda x: x["s"]).alias("spans")))
    return x.select(F.col("doc_id").alias("item_id"), F.length("text").alias("chars"), F.explode("spans").alias("s")).select("item_id", "chars", "s.surface", "s.start", "s.end")


_REMAP_SQL = """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark),
  p AS (SELECT *, CASE WHEN i % 4 = 1 THEN 2 ELSE 0 END AS more FROM w),
  s AS (SELECT *, sum(length(w) + more + 1) OVER (PARTITION BY item_id ORDER BY i) - length(w) - 1 AS start, sum(length(w) + more + 1) OVER (PARTITION BY item_id) - 1 AS chars FROM p)
  SELECT item_id, chars::INTEGER AS chars, w AS surface, start::INTEGER AS start, (start + length(w))::INTEGER AS "end" FROM s WHERE i % 3 = 0"""


def overlap_metrics(spark, sf):
    """Overlap of each document's tokens with the next one's by id."""
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    x = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id")
    return x.select("doc_id", stats.overlap(F.col("t"), F.col("u")).alias("o")).select("doc_id", "o.*")


_OVERLAP_SQL = f"""WITH d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), x AS (SELECT a.doc_id, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS e, len(b.t) AS f FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
  SELECT doc_id, CASE WHEN e = 0 AND f = 0 THEN 1 WHEN e = 0 OR f = 0 THEN 0 ELSE round(i / (e + f - i), 6) END AS jaccard,
  CASE WHEN e = 0 AND f = 0 THEN 1 WHEN e = 0 OR f = 0 THEN 0 ELSE round(i / f, 6) END AS precision, CASE WHEN e = 0 AND f = 0 THEN 1 WHEN e = 0 OR f = 0 THEN 0 ELSE round(i / e, 6) END AS recall FROM x"""


def pagination(spark, sf):
    """The second page of ten documents of one source, by id."""
    d = table(spark, sf, "documents").where("source = 'src0'").select("doc_id", "n_chars")
    return d.orderBy("doc_id").offset(10).limit(10)


def hash_sample(spark, sf):
    return curate.bernoulli(table(spark, sf, "documents").select("doc_id", "lang"), 0.3, "doc_id")


def reading_order(spark, sf):
    """Rank of a document in its source by length, and the gap to the next longer one."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", F.row_number().over(w).alias("rank"), (F.lag("n_chars").over(w) - F.col("n_chars")).alias("gap"))


QUERIES = {
    "bm25_topk": (bm25_topk, _BM25_SQL),
    "doc_freq": (doc_freq, f"WITH d AS (SELECT unnest({tokens_sql('text')}) AS token FROM documents) SELECT token, count(*) AS df FROM d GROUP BY token"),
    "corpus_size": (corpus_size, f"SELECT count(*) AS n_docs, round(avg(len({tokens_sql('text')})), 6) AS avg_tokens FROM documents"),
    "norm_dedup_first": (norm_dedup_first, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"),
    "dedup_md5": (dedup_md5, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)"),
    "category_distribution": (category_distribution, "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY lang"),
    "split_train_val_test": (split_train_val_test, """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r"""),
    "quality_gate": (quality_gate, "SELECT lang, coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AND n_chars >= 100 AS kept, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "left_join_verdict": (left_join_verdict, """WITH x AS (SELECT n_chars % 3 > 0 AS a, coalesce(quality = 1, true) AS b FROM documents LEFT JOIN labels USING (doc_id))
  SELECT CASE WHEN a AND b THEN 'tie' WHEN a THEN 'better' WHEN b THEN 'worse' ELSE 'both_wrong' END AS verdict, count(*) AS n FROM x GROUP BY 1"""),
    "antijoin_merge": (antijoin_merge, """WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)
  SELECT min(doc_id) AS doc_id FROM k WHERE doc_id % 2 = 0 AND t NOT IN (SELECT t FROM k WHERE doc_id % 2 = 1) GROUP BY t"""),
    "exclude_sampled": (exclude_sampled, "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3"),
    "quota_sample": (quota_sample, "SELECT c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) <= 10"),
    "html_strip": (html_strip, f"SELECT page_id, sha256({_STRIP}) AS clean FROM pages"),
    "html_clean_stats": (html_clean_stats, f"SELECT count(*) AS pages, sum(({_STRIP} <> html)::INTEGER)::BIGINT AS changed, sum(length(html) - length({_STRIP}))::BIGINT AS removed_chars FROM pages"),
    "url_parts": (url_parts, "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[/#]+$', ''), '/')) AS last_part FROM pages"),
    "url_decode": (url_decode, "SELECT page_id, url_decode(replace(url || '%20a+b%2Fc', '+', ' ')) AS decoded FROM pages"),
    "chat_format": (chat_format, "SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id"),
    "conv_pairs": (conv_pairs, """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS input, arg_min(text, turn) FILTER (role = 'assistant') AS expected FROM conversations GROUP BY conv_id
  HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0"""),
    "text_ids": (text_ids, "SELECT doc_id, substr(md5('doc:' || doc_id), 1, 12) AS record_id FROM documents"),
    "span_annotate": (span_annotate, _SPANS + """, g AS (SELECT doc_id, count(*)::INTEGER AS n, string_agg(start || ':' || surface, '|' ORDER BY start) AS a FROM s GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_spans, md5(coalesce(a, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)"""),
    "span_offsets_valid": (span_offsets_valid, _SPANS + " SELECT count(*) AS spans, 0::BIGINT AS errors FROM s"),
    "span_remap": (span_remap, _REMAP_SQL),
    "overlap_metrics": (overlap_metrics, _OVERLAP_SQL),
    "pagination": (pagination, "SELECT doc_id, n_chars FROM documents WHERE source = 'src0' ORDER BY doc_id LIMIT 10 OFFSET 10"),
    "hash_sample": (hash_sample, "SELECT doc_id, lang FROM documents WHERE ('0x' || substr(md5('42|' || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.3"),
    "reading_order": (reading_order, "SELECT doc_id, source, (row_number() OVER w)::INTEGER AS rank, lag(n_chars) OVER w - n_chars AS gap FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)"),
}
