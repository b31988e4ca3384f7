"""Curation of (natural language, query) pairs: checks, actions, dedup, merge, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import qlang
from ..functions.text import hash_uniform, squash, strip_lower

BIBCODE = r"\b\d{4}[A-Za-z&]+\.{0,3}\d+[A-Z]?\.\.[.\d]+[A-Z]?\b"
PAPER_WORDS = ("paper", "papers", "article", "articles", "publication", "publications")
GENERIC = ("observations", "studies", "research", "analysis", "data", "results")
# Words of log queries that are no literature search.
NOT_SCIENCE = (
    "diary", "murder", "pirate", "lumberman", "negroes", "biography", "memoir", "trial", "execution", "political", "newspaper",
    "magazine", "wiki", "blog", "official site", "san francisco", "masons", "register", "california",
)


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in ``order`` (W1 to W6). The least row is found by partial
    aggregation, so a key with very many rows never gathers in one task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    x = df.select(key.alias("_key"), F.col(order).alias("_order"), whole.alias("_row"))
    return x.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def dedup_two_keys(pairs: DataFrame, order: str) -> DataFrame:
    """Keep-first on the text, then keep-first on the query of what is left."""
    once = keep_first(pairs, strip_lower(F.col("natural_language")), order)
    return keep_first(once, strip_lower(F.col("ads_query")), order)


def new_only(batch: DataFrame, known: DataFrame, text: str, order: str) -> DataFrame:
    """Rows of the batch whose squashed text is neither known nor earlier in the batch."""
    keyed = batch.withColumn("_text", squash(F.col(text)))
    left = keyed.join(known.select(squash(F.col(text)).alias("_text")).distinct(), "_text", "left_anti").drop("_text")
    return keep_first(left.select(*batch.columns), squash(F.col(text)), order)


def _words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def problems(nl: Column, query: Column, whole_years: bool = False) -> Column:
    """``issue, severity`` of each curation check that a pair fails (F14). Years that only the query has are compared
    by century, as the checks were first run; with ``whole_years`` by all four digits (G13)."""
    inside = F.regexp_extract(query, r"abs:\s*\(([^)]+)\)", 1)
    plain_long = (F.length(inside) > 50) & ~inside.rlike(r"\b(OR|AND)\b")
    titled = inside.rlike(r"^(The|A|An)\s+\w+") | inside.rlike(r"\b(of|in|for|with|from|by|on|to)\s+the\b") | inside.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Z][a-z]+")
    phrases = F.regexp_extract_all(query, F.lit(r'(abs|title):\s*"([^"]+)"'), F.lit(2))

    def over(p: Column) -> Column:
        ws = _words(p)
        return (F.size(ws) > 3) | ((F.size(ws) == 2) & F.exists(ws, lambda w: F.lower(w).isin(*GENERIC)))

    years = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b((19|20)\d{2})\b"), F.lit(1 if whole_years else 2)))
    quoted, grouped = F.regexp_extract(query, r'abs:\s*"([^"]+)"', 1), inside
    loose = lambda c: (F.size(_words(c)) >= 3) & ~c.rlike(r"(?i)\b(OR|AND|NOT)\b")
    checks = [
        ("bibcode_as_query", "remove", query.rlike(BIBCODE)),
        ("exact_title_in_abs", "fix", (inside != "") & (plain_long | titled)),
        ("over_quoted", "review", F.exists(phrases, over)),
        ("missing_doctype", "fix", nl.rlike("(?i)" + "|".join(PAPER_WORDS)) & ~F.contains(F.lower(query), F.lit("doctype:"))),
        ("over_inference", "review", F.size(F.array_except(years(query), years(nl))) > 0),
        ("missing_boolean_ops", "review", ((quoted != "") & loose(quoted)) | ((grouped != "") & loose(grouped))),
    ]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, c in checks]), lambda x: x.isNotNull())


def action(issues: Column) -> Column:
    """The gravest severity of a pair's issues: remove, fix, review or keep."""
    has = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    return F.when(has("remove"), "remove").when(has("fix"), "fix").when(has("review"), "review").otherwise("keep")


# Logged queries of these forms are lookups or use calls of their own.
SKIPPED_FORMS = (
    r"^citations\(", r"^references\(", r"^docs\(library/", r"pubnote:\(", r"^#ERROR!$", r"^bibcode:\d{4}", r"identifier:\(", r"^similar\(",
    r"^trending\(", r"^useful\(", r"^reviews\(", r"collection:", r'full:"\d+"', r"^\*:\*$",
)


def skip_query(q: Column) -> Column:
    """Whether a logged query is left out."""
    low = F.lower(q)
    out = q.rlike("(?i)" + "|".join(SKIPPED_FORMS)) | (F.length(q) > 300) | low.rlike("|".join(NOT_SCIENCE)) | (F.size(F.split(q, " OR ")) > 4)
    return out | q.rlike(r"year:\d{1,2}(?!\d)") | F.contains(q, F.lit("9999")) | F.contains(q, F.lit("0000"))


def mentions_papers(nl: Column) -> Column:
    """Whether a request speaks of papers."""
    return nl.rlike(r"(?i)\b(" + "|".join([*PAPER_WORDS, "study", "studies"]) + r")\b")


def clean_log_query(q: Column) -> Column:
    """Blanks collapsed, doubled apostrophes as quotes, ``year_2020`` as ``year:2020``."""
    x = F.trim(F.regexp_replace(q, r"\s+", " "))
    return F.regexp_replace(F.replace(x, F.lit("''"), F.lit('"')), r"year_(\d{4})", "year:$1")


def log_category(q: Column) -> Column:
    """The category of a logged query by its first matching field."""
    low = F.lower(q)
    has = lambda *m: low.rlike("|".join(m))
    return (
        F.when(has("\\^author:") | (has("author:") & F.contains(q, F.lit("^"))), "first_author")
        .when(has("author:"), "author")
        .when(has("object:"), "astronomy")
        .when(has("bibstem:", "bibcode:"), "publication")
        .when(has("citation_count:", "read_count:"), "metrics")
        .when(has("aff:", "inst:"), "affiliation")
        .when(has("arxiv:", "doi:", "arxiv_class:"), "identifiers")
        .when(has("property:", "database:", "doctype:"), "properties")
        .when(has("pubdate:", "year:") & has("abs:", "title:"), "compound")
        .when(has("pubdate:", "year:"), "publication")
        .when(has("abs:", "title:", "full:"), "content")
        .when(qlang.unfielded(q), "unfielded")
        .otherwise("compound")
    )


def gate(pairs: DataFrame, least_score: int = 3) -> DataFrame:
    """``pairs`` with ``reasons`` and ``kept``: natural text, sound query, allowed values, score (F16)."""
    nl, q = F.col("natural_language"), F.col("ads_query")

    def values(f: str) -> Column:
        return F.transform(qlang.wrong_values(q, f), lambda v: F.concat(F.lit(f"Value: {f}="), v))

    wrong = F.flatten(F.array(*[values(f) for f in ("doctype", "database", "property", "bibgroup")]))
    low = F.when(F.coalesce(F.col("llm_score"), F.lit(5)) < least_score, F.array(F.lit("Score"))).otherwise(F.expr("cast(array() as array<string>)"))
    reasons = F.concat(F.transform(qlang.nl_issues(nl), lambda i: F.concat(F.lit("NL: "), i)), F.transform(qlang.lint(q), lambda i: F.concat(F.lit("Query: "), i)), wrong, low)
    return pairs.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def split(df: DataFrame, key: str, fractions: tuple[float, ...] = (0.8, 0.1), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """``df`` with ``split``: rows in the order of a seeded hash, cut at the truncated
    fractions of their number; the last part takes the rest (W10).

    Ranks come from counts by hash bucket and ranks within a bucket, so no task
    has more than a bucket's rows. ``key`` must be unique."""
    buckets = 4096
    x = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    x = x.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    x = x.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    assert buckets == 16**3  # before has a row for each three digits at most
    edge, label = F.lit(0), None
    for f, n in zip(fractions, names, strict=False):
        edge = edge + F.floor(F.col("_total") * f)
        label = F.when(F.col("_r") < edge, n) if label is None else label.when(F.col("_r") < edge, n)
    return x.withColumn("split", label.otherwise(names[len(fractions)])).select(*df.columns, "split")


def quota_sample(df: DataFrame, group: str, order: list[Column], quota: int) -> DataFrame:
    """The first ``quota`` rows of each group (W13): the feature is the quota. Each task keeps
    its own best rows before the groups meet, so a hot group costs quota rows a task."""
    parts = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    local = Window.partitionBy(group, "_p").orderBy(*order)
    first = df.withColumn("_p", parts).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= quota).drop("_p", "_r")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= quota).drop("_r")


def bernoulli(df: DataFrame, p: float, *keys: str, seed: int = 42) -> DataFrame:
    """Rows whose seeded hash is below ``p``."""
    return df.where(hash_uniform(*[F.col(k).cast("string") for k in keys], seed=seed) < p)


def mixed_radix(spark, sizes: dict[str, int], limit: int | None = None) -> DataFrame:
    """All combinations of slot indexes, the first slot fastest, without a cross join."""
    total = 1
    for n in sizes.values():
        total *= n
    x, div = spark.range(min(total, limit) if limit else total).withColumnRenamed("id", "combo"), 1
    for name, n in sizes.items():
        x = x.withColumn(name, F.pmod(F.floor(F.col("combo") / div), F.lit(n)).cast("int"))
        div *= n
    return x
