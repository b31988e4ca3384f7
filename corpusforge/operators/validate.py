"""Validation of pairs and records: error types, caches, closed-value suggestions, acceptance gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import qlang, vocab

CLOSED = ("doctype", "database", "property", "bibgroup")


def invalid_values(query: Column) -> Column:
    """``Invalid field value: 'v'`` for each wrong closed value (F2)."""

    def of(field: str) -> Column:
        return F.transform(qlang.wrong_values(query, field), lambda v: F.concat(F.lit(f"Invalid {field} value: '"), v, F.lit("'")))

    return F.flatten(F.array(*[of(f) for f in CLOSED]))


def error_type(syntax: Column, closed: Column) -> Column:
    """The kind of a query's first error."""
    first = F.get(syntax, F.lit(0))
    has = lambda m: F.contains(F.lower(first), F.lit(m))
    kind = F.when(has("unbalanced quotes"), "unbalanced_quotes").when(has("unbalanced parentheses"), "unbalanced_parentheses").when(has("unbalanced brackets"), "unbalanced_brackets")
    kind = kind.when(has("unknown field"), "unknown_field").when(has("boolean operator") | has("cannot start with") | has("cannot end with"), "invalid_boolean").when(has("empty query"), "empty_query").otherwise("syntax_error")
    return F.when(F.size(syntax) > 0, kind).when(F.size(closed) > 0, "invalid_field_value")


def validate_local(pairs: DataFrame, query: str = "ads_query") -> DataFrame:
    """``pairs`` with ``status`` (valid, quarantine), ``error_type`` and ``errors``."""
    x = pairs.withColumn("_s", qlang.lint(F.col(query))).withColumn("_c", invalid_values(F.col(query)))
    x = x.withColumn("errors", F.concat("_s", "_c")).withColumn("error_type", error_type(F.col("_s"), F.col("_c")))
    return x.withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("quarantine")).drop("_s", "_c")


def query_hash(query: Column, version: str) -> Column:
    """The key of a query in a validation cache: caches of other tools can be read."""
    return canonical_hash(qlang.canonicalize(query), version)


def canonical_hash(canonical: Column, version: str) -> Column:
    """``query_hash`` of a query in its one form: keys for several versions need that form once."""
    return F.md5(F.concat(canonical, F.lit(f"::{version}")).cast("binary"))


def validate_cached(pairs: DataFrame, cache: DataFrame | None, version: str, query: str = "ads_query") -> DataFrame:
    """``pairs`` with ``valid, tier, error`` from a validation cache (F8, J14): entries of another validator
    version don't count, the last of a hash does. Without a cache all pass at tier 2; a
    query that isn't cached is pending (tier 1)."""
    x = pairs.withColumn("_h", query_hash(F.col(query), version))
    if cache is None:
        return x.drop("_h").withColumns({"valid": F.lit(True), "tier": F.lit(2), "error": F.lit(None).cast("string")})
    last = cache.where(F.col("validator_version") == version).groupBy(F.col("query_hash").alias("_h")).agg(F.max_by(F.struct("valid", "tier", "error"), "cached_at").alias("_r"))
    x = x.join(last, "_h", "left")
    return x.withColumns({"valid": F.col("_r.valid"), "tier": F.coalesce("_r.tier", F.lit(1)), "error": F.col("_r.error")}).drop("_h", "_r")


def remote_error(message: Column) -> Column:
    """The class of a remote error message."""
    has = lambda *m: F.lower(message).rlike("|".join(m))
    return F.when(has("parse error"), "parse_error").when(has("rate limit"), "rate_limit").when(has("timeout"), "timeout").when(has("api key", "unauthorized", "401"), "auth_error").when(has("request error", "connection"), "network_error").otherwise("api_error")


# The fields of the record types (F10) and what each must be: ``text`` (not blank), ``given`` (a text, perhaps
# empty), ``texts`` (a list without null or blank items), ``some texts`` (not empty either), ``any texts`` (items may be blank), ``map``, ``flag``,
# ``count`` (not negative), ``number``, ``tier`` (0 to 3), ``share`` (0 to 1), ``time`` (ISO), or one of a set of words. A question mark: null or absent is as good.
# A list of records of another type is ``each type``, one such record ``a type``.
RECORDS = {
    "source": {"id": "text", "type": {"http", "git"}, "url": "text", "retrieved_at": "time?"},
    "source_manifest": {"generated_at": "time?", "sources": "each source"},
    "topic": {"id": "text", "label": "text", "aliases": "texts", "parents": "texts", "children": "texts"},
    "entity": {"id": "text", "label": "text", "aliases": "texts", "metadata": "map"},
    "slot": {"name": "text", "type": "text", "required": "flag", "constraints": "map"},
    "template": {"id": "text", "intent": "text", "nl_templates": "some texts", "ads_query_template": "text", "slots": "each slot", "constraints": "map"},
    "input": {"input_id": "text", "user_text": "text", "template_id": "text", "filled_slots": "map", "source_ids": "texts"},
    "pair": {"pair_id": "text", "user_text": "text", "ads_query": "text", "template_id": "text", "filled_slots": "map", "validation_tier": "tier", "validation_errors": "any texts", "created_at": "time?"},
    "quarantined_pair": {"pair_id": "text", "user_text": "text", "ads_query": "text", "template_id": "text", "filled_slots": "map", "error_type": "given", "error_details": "given", "failed_at_tier": "number"},
    "enrichment": {"example_id": "text", "user_text": "text", "labels": "map", "provenance": "map"},
    "report": {
        "sources_count": "count", "topics_count": "count", "entities_count": "count", "templates_count": "count", "inputs_count": "count", "pairs_valid_count": "count",
        "pairs_quarantined_count": "count", "enrichment_labels_count": "count", "backend_pass_rate": "share?", "pairs_by_template": "map", "pairs_by_intent": "map",
        "quarantine_by_error_type": "map", "started_at": "time?", "completed_at": "time?",
    },
    "checksum": {"path": "text", "checksum_sha256": "text", "size_bytes": "count", "line_count": "number?"},
    "reproduce": {"pinned_revisions": "map"},
    "run_manifest": {
        "run_id": "text", "created_at": "time", "started_at": "time?", "completed_at": "time?", "run_directory": "given", "status": {"pending", "in_progress", "completed", "failed"},
        "stages_completed": "texts", "artifacts": "each checksum", "reproduce": "a reproduce?",
    },
}
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def _broken(fields: T.StructType, get, kind: str) -> list[tuple[Column, str]]:
    """(condition, message) of each rule of a record type that can be broken; ``get`` makes a field's Column."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out: list[tuple[Column, str]] = []
    for name, rule in RECORDS[kind].items():
        optional = isinstance(rule, str) and rule.endswith("?")
        if name not in fields.fieldNames():
            out += [] if optional else [(F.lit(True), f"{name} is required")]
            continue
        c, is_ = get(name), rule.rstrip("?") if isinstance(rule, str) else rule
        if is_ == "text":
            out.append((blank(c), f"{name} is required"))
            continue
        if not optional:
            out.append((c.isNull(), f"{name} is required"))
        if isinstance(is_, set):
            out.append((~c.isin(*sorted(is_)), f"{name} is none of {', '.join(sorted(is_))}"))
        elif is_ in ("texts", "some texts", "any texts"):
            out.append((F.exists(c, lambda v: v.isNull()), f"{name} has a null item"))
            if is_ != "any texts":
                out.append((F.exists(c, lambda v: F.trim(v) == ""), f"{name} has a blank item"))
            if is_ == "some texts":
                out.append((F.size(c) == 0, f"{name} is empty"))
        elif is_ in ("count", "share", "tier"):
            low, high, where = {"count": (0, None, "is negative"), "share": (0, 1, "is outside 0 to 1"), "tier": (0, 3, "is outside 0 to 3")}[is_]
            out.append(((c < low) | (F.lit(False) if high is None else c > high), f"{name} {where}"))
        elif is_ == "time":
            out.append((~c.rlike(_ISO), f"{name} is no ISO time"))
        elif is_.startswith("each "):
            element = fields[name].dataType.elementType
            for test, message in _broken(element, lambda n: F.col(n), is_[5:]):
                out.append((_in_some(c, element, is_[5:], message), f"{name}: {message}"))
        elif is_.startswith("a "):
            inner = fields[name].dataType
            out += [(c.isNotNull() & test, f"{name}: {message}") for test, message in _broken(inner, lambda n, c=c: c[n], is_[2:])]
    return out


def _in_some(items: Column, element: T.StructType, kind: str, message: str) -> Column:
    """Whether the rule with this message is broken by some item of a list of records."""
    return F.exists(items, lambda e: next(test for test, m in _broken(element, lambda n: e[n], kind) if m == message))


def record_errors(df: DataFrame, kind: str) -> Column:
    """Violations of a record type's rules, in the order of its fields (F10, Z19). A required field that is null or no
    column at all is a violation; other columns are free. What a column's type rules out isn't tested."""
    return qlang.issues(*[(F.coalesce(test, F.lit(False)), message) for test, message in _broken(df.schema, F.col, kind)])


def suggestions(query_values: DataFrame, field: str, most: int = 3) -> DataFrame:
    """``value, suggestions`` for distinct values of a closed field (X26): prefixes first, then substrings, then three common
    first letters; ties by name (G7)."""
    allowed = F.array(*[F.lit(v) for v in sorted(set(vocab.ENUMS[field]))])
    low = F.lower("value")

    def scored(v: Column) -> Column:
        w = F.lower(v)
        near = F.when(w.startswith(low) | low.startswith(w), 0).when(F.contains(w, low) | F.contains(low, w), 1).when((F.length(w) > 2) & (F.length(low) > 2) & (F.substring(w, 1, 3) == F.substring(low, 1, 3)), 2)
        return F.struct(near.alias("near"), v.alias("v"))

    ranked = F.array_sort(F.filter(F.transform(allowed, scored), lambda s: s["near"].isNotNull()))
    return query_values.select("value").distinct().select("value", F.slice(F.transform(ranked, lambda s: s["v"]), 1, most).alias("suggestions"))


# Phrases that point at a paper without naming it.
AMBIGUOUS = (
    r"\bthis paper\b", r"\bthat paper\b", r"\bthe paper\b", r"\bfamous paper\b", r"\bgroundbreaking (paper|study|work)\b", r"\bseminal (paper|study|work)\b",
    r"\blandmark (paper|study|work)\b", r"\boriginal (paper|study|work)\b", r"\bclassic (paper|study|work)\b", r"\bpioneering (paper|study|work)\b",
    r"\binfluential (paper|study|work)\b",
)


def needs_resolution(operator: Column, target: Column, text: Column) -> Column:
    """Whether an operator lacks its paper while the text points at one."""
    pointed = F.lower(text).rlike("|".join(AMBIGUOUS))
    return F.coalesce(operator.isin("citations", "references", "similar") & (F.trim(F.coalesce(target, F.lit(""))) == "") & pointed, F.lit(False))


def paper_hint(text: Column) -> Column:
    """What a text says of the paper it means: subject, author, year, journal; null if nothing."""
    low = F.lower(text)
    find = lambda p: F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit(""))
    year = find(r"(?:the\s+)?(\d{4})\s+(?:paper|study)")
    parts = F.array(find(r"(?:paper|study|work)\s+(?:about|on)\s+([^,\.]+)"), find(r"(\w+(?:'s)?)\s+(?:famous|seminal|classic)\s+paper"), F.concat(F.lit("year:"), year), find(r"(?:published in|from)\s+(\w+)"))
    return F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "), F.lit(""))


def resolve(hints: DataFrame, papers: DataFrame) -> DataFrame:
    """``id, bibcode`` of the most cited paper with all of a hint's words in its title (N10, the part without a model).
    ``hints (id, hint)``, ``papers (bibcode, title, citation_count)``.

    Hints of the same words are looked up once, of titles of the same words only the most cited paper counts, and a
    hint meets the titles that have its rarest word, so no table of all pairs with a common word is made."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]{3,})"), F.lit(1))))
    h = hints.select("id", words("hint").alias("w")).where("size(w) > 0")
    p = papers.select("bibcode", "citation_count", words("title").alias("t")).where("size(t) > 0")
    p = p.groupBy("t").agg(F.max(F.struct("citation_count", "bibcode")).alias("best")).select("best", "t", F.explode("t").alias("word"))
    titles = p.groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    # A word of no title is the rarest of all; its hint meets nothing.
    rare = h.select("w").distinct().select("w", F.explode("w").alias("word")).join(titles, "word", "left")
    rare = rare.groupBy("w").agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "word")).alias("r")).select("w", F.col("r.word").alias("word"))
    found = rare.join(p, "word").where(F.size(F.array_except("w", "t")) == 0).groupBy("w").agg(F.max("best").alias("best"))
    return h.join(found, "w").groupBy("id").agg(F.max("best").alias("best")).select("id", "best.bibcode")


def bare_values(query: Column) -> Column:
    """``field:value`` of text fields whose value is neither quoted nor a range."""
    return F.regexp_extract_all(query, F.lit(r'(?i)\b((?:author|bibstem|title|abs|aff|inst|object):(?!"|\[)[^\s()]+)'), F.lit(1))


# Phrases that go with an operator.
TRIGGERS = {
    "citations": [r"papers? (that )?cit(e|ing|ed)", r"cit(e|ing|ed) (by|papers?)", r"cited by", r"citations? (of|to)"],
    "references": [r"references? (of|by|in|from)", r"cited in", r"what (does|did) .+ cite", r"bibliography", r"sources? cited"],
    "trending": [r"trending", r"popular", r"hot (papers?|topics?)", r"what's hot"],
    "similar": [r"similar (to|papers?)", r"like", r"related (to|papers?)", r"resembl"],
    "useful": [r"useful", r"helpful", r"foundational", r"essential", r"important"],
    "reviews": [r"review (articles?|papers?)?", r"survey", r"overviews?", r"comprehensive"],
    "topn": [r"top \d+", r"most cited", r"highest cited", r"best papers?"],
}


def trigger_phrases(nl: Column, ops: Column) -> Column:
    """``operator, phrase``: the first match of each pattern of the operators in a query."""

    def of(s: Column) -> Column:
        found = []
        for op, patterns in TRIGGERS.items():
            for p in patterns:
                m = F.regexp_extract(s["nl"], f"({p})", 1)
                found.append(F.when(F.array_contains(s["ops"], op) & (m != ""), F.struct(F.lit(op).alias("operator"), m.alias("phrase"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return qlang.once(F.struct(F.lower(nl).alias("nl"), ops.alias("ops")), of)


def syntax_counters(pairs: DataFrame, query: str = "ads_query") -> DataFrame:
    """One row of counts: quoted phrases, ranges, booleans, author forms."""
    q = F.col(query)
    has = lambda s: F.contains(q, F.lit(s))
    author = F.regexp_extract(q, r'author:([^"\s]*(?:"[^"]*")?)', 1)
    quoted = has("author:") & F.contains(author, F.lit('"'))
    count = {
        "quoted_phrases": has('"'),
        "ranges": has("[") & has(" TO "),
        "boolean_or": has(" OR "),
        "boolean_and": has(" AND "),
        "boolean_not": has(" NOT "),
        "author_spaced_initial": quoted & F.contains(author, F.lit(", ")),
        "author_initial": quoted & ~F.contains(author, F.lit(", ")) & F.contains(author, F.lit(",")),
        "author_quoted": quoted & ~F.contains(author, F.lit(",")),
        "author_bare": has("author:") & ~F.contains(author, F.lit('"')),
        "first_author": has("^author:"),
    }
    return pairs.agg(*[F.sum(c.cast("long")).alias(n) for n, c in count.items()])


def acceptance(counts: DataFrame, least_total: int, least_each: int) -> DataFrame:
    """One row ``total, smallest, passed`` of ``counts (name, n)``."""
    x = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"))
    return x.withColumn("passed", (F.col("total") >= least_total) & (F.col("smallest") >= least_each))


def gap(v1_synthetic: Column, v1_real: Column, v2_synthetic: Column, v2_real: Column) -> Column:
    """How much a second version narrows the gap between synthetic and real scores."""
    a, b = v1_synthetic - v1_real, v2_synthetic - v2_real
    return F.struct(F.round(a, 4).alias("v1_gap"), F.round(b, 4).alias("v2_gap"), F.round(a - b, 4).alias("improvement"), F.round(F.coalesce(F.try_divide(100 * (a - b), a), F.lit(0.0)), 2).alias("improvement_pct"))


def go_no_go(synthetic: Column, real: Column, synthetic_least: float, real_least: float) -> Column:
    """GO, CONDITIONAL GO or NO GO (A28); a missing real score is pending."""
    return F.when(synthetic < synthetic_least, "NO GO").when(real >= real_least, "GO").otherwise("CONDITIONAL GO")


def sound_syntax(query: Column) -> Column:
    """The basic check of a model's output."""
    bad = r"(?i)citationsabs:|referencesabs:|citations\s*\(\s*citations|references\s*\(\s*references"
    even = F.length(F.replace(query, F.lit("("), F.lit(""))) == F.length(F.replace(query, F.lit(")"), F.lit("")))
    return F.coalesce((query != "") & ~query.startswith("ERROR") & even & ~query.rlike(bad), F.lit(False))


def review(nl: Column, query: Column, category: Column) -> Column:
    """``type, severity, description`` of a reviewer's checks, the first of each description."""
    from .curate import BIBCODE, PAPER_WORDS

    def note(kind: str, severity: str, text) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (text if isinstance(text, Column) else F.lit(text)).alias("description"))

    def when(condition: Column, kind: str, severity: str, text) -> Column:
        return F.filter(F.array(F.when(condition, note(kind, severity, text))), lambda x: x.isNotNull())

    inside = F.regexp_extract(query, r"abs:\s*\(([^)]+)\)", 1)
    names = F.regexp_extract_all(nl, F.lit(r"\bby\s+([A-Z][a-z]+)\b"), F.lit(1))
    initials = F.filter(F.regexp_extract_all(query, F.lit(r'author:\s*"([^"]+,\s*[A-Z]\.?\s*[A-Z]?\.?)"'), F.lit(1)), lambda a: a.rlike(r",\s*[A-Z]\."))
    guessed = F.flatten(F.transform(names, lambda n: F.transform(F.filter(initials, lambda a: F.contains(F.lower(a), F.lower(n)) & ~F.regexp_like(nl, F.concat(F.lit(r"(?i)\b"), n, F.lit(r"\s+[A-Z]\.?\b")))), lambda a: note("author_initials", "critical", F.concat(F.lit("Author '"), n, F.lit("' got initials '"), a, F.lit("'"))))))
    found = F.concat(
        when(category == "unfielded", "category", "medium", "Category is 'unfielded'"),
        when(query.rlike(BIBCODE), "bibcode_lookup", "critical", "Query contains a bibcode"),
        guessed,
        when((F.length(inside) > 50) & ~inside.rlike(r"\b(OR|AND)\b"), "exact_title", "high", "abs:() contains an exact title"),
        when(nl.rlike("(?i)" + "|".join(PAPER_WORDS)) & ~F.contains(F.lower(query), F.lit("doctype:")), "missing_doctype", "medium", "NL mentions papers but the query has no doctype"),
        F.transform(qlang.lint(query), lambda e: note("syntax", "high", e)),
        F.transform(invalid_values(query), lambda e: note("hallucination", "high", e)),
        when(query.rlike(r"abs:\s*\([^)]*\b[A-Z][a-z]+\s+[A-Z][a-z]+\b") & F.contains(F.lower(nl), F.lit("by")) & ~F.contains(F.lower(query), F.lit("author:")), "alignment", "high", "NL names an author but the query uses abs:"),
    )
    return F.array_distinct(found)  # one description always has one type and severity


def review_action(issues: Column) -> Column:
    """remove for a bibcode, fix for grave issues, review for others, else keep."""
    has = lambda f: F.exists(issues, f)
    return F.when(has(lambda i: i["type"] == "bibcode_lookup"), "remove").when(has(lambda i: i["severity"].isin("critical", "high")), "fix").when(F.size(issues) > 0, "review").otherwise("keep")
