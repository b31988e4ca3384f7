"""The search language: assembling, linting and taking queries apart (Columns only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import quote_if_needed, strings

FIELD = r"(?<![.\d])(\^?[a-z_]{2,}+):"
_BOOLEAN = "(AND|OR|NOT)"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row, however often ``then`` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def issues(*pairs: tuple[Column, str | Column]) -> Column:
    """The messages whose condition holds, in the given order."""
    return F.array_remove(F.array(*[F.when(c, F.coalesce(m, F.lit("")) if isinstance(m, Column) else F.lit(m)).otherwise("") for c, m in pairs]), "")


# ---- assembling (N8) ----------------------------------------------------------


def author_clause(authors: Column) -> Column:
    return F.concat_ws(" ", F.transform(authors, lambda a: F.concat(F.lit('author:"'), a, F.lit('"'))))


def abstract_clause(terms: Column) -> Column:
    return F.concat_ws(" ", F.transform(terms, lambda t: F.concat(F.lit("abs:"), quote_if_needed(t))))


def any_clause(terms: Column) -> Column:
    joined = F.array_join(F.transform(terms, quote_if_needed), " OR ")
    return F.when(F.size(terms) > 1, F.concat(F.lit("abs:("), joined, F.lit(")"))).when(F.size(terms) == 1, F.concat(F.lit("abs:"), joined)).otherwise("")


def year_clause(lo: Column, hi: Column) -> Column:
    text = F.concat(F.lit("pubdate:["), F.coalesce(lo.cast("string"), F.lit("*")), F.lit(" TO "), F.coalesce(hi.cast("string"), F.lit("*")), F.lit("]"))
    return F.when(lo.isNull() & hi.isNull(), "").otherwise(text)


def each_clause(field: str, values: Column, always_quote: bool = False) -> Column:
    quoted = (lambda v: F.concat(F.lit('"'), v, F.lit('"'))) if always_quote else quote_if_needed
    return F.concat_ws(" ", F.transform(values, lambda v: F.concat(F.lit(f"{field}:"), quoted(v))))


def canonical(field: str, values: Column) -> Column:
    """The allowed values among ``values``, in their canonical spelling, sorted."""
    names = {v.lower(): v for v in vocab.ENUMS[field]}
    if all(low == v for low, v in names.items()):  # a set is looked up faster than a map
        good = F.filter(F.transform(values, F.lower), lambda v: v.isin(*names))
    else:
        allowed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        good = F.filter(F.transform(values, lambda v: F.element_at(allowed, F.lower(v))), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(good))


def enum_clause(field: str, values: Column) -> Column:

    def clause(good: Column) -> Column:
        joined = F.array_join(good, " OR ")
        return F.when(F.size(good) > 1, F.concat(F.lit(f"{field}:("), joined, F.lit(")"))).when(F.size(good) == 1, F.concat(F.lit(f"{field}:"), joined)).otherwise("")

    return once(canonical(field, values), clause)


def join_clauses(*clauses: Column) -> Column:
    return F.array_join(F.filter(F.array(*clauses), lambda c: c != ""), " ")


def wrap(query: Column, operator: Column) -> Column:
    return once(query, lambda q: F.when(operator.isNull(), q).when(F.trim(q) == "", "").otherwise(F.concat(operator, F.lit("("), q, F.lit(")"))))


# ---- linting (F1, F2, F3, F21, F23) ----------------------------------------------


def _without(q: Column, part: str) -> Column:
    """The length of a text without a part."""
    return F.length(F.replace(q, F.lit(part), F.lit("")))


def _count(q: Column, char: str) -> Column:
    return F.length(q) - _without(q, char)


def known_field(prefix: Column) -> Column:
    low = F.lower(prefix)
    known = sorted({f.lower() for f in vocab.FIELDS} | {"^author", "^"})
    exact = [f for f in vocab.FIELDS if not f.startswith("^")]
    return F.when(low.startswith("^"), F.substring(low, 2, 1000).isin(exact)).otherwise(low.isin(known))


def lint(query: Column) -> Column:
    """Errors of a query in the order of the checks; an empty array means valid (F1)."""
    return once(F.btrim(F.coalesce(query, F.lit("")), F.lit(" \t\n\x0b\f\r")), _lint)


def _lint(q: Column) -> Column:
    """``lint`` of a query without blanks around it."""
    prefixes = F.regexp_extract_all(q, F.lit("(?i)" + FIELD), F.lit(1))
    unknown = F.transform(F.filter(prefixes, lambda p: ~known_field(p)), lambda p: F.concat(F.lit("Unknown field prefix: "), p))
    ranges = F.regexp_extract_all(q, F.lit(r"(?i)pubdate:\s*\[([^\]]+)\]"), F.lit(1))

    def wrong(r: Column) -> Column:
        up = F.upper(r)
        bad = F.concat(F.lit("Invalid pubdate range syntax: ["), r, F.lit("] (missing 'TO')"))
        many = F.concat(F.lit("Invalid pubdate range: ["), r, F.lit("]"))
        return F.when(~F.contains(up, F.lit(" TO ")), bad).when(_without(up, " TO ") != F.length(up) - 4, many)

    first = issues(
        (_count(q, '"') % 2 != 0, "Unbalanced quotes"),
        (_without(q, "(") != _without(q, ")"), "Unbalanced parentheses"),
        (_without(q, "[") != _without(q, "]"), "Unbalanced brackets"),
    )
    last = issues(
        (q.rlike(r"(?i)^\s*(AND|OR)\s+"), "Query cannot start with AND/OR"),
        (q.rlike(rf"(?i)\s+{_BOOLEAN}\s*$"), "Query cannot end with boolean operator"),
        (q.rlike(rf"(?i)\b{_BOOLEAN}\s+{_BOOLEAN}\b"), "Consecutive boolean operators"),
    )
    found = F.concat(first, unknown, F.filter(F.transform(ranges, wrong), lambda x: x.isNotNull()), last)
    return F.when(q == "", strings(["Empty query"])).otherwise(found)


def nl_issues(nl: Column) -> Column:
    """Signs of the query language in natural text, and its length."""
    names = {m: "(?:database|collection)" if m == "collection" else m for m in vocab.NL_MARKS}
    marks = issues(*[(nl.rlike(rf"(?i)\b{n}:"), f"contains '{m}:'") for m, n in names.items()])
    # Most texts have none of the marks; that is seen sooner than by looking for each.
    marked = F.contains(nl, F.lit(":")) & nl.rlike(rf"(?i)\b(?:{'|'.join(names.values())}):")
    others = issues(
        (nl.rlike(r"(?i)\[[^\]]+\s+TO\s+[^\]]+\]"), "contains range syntax [X TO Y]"),
        (nl.rlike(r"(?i)\^[a-z]"), "contains ^ prefix (first author syntax)"),
        (F.length(nl) < 5, "too short (< 5 chars)"),
        (F.length(nl) > 300, "too long (> 300 chars)"),
        (_count(nl, '"') > 6, "too many quotes"),
    )
    return F.concat(F.when(marked, marks).otherwise(F.expr("cast(array() as array<string>)")), others)


def enum_values(query: Column, field: str) -> Column:
    """All values that a query gives a closed field: bare, quoted, or in an OR list."""
    pattern = rf'(?i)\b{field}:\s*("[^"]+"|\([^)]+\)|[^\s()]+)'

    def one(v: Column) -> Column:
        inner = F.split(F.regexp_replace(v, r"^\(|\)$", ""), r"(?i)\s+OR\s+")
        parts = F.transform(inner, lambda w: F.regexp_replace(F.trim(w), r'^"+|"+$', ""))
        listed = F.filter(parts, lambda w: w != "")
        # Only a whole phrase was taken with both quotes; a bare value may hold stray ones.
        return F.when(v.startswith("("), listed).when(v.rlike(r'\A"[^"]+"\z'), F.array(F.substr(v, F.lit(2), F.length(v) - 2))).otherwise(F.array(v))

    def found(q: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), one))

    # Most queries don't name the field; that is seen sooner than by the pattern.
    return once(query, lambda q: F.when(q.isNull() | F.contains(F.lower(q), F.lit(f"{field}:")), found(q)).otherwise(F.expr("cast(array() as array<string>)")))


def wrong_values(query: Column, field: str) -> Column:
    """Values of a closed field that it doesn't have."""
    allowed = sorted({v.lower() for v in vocab.ENUMS[field]})
    return F.filter(enum_values(query, field), lambda v: ~F.lower(v).isin(allowed))


GLUED = [
    f"{op}{f}:"
    for op, fields in (("citations", ("abs", "author", "title")), ("references", ("abs", "author", "title")), ("trending", ("abs",)), ("useful", ("abs",)), ("similar", ("abs",)), ("reviews", ("abs",)))
    for f in fields
]


def syntax_issues(query: Column) -> Column:
    """Unbalanced parentheses and operators glued to a field."""
    return issues((_count(query, "(") != _count(query, ")"), "Unbalanced parentheses"), *[(query.rlike(rf"(?i)\b{g}"), f"Malformed operator: {g}") for g in GLUED])


def forbidden_found(query: Column, forbidden: Column) -> Column:
    """Those of the forbidden substrings that a query has, whatever their case."""
    return F.filter(forbidden, lambda p: F.contains(F.lower(query), F.lower(p)))


def is_query(text: Column) -> Column:
    """Whether a text is a query already."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(m)) for m in vocab.QUERY_MARKS])


# ---- taking apart (X2, X3, X4) ---------------------------------------------------


def values_of(query: Column, field: str, pattern: str = "[a-z_]+") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(f"{field}:({pattern})"), F.lit(1))))


def operators_in(query: Column) -> Column:
    """The intent operators that a query calls, sorted."""
    return F.filter(strings(vocab.OPERATORS), lambda op: F.contains(F.lower(query), F.concat(op, F.lit("("))))


def features(query: Column) -> Column:
    """What retrieval compares of a query, as a struct."""
    low = F.lower(query)
    ops = operators_in(query)
    groups = F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(r"bibgroup:([a-zA-Z0-9_/-]+)"), F.lit(1))))
    return F.struct(
        F.contains(low, F.lit("author:")).alias("has_author"),
        (F.contains(low, F.lit("year:")) | F.contains(low, F.lit("pubdate:"))).alias("has_year"),
        F.get(ops, F.lit(0)).alias("operator"),
        ops.alias("operators"),
        values_of(query, "doctype").alias("doctypes"),
        values_of(query, "property").alias("properties"),
        groups.alias("bibgroups"),
        values_of(query, "(?:database|collection)", "[a-z]+").alias("collections"),
    )


def field_values(query: Column) -> Column:
    """``field, value`` of each ``field:value`` in order; a value is what stands in quotes or
    parentheses, a bracketed range, or all up to the next blank (X3)."""
    pattern = r'(\w+):(?:"([^"]+)"|(\([^)]+\))|(\[[^\]]+\])|(\S+))'
    names, *parts = (F.regexp_extract_all(query, F.lit(pattern), F.lit(i)) for i in range(1, 6))
    zipped = F.arrays_zip(names.alias("f"), *[p.alias(f"v{i}") for i, p in enumerate(parts)])
    bare = lambda x: F.regexp_replace(F.concat(*[x[f"v{i}"] for i in range(4)]), "^[()\"']+|[()\"']+$", "")
    return F.transform(zipped, lambda x: F.struct(F.lower(x["f"]).alias("field"), bare(x).alias("value")))


_CALLS = "|".join([*vocab.CALLS, "pos"])


def calls(query: Column) -> Column:
    """Operator calls in order, with repeats."""
    return F.regexp_extract_all(F.lower(query), F.lit(rf"\b({_CALLS})\s*\("), F.lit(1))


def canonicalize(query: Column) -> Column:
    """One blank between parts and before a parenthesis, none inside it or after a field or an
    operator, curly quotes straight (X7; G1 as it was meant)."""
    x = F.trim(F.regexp_replace(F.translate(query, "“”‘’", "\"\"''"), " +", " "))
    x = F.regexp_replace(F.regexp_replace(x, r"\(\s+", "("), r"\s+\)", ")")
    # What stands before a parenthesis is looked at where there is one, not sought in the whole text.
    x = F.regexp_replace(F.regexp_replace(x, r"\((?<=\S\()(?!\()", " ("), r": \((?<=\w: \()", ":(")
    return F.rtrim(F.regexp_replace(x, rf" \((?<=(?:{_CALLS}) \()", "("))


def unfielded(query: Column) -> Column:
    """Whether a query names no field."""
    fields = "author abs abstract title pubdate year bibstem object keyword doi arXiv orcid aff inst citation_count read_count property database doctype full body bibcode identifier bibgroup arxiv_class"
    return ~query.rlike(rf"(?i)\b({'|'.join(fields.split())}):")


def semantic_match(expected: Column, actual: Column) -> Column:
    """Whether at least half of the expected fields with values and calls occur; true if there are none."""

    def parts(q: Column) -> Column:
        low = F.lower(q)
        named = F.regexp_extract_all(low, F.lit(r'\w+:(?:"[^"]+"|\S+)'), F.lit(0))
        values = F.transform(named, lambda m: F.regexp_replace(m, r'\A(\w+:)"([^"]+)"\z', "$1$2"))
        ops = F.transform(F.regexp_extract_all(low, F.lit("(" + "|".join(vocab.CALLS) + r")\s*\("), F.lit(1)), lambda o: F.concat(F.lit("op:"), o))
        return F.array_distinct(F.concat(values, ops))

    return once(parts(expected), lambda want: F.when(F.size(want) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(want, parts(actual))) >= 0.5 * F.size(want)))


# ---- categories (F13) and repair that needs no loop (R1, R5) ------------------------


def categorize(query: Column) -> Column:
    """The first category whose mark a query has."""
    low = F.lower(query)
    out = None
    for name, mark in (
        ("citations", r"\bcitations\("), ("references", r"\breferences\("), ("operator", r"\b(trending|useful|similar|reviews|topn)\("),
        ("first_author", r"author:\s*\"?\^"), ("author", r"\bauthor:"), ("bibgroup", r"\bbibgroup:"), ("object", r"\bobject:"),
        ("affiliation", r"\b(aff|inst):"), ("property", r"\bproperty:"), ("doctype", r"\bdoctype:"), ("date", r"\b(pubdate|year):"),
        ("content", r"\b(abs|title|full|body|keyword):"),
    ):
        out = F.when(low.rlike(mark), name) if out is None else out.when(low.rlike(mark), name)
    return out.otherwise("unfielded")


_AFTER_CALL = "author|abs|title|pubdate|bibstem|object|keyword|doctype|property|database|bibgroup|aff|full|identifier"


def repair_calls(query: Column) -> Column:
    """``citationsauthor:x`` becomes ``citations(author:x)``."""
    x = query
    for op in vocab.CALLS:
        x = F.regexp_replace(x, rf"(?i)\b{op}(({_AFTER_CALL}):)", f"{op}($1")
    return F.concat(x, F.repeat(F.lit(")"), F.greatest(F.lit(0), _count(x, "(") - _count(x, ")"))))


def add_article(query: Column) -> Column:
    """``doctype:article`` where a query names no type."""
    return F.when(F.contains(F.lower(query), F.lit("doctype:")), query).otherwise(F.concat(query, F.lit(" doctype:article")))
