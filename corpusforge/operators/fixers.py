"""Fixers of a pair's query as ordered rules, all of them Columns.

A rule that rewrites the inside of a clause cuts the query into clauses and what is between them, rewrites
the clauses that it knows and joins the pieces again; what no rule knows stays letter for letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import qlang, vocab

# Words that tell nothing of a title.
TITLE_STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with",
    "by", "from", "and", "or", "is", "are", "was", "were", "be",
    "its", "their", "this", "that", "these", "those", "as", "into",
    "toward", "towards", "during", "using", "based", "between",
    "observations", "analysis", "study", "research", "group",
    "implications", "reanalysis", "simulating", "formation",
    "shifting", "benchmarking", "performance",
)
# Words too general for a search.
GENERAL_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with",
    "by", "from", "and", "or", "is", "are", "was", "were", "be",
    "its", "their", "this", "that", "these", "those", "as", "into",
    "using", "based", "new", "recent", "first", "toward", "towards",
    "between", "among", "within", "about", "around",
    "observations", "properties", "characteristics", "nature",
    "evidence", "detection", "discovery", "search", "finding",
    "study", "studies", "research", "analysis", "data", "results",
    "survey", "model", "modeling", "simulation", "numerical",
    "mapping", "probing", "measuring", "exploring", "investigating",
    "distribution", "spatial", "temporal", "spectral",
    "inhomogeneous", "homogeneous", "structure", "dynamics",
    "blue", "red", "hot", "cold", "large", "small", "high", "low",
    "early", "late", "young", "old", "bright", "faint", "massive",
    "failed", "successful", "nearby", "distant",
    "space", "ray", "rays", "satellite", "system", "systems",
    "origin", "origins", "formation", "evolution",
    "telescope", "spectrograph", "detector", "camera",
)
# Words of the field that are always worth a search.
FIELD_WORDS = (
    "quasar", "pulsar", "magnetar", "supernova", "novae", "nova",
    "exoplanet", "protostar", "neutron", "black", "hole",
    "galaxy", "galaxies", "cluster", "nebula", "planetary",
    "asteroid", "comet", "meteor", "planet", "lunar", "solar",
    "gravitational", "electromagnetic", "radiation", "spectra",
    "photon", "electron", "proton", "neutrino", "cosmic",
    "gamma", "x-ray", "infrared", "ultraviolet", "radio",
    "hubble", "jwst", "spitzer", "chandra", "kepler", "tess",
    "gaia", "alma", "vlt", "hst", "eso", "nasa",
    "cloudy", "simbad", "astrometry", "photometry", "spectroscopy",
)
# Words that hardly tell what a text is about: small ones, those of titles, and of phrases.
SMALL_WORDS = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or")
TITLE_DULL = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "is", "are", "was", "were", "be",
    "its", "their", "this", "that", "these", "those", "as", "into", "observations", "properties", "characteristics", "nature",
    "evidence", "detection", "discovery", "search", "finding", "new", "recent", "first", "toward", "towards", "failed",
    "blue", "red", "large", "small", "high", "low",
)
PHRASE_DULL = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "is", "are", "was", "were", "be",
    "its", "their", "this", "that", "these", "those", "as", "into", "observations", "properties", "characteristics", "nature",
    "evidence", "detection", "discovery", "search", "finding", "new", "recent", "first", "toward", "towards", "failed",
    "blue", "red", "large", "small", "high", "low", "studies", "research", "analysis", "data", "results", "survey", "study",
    "using", "based", "between", "among", "within", "early", "late", "young", "old", "bright", "faint", "massive",
)
# Words of which a title has several.
TITLE_MARKS = ("the", "of", "in", "a", "an", "for", "with", "by", "to")
# Calls whose arguments are mended.
CALLS = ("citations", "trending", "useful", "reviews", "similar", "references")
# Patterns of what is mended: a bare journal, a bare and a bracketed argument, long contents, a surname in a request, initials after it.
BARE_BIBSTEM = r"""bibstem:(?!["'])([a-zA-Z0-9&\.]+)"""
BARE_ARGUMENT = r"""abs:(?!["'])([a-zA-Z0-9_]+)"""
BRACKETED_ARGUMENT = r"abs:\(([^)]+)\)"
LONG_CONTENT = r'abs:\s*(?:\([^)]{50,}\)|"[^"]{50,}")'
SURNAME = r"\bby\s+([A-Z][a-z]+(?:-[A-Z][a-z]+)?)\b(?!\s+[A-Z]\.)"
INITIALS = r'(?:-[A-Za-z]+)?,\s*[A-Z]\.?\s*[A-Z]?\.?"'
# Misspelt fields and what they are.
MISSPELT = {"authors": "author", "abstracts": "abs", "abstract": "abs", "years": "year", "documents": "doctype", "properties": "property", "database": "collection"}
# The category of an unsorted pair by what stands in its query or request, the first that fits.
CATEGORIES = (
    ("operator", r"(?:citations|references|trending|useful|similar|reviews)\(", None),
    ("first_author", r"\^author:", "first author"),
    ("author", "author:", None),
    ("object", "object:", None),
    ("bibgroup", "bibgroup:", None),
    ("collection", "collection:|database:", None),
    ("property", "property:", None),
    ("doctype", "doctype:", None),
    ("publication", "bibstem:", None),
    ("temporal", "year:|pubdate:", None),
    ("affiliation", "aff:|inst:", None),
    ("topic", "abs:|title:", None),
    ("operator", None, "cite|citing|cited"),
    ("bibgroup", None, "hubble|jwst|chandra|spitzer|kepler"),
    ("property", None, "refereed|peer|open access|preprint"),
)
# Phrases that name a field of study, their term and collection.
STUDIES = {"infrared astronomy": ("infrared", "astronomy"), "string theory": ("string", "physics"), "infrared spectroscopy": ("infrared", "astronomy"), "galactic dynamics": ("galactic", "astronomy")}


def rewritten(query: Column, clause: str, change: Callable[[Column], Column]) -> Column:
    """``query`` with each match of ``clause``, from the left and without overlaps, replaced by ``change`` of it."""

    def joined(q: Column) -> Column:
        found = F.transform(F.regexp_extract_all(q, F.lit(f"(?s){clause}"), F.lit(0)), change)
        # Before each match, and after the last: one piece more than there are matches.
        return F.array_join(F.zip_with(F.split(q, f"(?s){clause}"), found, lambda kept, new: F.concat(kept, F.coalesce(new, F.lit("")))), "")

    return qlang.once(query, joined)


def _joined(terms: Column, otherwise: Column) -> Column:
    """``abs:`` with all terms."""
    return F.when(F.size(terms) == 0, otherwise).when(F.size(terms) == 1, F.concat(F.lit("abs:"), terms[0])).otherwise(F.concat(F.lit("abs:("), F.array_join(terms, " AND "), F.lit(")")))


def _best(terms: Column, score: Callable[[Column], Column]) -> Column:
    """Terms with their scores, the highest first, equals in their order."""
    scored = F.transform(terms, lambda t, i: F.struct((-score(t)).alias("s"), i.alias("i"), t.alias("t")))
    return F.array_sort(scored)


def _capitals(t: Column) -> Column:
    return (F.upper(t) == t) & t.rlike("[A-Z]")


def _clause(*fields: str) -> str:
    """A clause of one of the fields: with a list in parentheses, a quoted or a bare value."""
    return rf'\b(?:{"|".join(fields)}):(?:\s*(?:\([^)]+\)|"[^"]*")|[^\s()"]+)'


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _listed(p: Column) -> Column:
    """What a clause has in parentheses; empty if it has none."""
    return F.regexp_extract(p, r"(?s)^\w+:\s*\((.+)\)\z", 1)


def _quoted(p: Column) -> Column:
    return F.regexp_extract(p, r'(?s)^\w+:\s*"(.*)"\z', 1)


def _dullness(word: Column, dull: tuple[str, ...]) -> Column:
    """0: tells what a text is about; 1: may do if nothing else does; 2: only if it must; 3: hardly a word."""
    telling = (F.length(word) > 3) & ~word.rlike(r"^\d+$") & ~F.lower(word).isin(*dull)
    return F.when(F.length(word) <= 2, 3).when(telling, 0).when(F.lower(word).isin(*SMALL_WORDS), 2).otherwise(1)


def allowed_only(query: Column, *fields: str) -> Column:
    """``query`` without values that are not allowed in the closed fields given, or in all of them (R2)."""
    closed = {f: [v.lower() for v in vocab.ENUMS[f]] for f in fields or tuple(vocab.ENUMS)}

    def change(p: Column) -> Column:
        field = F.lower(F.regexp_extract(p, r"^(\w+):", 1))
        good = lambda v: F.coalesce(*[F.when(field == f, F.lower(v).isin(*values)) for f, values in closed.items()], F.lit(False))
        kept = F.filter(F.transform(F.split(_listed(p), r"(?i)\s+OR\s+"), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: good(F.regexp_replace(v, r'^"+|"+$', "")))
        values = F.array_join(kept, " OR ")
        some = F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, F.concat(field, F.lit(":"), values)).otherwise(F.concat(field, F.lit(":("), values, F.lit(")")))
        one = F.when(p.rlike(r'(?s)^\w+:\s*"'), _quoted(p)).otherwise(F.regexp_extract(p, r"(?s)^\w+:(.*)\z", 1))
        return F.when(_listed(p) != "", some).otherwise(F.when(good(one), p).otherwise(""))

    return rewritten(query, "(?i:" + _clause(*closed) + ")", change)


def shorter_phrases(query: Column, max_words: int = 2, most: int = 3) -> Column:
    """Long quoted phrases of a text field as up to ``most`` distinctive terms (R6): the least dull words at whose dullness there are two."""

    def change(p: Column) -> Column:
        words = _words(_quoted(p))
        under = lambda n: F.filter(words, lambda w: _dullness(w, PHRASE_DULL) <= n)
        first = F.slice(F.when(F.size(under(2)) > 0, under(2)).otherwise(words), 1, 1)
        terms = F.when(F.size(under(0)) > 1, F.slice(under(0), 1, most)).when(F.size(under(1)) > 0, F.slice(under(1), 1, most)).otherwise(first)
        field = F.regexp_extract(p, r"^(\w+):", 1)
        joined = F.array_join(terms, " AND ")
        return F.when(F.size(words) <= max_words, p).otherwise(F.concat(field, F.lit(":"), F.when(F.size(terms) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)))

    return rewritten(query, _clause("abs", "title"), change)


def title_conjunctions(query: Column, most: int = 3) -> Column:
    """``abs:(what reads like a title)`` as a conjunction of distinctive terms."""

    def change(p: Column) -> Column:
        inside = _listed(p)
        words = _words(inside)
        marks = F.size(F.filter(words, lambda w: F.lower(w).isin(*TITLE_MARKS)))
        good = F.slice(F.filter(words, lambda w: _dullness(w, TITLE_DULL) == 0), 1, most)
        like_title = (F.size(words) > 5) | ((F.size(words) > 2) & (marks > 1))
        plain = ~inside.rlike(r'(?s)^".*"\z') & ~inside.rlike(r"(?i)\b(?:AND|OR|NOT)\b")
        return F.when(like_title & (F.size(good) >= 2) & plain, F.concat(F.lit("abs:("), F.array_join(good, " AND "), F.lit(")"))).otherwise(p)

    return rewritten(query, _clause("abs"), change)


def quoted_bibstems(query: Column) -> Column:
    return F.regexp_replace(query, BARE_BIBSTEM, 'bibstem:"$1"')


def title_terms(query: Column, most: int = 4) -> Column:
    """Titles in ``abs`` (fifty letters and more, without OR or AND) as their ``most`` most telling words."""

    def score(t: Column) -> Column:
        return F.when(t.rlike("^[A-Z]") & ~_capitals(t), 3).when(_capitals(t) & (F.length(t) >= 2), 3).when(F.length(t) > 7, 2).otherwise(1)

    def change(p: Column) -> Column:
        inside = F.trim(F.regexp_replace(p, r"^abs:\s*", ""))
        inside = F.substring(inside, F.lit(2), F.length(inside) - 2)
        words = F.regexp_extract_all(inside, F.lit(r"\b[A-Za-z0-9_-]+\b"), F.lit(0))
        words = F.filter(words, lambda w: ~F.lower(w).isin(*TITLE_STOPWORDS) & (F.length(w) > 2) & (~w.rlike(r"^\d+$") | (F.length(w) == 4)))
        terms = F.transform(F.slice(_best(words, score), 1, most), lambda s: s["t"])
        return F.when(inside.rlike(r"\b(OR|AND)\b"), p).otherwise(_joined(terms, p))

    return rewritten(query, LONG_CONTENT, change)


def alternatives_joined(query: Column, most: int = 3) -> Column:
    """``abs:(a OR b ...)`` as a conjunction of the most telling of its terms."""

    def score(t: Column) -> Column:
        low, n = F.lower(t), F.length(t)
        general = low.isin(*GENERAL_WORDS)
        out = F.when(low.isin(*FIELD_WORDS), 100).when(t.rlike(r"^(?:[A-Z][a-z]?[_\d]+|[A-Z]{1,2}\d+)$"), 95).when(t.rlike("^[A-Z]") & ~_capitals(t) & (n > 3), 80).when(_capitals(t) & n.between(2, 6), 75)
        return out.when((n > 6) & ~general, 60).when(~general & (n > 2), 40).otherwise(0)

    def change(p: Column) -> Column:
        inside = F.regexp_extract(p, r"(?s)\((.*)\)\z", 1)
        terms = F.transform(F.split(inside, " OR "), lambda t: F.trim(t))
        best = _best(terms, score)
        telling = F.slice(F.filter(best, lambda s: s["s"] <= -40), 1, most)
        some = F.filter(F.slice(best, 1, most), lambda s: F.length(s["t"]) > 2)
        chosen = F.transform(F.when(F.size(telling) < 2, some).otherwise(telling), lambda s: s["t"])
        return F.when(F.contains(inside, F.lit(" OR ")), _joined(chosen, F.concat(F.lit("abs:"), terms[0]))).otherwise(p)

    return rewritten(query, r"abs:\s*\([^)]+\)", change)


def quoted_arguments(query: Column) -> Column:
    """Values of ``abs`` within calls in quotes instead of parentheses or nothing."""
    calls = "|".join(CALLS)
    q = F.when(query.rlike(rf"^(?:{calls})\("), F.regexp_replace(query, BRACKETED_ARGUMENT, 'abs:"$1"')).otherwise(query)
    return rewritten(q, rf"(?:{calls})\([^)]+\)", lambda p: F.regexp_replace(p, BARE_ARGUMENT, 'abs:"$1"'))


def plain_surnames(query: Column, request: Column) -> Column:
    """Initials of authors that the request doesn't give are taken out."""
    named = F.regexp_extract_all(request, F.lit(SURNAME), F.lit(1))

    def without(q: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(r'(?i)(author:\s*"\^?)'), name, F.lit(INITIALS))
        return F.regexp_replace(q, pattern, F.concat(F.lit("$1"), name, F.lit('"')))

    return F.aggregate(F.coalesce(named, F.array().cast("array<string>")), query, without)


def balanced(query: Column) -> Column:
    """A missing quote or parenthesis is put to the end, parentheses too many are taken from it."""
    n = lambda q, c: F.length(q) - F.length(F.replace(q, F.lit(c), F.lit("")))
    q = F.when(n(query, '"') % 2 == 1, F.concat(query, F.lit('"'))).otherwise(query)
    more = n(q, "(") - n(q, ")")
    last = F.length(F.regexp_extract(q, r"\)*\z", 0))
    return F.when(more > 0, F.concat(q, F.repeat(F.lit(")"), more))).when(more < 0, F.substring(q, F.lit(1), F.length(q) - F.least(-more, last))).otherwise(q)


def named_fields(query: Column) -> Column:
    for wrong, right in MISSPELT.items():
        query = F.regexp_replace(query, rf"(?i)\b{wrong}:", f"{right}:")
    return F.regexp_replace(query, "facility:", "abs:")


def studies(query: Column) -> Column:
    """The first known field of study that is sought as a phrase, as a term or keyword of its collection."""
    out = F.when(F.lit(False), query)
    for phrase, (term, collection) in STUDIES.items():
        old = f'abs:"{phrase}"'
        out = out.when(F.contains(query, F.lit(old)), F.replace(query, F.lit(old), F.lit(f'(abs:{term} OR keyword:"{phrase}") collection:{collection}')))
    return out.otherwise(query)


def category_of(query: Column, request: Column, now: Column) -> Column:
    """The category of a pair that is ``unfielded``; any other stays."""
    q, nl, out = F.lower(query), F.lower(request), F.when(F.lit(False), now)
    for name, in_query, in_request in CATEGORIES:
        hit = F.lit(False)
        hit = hit | q.rlike(in_query) if in_query else hit
        hit = hit | nl.rlike(in_request) if in_request else hit
        out = out.when(hit, name)
    return F.when(now == "unfielded", out.otherwise("topic")).otherwise(now)


#: The fixers in their order.
FIXERS: dict[str, Callable[[Column, Column], Column]] = {
    "fields": lambda q, nl: named_fields(q),
    "balance": lambda q, nl: balanced(q),
    "surnames": plain_surnames,
    "titles": lambda q, nl: title_terms(q),
    "alternatives": lambda q, nl: alternatives_joined(q),
    "arguments": lambda q, nl: quoted_arguments(q),
    "bibstems": lambda q, nl: quoted_bibstems(q),
    "studies": lambda q, nl: studies(q),
}


def fix(pairs: DataFrame, which: tuple[str, ...] = tuple(FIXERS), query: str = "ads_query", request: str = "natural_language", category: str = "category") -> DataFrame:
    """``pairs`` with the query and category fixed, and ``fixes``, the names of the fixers that changed something, in
    their order (R9). A null query stays null and has no fixes."""
    x = pairs.withColumn("fixes", F.expr("cast(array() as array<string>)"))
    for name in which:
        x = x.withColumn("_q", FIXERS[name](F.col(query), F.col(request)))
        x = x.withColumn("fixes", F.when(F.col("_q") != F.col(query), F.concat("fixes", F.array(F.lit(name)))).otherwise(F.col("fixes"))).withColumn(query, F.col("_q")).drop("_q")
    x = x.withColumn("_c", category_of(F.col(query), F.col(request), F.col(category)))
    x = x.withColumn("fixes", F.when(F.col("_c") != F.col(category), F.concat("fixes", F.array(F.lit("category")))).otherwise(F.col("fixes")))
    return x.withColumn(category, F.col("_c")).drop("_c")


def changes(fixed: DataFrame) -> DataFrame:
    """``fixer, n``: how many rows each fixer changed."""
    return fixed.select(F.explode("fixes").alias("fixer")).groupBy("fixer").agg(F.count(F.lit(1)).alias("n"))
