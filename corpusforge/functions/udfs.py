"""Functions with loops over a text, as Arrow-batched pandas UDFs.

Everything here scans a string in a way that built-in expressions can't: repeated
removal, callbacks on matches, edit distances. ``register`` gives them SQL names.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from functools import cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import vocab

INTENT = (
    "raw_user_text string, authors array<string>, free_text_terms array<string>, or_terms array<string>, year_from int, year_to int, "
    "property array<string>, doctype array<string>, bibgroup array<string>, collection array<string>, operator string, confidence map<string,double>"
)


def squeeze(text: str) -> str:
    return " ".join(text.split())


# ---- clauses of a query, and what becomes of them (R2 to R4) ----------------


@cache
def _clause(fields: tuple[str, ...], flags: int = 0) -> re.Pattern:
    """A clause of one of the fields: with a list in parentheses, a quoted or a bare value."""
    return re.compile(rf'\b(?P<field>{"|".join(fields)}):(?:\s*(?:\((?P<listed>[^)]+)\)|"(?P<quoted>[^"]*)")|(?P<bare>[^\s()"]+))', flags)


@cache
def _allowed(field: str) -> frozenset[str]:
    return frozenset(v.lower() for v in vocab.ENUMS[field])


def _only_allowed(m: re.Match) -> str:
    """The clause of a closed field with the values it may have."""
    field = m["field"]
    good = _allowed(field.lower())
    if m["listed"] is None:
        return m[0] if (m["quoted"] if m["bare"] is None else m["bare"]).lower() in good else ""
    kept = [v for v in map(str.strip, re.split(r"\s+OR\s+", m["listed"], flags=re.I)) if v.strip('"').lower() in good]
    values = " OR ".join(kept)
    return f"{field.lower()}:" + (f"({values})" if len(kept) > 1 else values) if kept else ""


def keep_allowed(query: str, *fields: str) -> str:
    """``query`` without values that are not allowed, in the fields given or all closed ones (R2)."""
    return _clause(fields or tuple(vocab.ENUMS), re.I).sub(_only_allowed, query)


_TOKEN = re.compile(r'(?P<open>\()|(?P<close>\))|(?P<gap>\s+)|(?P<boolean>(?:AND|OR|NOT)(?![\w:]))|(?P<other>[^\s()]+)', re.I)
_CALL_BEFORE = re.compile(r"(?:" + "|".join(vocab.CALLS) + r")$", re.I)
_ANY_BOOLEAN = re.compile(r"\b(?:AND|OR|NOT)\b", re.I)


class _Level:
    """What stands at one depth of parentheses: pieces, each with its kind."""

    def __init__(self, called: bool = False):
        self.pieces: list[tuple[str, str]] = []
        self.called, self.nested = called, False

    def add(self, kind: str, text: str) -> None:
        if kind == "gap":
            if not self.pieces or self.pieces[-1][0] == "gap":
                return
            text = " "
        # Of two booleans the second counts, but NOT after AND or OR belongs to what follows.
        while kind == "boolean" and self._last() and self._last()[0] == "boolean" and (text.upper() != "NOT" or self._last()[1].upper() == "NOT"):
            self._drop_last()
        self.pieces.append((kind, text))

    def _last(self) -> tuple[str, str] | None:
        return next((x for x in reversed(self.pieces) if x[0] != "gap"), None)

    def _drop_last(self) -> None:
        i = max(i for i, x in enumerate(self.pieces) if x[0] != "gap")
        del self.pieces[i:]

    def settled(self, whole: bool) -> str:
        """The pieces as text, without booleans that have nothing on one side."""
        while self._last() and self._last()[0] == "boolean":
            self._drop_last()
        rest = [x for x in self.pieces]
        first = True
        while rest and (rest[0][0] == "gap" or rest[0][0] == "boolean" and (rest[0][1].upper() != "NOT" or first and whole)):
            first = first and rest[0][0] == "gap"
            rest.pop(0)
        return "".join(t for _, t in rest).strip()


def _folded(query: str, close: bool) -> str:
    """The query with sound parentheses and booleans; parentheses left open are closed, or go."""
    levels = [_Level()]

    def end() -> None:
        level = levels.pop()
        text, outer = level.settled(False), levels[-1]
        if not text:
            return
        if level.called or level.nested or _ANY_BOOLEAN.search(text):
            text = f"({text})"
            outer.nested = True
        elif text:
            outer.nested = True
        outer.add("other", text)

    for m in _TOKEN.finditer(query):
        if m.lastgroup == "open":
            before = levels[-1].pieces[-1] if levels[-1].pieces else ("", "")
            levels.append(_Level(before[0] == "other" and bool(_CALL_BEFORE.search(before[1]))))
        elif m.lastgroup != "close":
            levels[-1].add(m.lastgroup, m[0])
        elif len(levels) > 1:
            end()
    while len(levels) > 1:
        if close:
            end()
        else:
            for kind, text in levels.pop().pieces:
                levels[-1].add(kind, text)
    return levels[0].settled(True)


def tidy(query: str) -> str:
    """What removals leave behind goes: empty and needless parentheses, stray and
    doubled booleans, blanks, unmatched parentheses (R3)."""
    return _folded(query, close=False)


# Fields that a call's name is often stuck to.
_STUCK_FIELDS = ("author", "abs", "title", "pubdate", "bibstem", "object", "keyword", "doctype", "property", "database", "bibgroup", "aff", "full", "identifier")
_STUCK = re.compile(rf"\b({'|'.join(vocab.CALLS)})(?=(?:{'|'.join(_STUCK_FIELDS)}):)", re.I)


def constrain(query: str | None) -> str:
    """A query with only allowed values and sound syntax."""
    return _folded(keep_allowed(_STUCK.sub(lambda m: m[1].lower() + "(", query)), close=True) if query else ""


# ---- intent of a request (N1 to N7) ---------------------------------------------------


@cache
def _phrases(op: str) -> tuple[re.Pattern, list[re.Pattern]]:
    """(any of an operator's phrases, each of them)."""
    each = [rf"\b{p}\b" for p in vocab.OPERATOR_PHRASES[op]]
    return re.compile("|".join(each), re.I), [re.compile(p, re.I) for p in each]


@cache
def _any_phrase(flags: int = 0) -> re.Pattern:
    """Any phrase of any operator; phrases with the same first letter are tried only where it stands."""
    each = sorted(p for phrases in vocab.OPERATOR_PHRASES.values() for p in phrases)
    return re.compile(rf"\b(?:{'|'.join(first + '(?:' + '|'.join(p[1:] for p in same) + ')' for first, same in groupby(each, itemgetter(0)))})\b", flags)


def _says_any_phrase(text: str) -> bool:
    # Small letters are compared faster than letters of either case, which differ only beyond ASCII.
    return bool(_any_phrase().search(text.lower()) if text.isascii() else _any_phrase(re.I).search(text))


@cache
def _years() -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p, re.I), kind) for p, kind in vocab.YEAR_PHRASES]


@cache
def _names() -> list[re.Pattern]:
    return [re.compile(p, re.I) for p in vocab.AUTHOR_PHRASES]


@cache
def _synonyms(kind: str) -> list[tuple[str, re.Pattern, str]]:
    table = getattr(vocab, f"{kind.upper()}_SYNONYMS")
    return [(s, re.compile(rf"\b{re.escape(s)}\b"), table[s]) for s in sorted(table, key=len, reverse=True)]


_DIGIT = re.compile(r"\d")


def take_operator(text: str) -> tuple[str | None, str]:
    """(the first operator with a phrase in the text, the text without its phrases)."""
    if not _says_any_phrase(text):
        return None, text
    for op in vocab.OPERATOR_PHRASES:
        one, each = _phrases(op)
        if one.search(text):
            for p in each:
                text = p.sub(" ", text)
            return op, squeeze(text)
    return None, text


def take_years(text: str, this_year: int) -> tuple[int | None, int | None, str]:
    """(first year, last year, rest) by the first year phrase that fits; years before 1800 or far ahead go."""
    lo = hi = None
    for pattern, kind in _years() if _DIGIT.search(text) else ():
        if m := pattern.search(text):
            n = int(m[1])
            lo, hi = {
                "range": lambda: (n, int(m[2])),
                "since": lambda: (n, this_year),
                "after": lambda: (n + 1, this_year),
                "before": lambda: (None, n - 1),
                "until": lambda: (None, n),
                "last_n": lambda: (this_year - n, this_year),
                "exact": lambda: (n, n),
                "decade": lambda: (n, n + 9),
            }[kind]()
            text = pattern.sub(" ", text)
            break
    sane = lambda y: y if y and 1800 <= y <= this_year + 5 else None
    return sane(lo), sane(hi), squeeze(text)


def take_authors(text: str) -> tuple[list[str], str]:
    """(names, rest), the first of names that differ in case only."""
    found: dict[str, str] = {}
    rest = text
    for pattern in _names():
        for m in pattern.finditer(text):
            if m[1].lower() not in vocab.AUTHOR_NOISE and len(m[1]) > 1:
                found.setdefault(m[1].lower(), m[1])
                rest = rest.replace(m[0], " ")
    return list(found.values()), squeeze(rest)


def take_values(text: str, kind: str) -> tuple[list[str], str]:
    """(values of a closed field, rest), longest synonyms first."""
    text, found = text.lower(), set()
    for synonym, pattern, value in _synonyms(kind):
        if synonym in text:
            text, n = pattern.subn(" ", text)
            if n:
                found.add(value)
    return sorted(found), squeeze(text)


_TOPIC_WORD = re.compile(r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\b")
_EITHER = re.compile(r"\b(\S+(?:\s+\S+)*?)\s+or\s+(\S+(?:\s+\S+)*?)\b", re.I)


def _topic(text: str) -> list[str]:
    words = [w for w in _TOPIC_WORD.findall(text.lower()) if w not in vocab.TOPIC_STOPWORDS and len(w) > 1]
    return [" ".join(words)] if words else []


def take_topics(text: str) -> tuple[list[str], list[str]]:
    """(terms, alternatives of the first "x or y")."""
    if m := _EITHER.search(text):
        return _topic(_EITHER.sub(" ", text)), [*_topic(m[1]), *_topic(m[2])]
    return _topic(text), []


def intent(text: str | None, this_year: int) -> dict:
    """The fields of a request in natural language (N7). A text that is a query already
    keeps only its text."""
    out: dict = {k: [] for k in ("authors", "free_text_terms", "or_terms", "property", "doctype", "bibgroup", "collection")}
    out |= {"raw_user_text": text, "year_from": None, "year_to": None, "operator": None, "confidence": {}}
    if not text or not text.strip():
        return out
    out["raw_user_text"] = rest = text.strip()
    low = rest.lower()
    if any(m in low for m in vocab.QUERY_MARKS):
        return out | {"confidence": {"ads_passthrough": 1.0}}
    out["operator"], rest = take_operator(rest)
    out["year_from"], out["year_to"], rest = take_years(rest, this_year)
    out["authors"], rest = take_authors(rest)
    for kind in ("property", "doctype", "bibgroup", "collection"):
        out[kind], rest = take_values(rest, kind)
    out["free_text_terms"], out["or_terms"] = take_topics(rest)
    sure = {
        "operator": (out["operator"], 0.95), "year": (out["year_from"] or out["year_to"], 0.9), "authors": (out["authors"], 0.85),
        "property": (out["property"], 0.9), "doctype": (out["doctype"], 0.9), "bibgroup": (out["bibgroup"], 0.9),
        "database": (out["collection"], 0.9), "topics": (out["free_text_terms"], 0.7), "or_topics": (out["or_terms"], 0.85),
    }
    out["confidence"] = {k: c for k, (v, c) in sure.items() if v}
    return out


# ---- similarity and characters (X16, X17, X27, X11) -------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = mask = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - bin(row).count("1")


def indel_similarity(a: str | None, b: str | None) -> float:
    """1 less the share of letters to insert and delete; 1 for two empty texts."""
    a, b = a or "", b or ""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def strip_marks(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:[^>]*)?>", re.S)


_MARKUP = re.compile(rf"(?P<tag>{_TAG.pattern})|(?P<entity>&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);)|(?P<blank>[ \t]+)", re.S)


def clean_with_map(text: str, collapse: bool = True) -> tuple[str, list[int]]:
    """(clean text, for each of its characters the place in ``text`` that it comes from).

    Tags go, entities are decoded, runs of blanks become one, the ends are trimmed; the
    map follows all of these. Without ``collapse`` blanks stay as they are."""
    pieces: list[str] = []
    places: list[int] = []
    blank, at = False, 0  # whether the text so far ends with a blank

    def put(piece: str, where) -> None:
        nonlocal blank
        if piece:
            pieces.append(piece)
            places.extend(where)
            blank = piece[-1] == " "

    for m in _MARKUP.finditer(text):
        put(text[at : m.start()], range(at, m.start()))
        at = m.end()
        if m["blank"]:
            if not collapse:
                put(m[0], range(m.start(), at))
            elif not blank:
                put(" ", (m.start(),))
        elif m["entity"]:
            for c in html.unescape(m[0]):
                if not (collapse and c in " \t" and blank):
                    put(" " if collapse and c in " \t" else c, (m.start(),))
    put(text[at:], range(at, len(text)))
    joined = "".join(pieces)
    if not collapse:
        return joined, places
    lead = len(joined) - len(joined.lstrip())
    kept = joined.strip()
    return kept, places[lead : lead + len(kept)]


def remap_spans(text: str, spans: list[dict], parity: bool = False) -> tuple[str, list[dict]]:
    """Spans of a marked-up text moved to its clean text; those that vanish go (X12). With ``parity`` places count blanks
    that the clean text has lost, as a map made before cleaning does (G9)."""
    clean, places = clean_with_map(text)
    if parity:
        places = clean_with_map(text, collapse=False)[1]
    out = []
    for s in spans or []:
        a, b = bisect.bisect_left(places, s["start"]), bisect.bisect_left(places, s["end"])
        if a < b:
            out.append({**s, "surface": clean[a:b], "start": a, "end": b})
    return clean, out


def register(spark: SparkSession, this_year: int = 2026) -> dict:
    """The UDFs of this module by name, also registered for SQL."""

    def text_udf(f):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else f(v))

        return F.pandas_udf(run, "string")

    def pair(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def intents(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([intent(v, this_year) for v in s], columns=[c.split()[0] for c in INTENT.split(", ")])

    out = {
        "constrain_query": text_udf(constrain),
        "tidy_query": text_udf(tidy),
        "strip_marks": text_udf(strip_marks),
        "title_case": text_udf(str.title),
        "unescape_html": text_udf(html.unescape),
        "clean_html": text_udf(lambda v: clean_with_map(v)[0]),
        "indel_similarity": F.pandas_udf(pair, "double"),
        "extract_intent": F.pandas_udf(intents, INTENT),
    }
    for name, f in out.items():
        spark.udf.register(name, f)
    return out
