"""Scalar text functions as Column expressions (nothing leaves the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import RETRIEVAL_STOPWORDS


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words longer than one letter that are no stopwords."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), strings(dict.fromkeys(RETRIEVAL_STOPWORDS)))


def squash(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def strip_lower(text: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")


def needs_quotes(value: Column) -> Column:
    return value.rlike(r"[\s,:\-()]")


def quote_if_needed(value: Column) -> Column:
    """Quotes around a value with space or punctuation, inner quotes escaped."""
    return F.when(needs_quotes(value), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)


#: Named entities that are decoded; numeric ones are left to ``udfs.unescape_html``.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Tags removed without a space, entities decoded, blanks collapsed, trimmed (X11)."""
    x = F.regexp_replace(html, r"(?s)</?[A-Za-z][A-Za-z0-9]*(?:[^>]*)?>", "")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")


def url_decode(text: Column) -> Column:
    """Percent-decoding with + as space; null where the text is no valid encoding."""
    return F.try_url_decode(text)


def concept_id(uri: Column) -> Column:
    """The last piece of a URI after / or #."""
    return F.element_at(F.split(F.regexp_replace(uri, r"[/#]+$", ""), r"[/#]"), -1)


def path_id(path: Column) -> Column:
    """Hierarchical id of an array of names."""
    return F.concat_ws("/", F.transform(path, lambda p: F.replace(p, F.lit(" "), F.lit("_"))))


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_diacritics(text: Column) -> Column:
    """Latin-1 letters without their marks (X16; other scripts need ``udfs.strip_marks``)."""
    return F.translate(text, _ACCENTED, _PLAIN)


def swap_hyphen_space(text: Column) -> Column:
    """Blanks for hyphens, or hyphens for blanks where there is no hyphen."""
    return F.when(F.contains(text, F.lit("-")), F.replace(text, F.lit("-"), F.lit(" "))).when(F.contains(text, F.lit(" ")), F.replace(text, F.lit(" "), F.lit("-"))).otherwise(text)


def strip_punctuation(text: Column) -> Column:
    """Letters, digits, hyphens and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s-]", ""), r"(?U)\s+", " "))


# Words that give no letter to an acronym.
ACRONYM_SKIPS = "a an and the of for in on at to by".split()


def acronym(text: Column, min_words: int = 2, max_length: int = 10) -> Column:
    """Initials of the words that count, or null if they are too few or too many."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*ACRONYM_SKIPS))
    letters = F.upper(F.concat_ws("", F.transform(words, lambda w: F.substring(w, 1, 1))))
    return F.when((F.size(words) >= min_words) & (F.length(letters) <= max_length), letters)


def fill_template(template: Column, names: Column, values: Column) -> Column:
    """``{name}`` replaced by its value, slot by slot."""
    slots = F.arrays_zip(names.alias("n"), values.alias("v"))
    return F.aggregate(slots, template, lambda t, s: F.replace(t, F.concat(F.lit("{"), s["n"], F.lit("}")), s["v"]))


def at_word_boundary(text: Column, start: Column, end: Column) -> Column:
    """Whether neither neighbour of ``[start, end)`` is a letter or digit."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    after = F.substring(text, end + 1, F.lit(1))
    word = r"[\p{L}\p{N}]"
    return ~before.rlike(word) & ~after.rlike(word)


def short_md5(*parts: Column, length: int = 12) -> Column:
    """A record id: the first hexadecimal digits of an MD5."""
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, length)


def hash_uniform(*parts: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that the seed and the parts decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def safe_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")
