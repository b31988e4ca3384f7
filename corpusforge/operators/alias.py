"""Alias expansion of catalog labels (Columns only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import acronym, strip_diacritics, strip_punctuation

MOST = 50
_NONE = "cast(array() as array<string>)"


def norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def is_acronym(x: Column) -> Column:
    """Capitals only, ten at most, hyphens and blanks aside."""
    letters = F.regexp_replace(x, r"[ -]", "")
    return letters.rlike(r"(?U)^\p{L}{1,10}$") & (letters == F.upper(letters))


def variants(x: Column) -> Column:
    """A text and its forms: without accents, hyphens for blanks and back, without punctuation,
    its acronym (X18, X19). Forms that differ only in case are left out, as they
    would not survive the later comparison (G3)."""
    bases = F.array_distinct(F.array(x, strip_diacritics(x)))

    def forms(b: Column) -> Column:
        hyphens = F.when(F.contains(b, F.lit("-")), F.replace(b, F.lit("-"), F.lit(" ")))
        blanks = F.regexp_replace(F.trim(b), r"\s+", "-")
        return F.array(b, hyphens, blanks, strip_punctuation(b), F.when(~is_acronym(b), acronym(b)))

    return F.filter(F.flatten(F.transform(bases, forms)), lambda v: v.isNotNull() & (F.trim(v) != ""))


def expand(label: Column, aliases: Column, most: int = MOST) -> Column:
    """Variants of the label, then each alias with its variants, the first of equal forms, without the
    label, ``most`` at the end (X19)."""
    everything = F.concat(variants(label), F.flatten(F.transform(F.coalesce(aliases, F.expr(_NONE)), variants)))
    known = lambda acc, v: F.exists(acc, lambda w: norm(w) == norm(v)) | (norm(v) == norm(label))
    kept = F.aggregate(everything, F.expr(_NONE), lambda acc, v: F.when(known(acc, v), acc).otherwise(F.concat(acc, F.array(v))))
    return F.slice(kept, 1, most)


def expand_catalog(entries: DataFrame, most: int = MOST) -> DataFrame:
    """Entries with expanded ``aliases`` and the number ``added``."""
    before = F.size(F.coalesce("aliases", F.expr(_NONE)))
    x = entries.withColumn("_n", before).withColumn("aliases", expand(F.col("label"), F.col("aliases"), most))
    return x.withColumn("added", F.size("aliases") - F.col("_n")).drop("_n")
