"""Linking of surfaces to catalog ids: exact, then fuzzy, then by embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.udfs import indel_similarity
from ._stored import beside, store

FUZZY_LEAST, FUZZY_CONFIDENCE = 0.85, 0.8
EMBED_LEAST = 0.75
#: Vectors of a catalog that a task holds at once.
HELD_VECTORS = 20_000


def linking_index(entries: DataFrame) -> DataFrame:
    """``surface_lc, type, canonical_id, ord`` of labels and of non-empty aliases other than the
    label (Z1). ``entries (id, label, aliases, type, ord)``."""
    extra = F.filter(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda a: (F.trim(a) != "") & (a != F.col("label")))
    x = entries.select(F.col("id").alias("canonical_id"), "type", "ord", F.posexplode(F.concat(F.array("label"), extra)).alias("n", "surface"))
    return x.select(F.lower("surface").alias("surface_lc"), "type", "canonical_id", (F.col("ord").cast("long") * (1 << 20) + F.col("n")).alias("ord"))


def link_exact(spans: DataFrame, index: DataFrame) -> DataFrame:
    """The first entry with the span's surface and type (J5): ``span_id, canonical_id, confidence, match_type``."""
    first = index.groupBy("surface_lc", "type").agg(F.min_by("canonical_id", "ord").alias("canonical_id"))
    x = spans.withColumn("surface_lc", F.lower("surface")).join(first, ["surface_lc", "type"])
    return x.select("span_id", "canonical_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _rarest_pairs(df: DataFrame, c: str, other: str, frequency: DataFrame, least: float) -> DataFrame:
    """``type, c, nc, no, g``: for each length ``no`` that a match of the surface can have, its rarest letter pairs, so many
    that one of them must be shared. Two surfaces of a similarity share a sequence of ``k`` letters at least;
    each letter of ``c`` outside it spoils two pairs of ``c`` at most, each of the other's one."""
    text = F.concat(F.lit("^"), F.col(c), F.lit("$"))
    x = df.withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))))
    x = x.join(beside(frequency), "g", "left").groupBy("type", c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("gs"))
    n = F.length(c)
    x = x.withColumn("nc", n).withColumn("no", F.explode(F.sequence(F.ceil(n * (least / (2 - least)) - 1e-6).cast("int"), F.floor(n * ((2 - least) / least) + 1e-6).cast("int"))))
    k = F.ceil(least * (F.col("nc") + F.col("no")) / 2 - 1e-6)
    x = x.where(k <= F.least("nc", "no")).withColumn("spoilt", (2 * F.col("nc") + F.col("no") - 3 * k).cast("int"))
    x = x.select("type", c, "nc", "no", F.explode(F.slice("gs", F.lit(1), F.col("spoilt") + 1)).alias("p"))
    return x.select("type", c, F.col("nc").alias(f"n{c}"), F.col("no").alias(f"n{other}"), F.col("p.g").alias("g"))


def link_fuzzy(spans: DataFrame, index: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """The entry of the span's type with the highest similarity of at least ``least``, ties to the first.

    Only distinct surfaces are compared, and of those only ones that share, for their two lengths, one of each
    other's rarest letter pairs: as many as the letters that may differ can spoil, and one more. So
    keys are of one type, two lengths and a pair that is rare in the catalog, and no match is lost."""
    s = spans.select(F.lower("surface").alias("a"), "type").distinct()
    t = index.groupBy("surface_lc", "type").agg(F.min_by("canonical_id", "ord").alias("canonical_id"), F.min("ord").alias("ord")).withColumnRenamed("surface_lc", "b")
    text = F.concat(F.lit("^"), F.col("b"), F.lit("$"))
    letters = t.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))).alias("g"))
    frequency = store(letters.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "letter-pairs")
    pairs = _rarest_pairs(s, "a", "b", frequency, least).join(_rarest_pairs(t.select("b", "type"), "b", "a", frequency, least), ["type", "na", "nb", "g"])
    scored = pairs.select("a", "b", "type").distinct().withColumn("score", F.round(_ratio("a", "b"), 9)).where(F.col("score") >= least)
    best = scored.join(t, ["b", "type"]).groupBy("a", "type").agg(F.max_by("canonical_id", F.struct("score", -F.col("ord"))).alias("canonical_id"))
    x = spans.withColumn("a", F.lower("surface")).join(best, ["a", "type"])
    return x.select("span_id", "canonical_id", F.lit(FUZZY_CONFIDENCE).alias("confidence"), F.lit("fuzzy").alias("match_type"))


def link_embedding(spans: DataFrame, entries: DataFrame, least: float = EMBED_LEAST, block: int = HELD_VECTORS) -> DataFrame:
    """The entry of the span's type with the highest cosine of at least ``least``, ties to the first.

    ``spans (span_id, type, embedding)``, ``entries (canonical_id, type, embedding, ord)``. The catalog is the
    stated query set: tasks hold it in blocks of ``block`` unit vectors, by type, and multiply batches of
    spans with them; each block leaves one row per span. Cosines count to six places. Null vectors, those without a direction, and
    entries of another length than the span's, don't link."""
    n = entries.count()
    blocks, out = max(1, -(-n // block)), None
    kind = {"span_id": spans.schema["span_id"], "canonical_id": entries.schema["canonical_id"]}
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kind.items()) + ", score double, ord long"
    x = spans.select("span_id", F.col("type").cast("string"), F.col("embedding").cast("array<double>"))
    for b in range(blocks):
        part = entries.where(F.pmod(F.xxhash64("canonical_id"), F.lit(blocks)) == b).select("canonical_id", F.col("type").cast("string"), F.col("embedding").cast("array<double>"), F.col("ord").cast("long"))
        best = x.mapInArrow(_nearest([tuple(r) for r in part.collect()], least), kinds)
        best = best if blocks == 1 else store(best, "nearest")  # so that one block's vectors are held at a time
        out = best if out is None else out.unionByName(best)
    best = out.groupBy("span_id").agg(F.max_by(F.struct("canonical_id", "score"), F.struct("score", -F.col("ord"))).alias("r"))
    return best.select("span_id", "r.canonical_id", F.col("r.score").alias("confidence"), F.lit("embedding").alias("match_type"))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows with the length one; those without a direction are not numbers."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _nearest(entries: list[tuple], least: float):
    groups: dict[tuple, list[tuple]] = {}
    for e in entries:
        if e[2] is not None and None not in e[2]:
            groups.setdefault((e[1], len(e[2])), []).append(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By order, so that the first of equals is the first.
        held = {g: sorted(es, key=lambda e: e[3]) for g, es in groups.items() if g[1]}
        units = {g: _units(np.array([e[2] for e in es])) for g, es in held.items()}
        for batch in batches:
            vectors, of = batch.column(2), {}
            for i, (kind, v) in enumerate(zip(batch.column(1).to_pylist(), vectors.to_pylist(), strict=True)):
                if v is not None and (kind, len(v)) in held and None not in v:
                    of.setdefault((kind, len(v)), []).append((i, v))
            rows, ids, scores, orders = [], [], [], []
            for g, mine in of.items():
                step = max(1, 4_000_000 // len(held[g]))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    score = np.floor(_units(np.array([v for _, v in some])) @ units[g].T * 1e6 + 0.5) / 1e6
                    best = np.where(np.isnan(score), -2.0, score)
                    k = best.argmax(1)
                    for (i, _), j, s in zip(some, k.tolist(), best[np.arange(len(some)), k].tolist(), strict=True):
                        if s >= least:
                            rows.append(i)
                            ids.append(held[g][j][0])
                            scores.append(s)
                            orders.append(held[g][j][3])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids), pa.array(scores), pa.array(orders, pa.int64())], names=["span_id", "canonical_id", "score", "ord"])

    return run


def link_cascade(spans: DataFrame, index: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """All spans with their link by the first stage that finds one (J8); unlinked spans have nulls.

    With ``vectors (canonical_id, type, embedding, ord)`` of the catalog, and ``embedding`` in
    ``spans``, what neither the exact nor the fuzzy stage links is linked by embedding."""
    exact = link_exact(spans, index)
    rest = spans.join(exact.select("span_id"), "span_id", "left_anti")
    fuzzy = link_fuzzy(rest, index)
    found = exact.unionByName(fuzzy)
    if vectors is not None:
        rest = rest.join(fuzzy.select("span_id"), "span_id", "left_anti")
        found = found.unionByName(link_embedding(rest.select("span_id", "type", "embedding"), vectors.select("canonical_id", "type", "embedding", "ord")))
    return spans.select("span_id").join(found, "span_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit("unlinked")))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    x = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r"))
    return x.select("r.*")


def argmax_first(df: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """The row with the highest score, the first of equals."""
    w = Window.partitionBy(by).orderBy(F.desc(score), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
