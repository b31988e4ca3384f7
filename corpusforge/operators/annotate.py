"""Dictionary annotation of texts and the checks of character spans."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs

#: Surfaces that a task holds at once, at about 600 bytes each.
HELD_SURFACES = 1_000_000
#: Texts whose spans a task holds at once.
HELD_TEXTS = 64
SPAN = "struct<surface:string,start:int,end:int,type:string,canonical_id:string>"


def keyword_index(entries: DataFrame, min_length: int = 4) -> DataFrame:
    """``surface_lc, surface, canonical_id, type, ord`` of labels and aliases, the first entry of a
    surface (Z2). ``entries (id, label, aliases, type, ord)``."""
    x = entries.select("id", "type", "ord", F.posexplode(F.concat(F.array("label"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("n", "surface"))
    x = x.withColumn("surface", F.trim("surface")).where(F.length("surface") >= min_length).withColumn("surface_lc", F.lower("surface"))
    first = F.min_by(F.struct("surface", F.col("id").alias("canonical_id"), "type", "ord"), F.struct("ord", "n"))
    return x.groupBy("surface_lc").agg(first.alias("r")).select("surface_lc", "r.*")


_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[\W_]", re.S)
_HIT = "doc_id long, surface_lc string, start int, len int, type string, canonical_id string, ord long, surface string"
_SPANS = f"doc_id long, spans array<{SPAN}>"


def lowered(text: str) -> str:
    """``text`` in lower case, letter for letter, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Dictionary:
    """Surfaces as a trie over tokens (runs of letters and digits, and single other letters), from the first run in each;
    surfaces without such a run apart. A step of the trie is a number made of node and token, so that
    a million surfaces are two tables of numbers, and a text is read once whatever their number."""

    def __init__(self, rows: list[tuple]):
        self.token: dict[str, int] = {}
        self.step: dict[int, int] = {}
        #: (surface in lower case, letters before its first run, type, canonical_id, ord) by the node where it ends
        self.ends: dict[int, list[tuple]] = {}
        self.signs: list[tuple] = []
        for surface, kind, ident, order in rows:
            m = _WORD.search(surface)
            if not m:
                self.signs.append((surface, 0, kind, ident, order))
                continue
            node = 0
            for t in _TOKEN.findall(surface, m.start()):
                step = node << 32 | self.token.setdefault(t, len(self.token))
                node = self.step.setdefault(step, len(self.step) + 1)
            self.ends.setdefault(node, []).append((surface, m.start(), kind, ident, order))

    def hits(self, text: str) -> list[tuple]:
        """(surface in lower case, start, end, type, canonical_id, ord) wherever one stands at word borders."""
        low, out = lowered(text), []
        places = [m.start() for m in _TOKEN.finditer(low)]
        numbers = [self.token.get(t, -1) for t in _TOKEN.findall(low)]
        for i, first in enumerate(numbers):
            node = self.step.get(first) if first >= 0 else None
            if node is None:
                continue
            j = i
            while node is not None:
                for surface, before, *rest in self.ends.get(node, ()):
                    a = places[i] - before
                    if a >= 0 and low.startswith(surface, a):
                        out.append((surface, a, a + len(surface), *rest))
                j += 1
                node = self.step.get(node << 32 | numbers[j]) if j < len(numbers) and numbers[j] >= 0 else None
        for surface, _, *rest in self.signs:
            a = low.find(surface)
            while a >= 0:
                out.append((surface, a, a + len(surface), *rest))
                a = low.find(surface, a + 1)
        return [h for h in out if not (h[1] and text[h[1] - 1].isalnum()) and not (h[2] < len(text) and text[h[2]].isalnum())]

    def spans(self, text: str) -> list[dict]:
        """The longest first, then by order and place; none overlaps one taken before it."""
        taken: list[tuple[int, int]] = []  # by place
        out = []
        for _, a, b, kind, ident, _ in sorted(self.hits(text), key=lambda h: (h[1] - h[2], h[5], h[1])):
            i = bisect.bisect(taken, (a, b))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                continue
            taken.insert(i, (a, b))
            out.append({"surface": text[a:b], "start": a, "end": b, "type": kind, "canonical_id": ident})
        return sorted(out, key=lambda s: s["start"])


def _rows(index: DataFrame) -> list[tuple] | None:
    """The index, if it is small enough for every task to hold."""
    some = index.where("surface_lc <> ''").select("surface_lc", "type", "canonical_id", "ord").limit(HELD_SURFACES + 1).collect()
    return [tuple(r) for r in some] if len(some) <= HELD_SURFACES else None


def _parts(index: DataFrame) -> list[list[tuple]]:
    """An index too large for a task, cut by a hash of the surface into parts that fit."""
    parts = -(-index.count() // (HELD_SURFACES // 2))
    return [_rows(index.where(F.pmod(F.xxhash64("surface_lc"), F.lit(parts)) == k)) or [] for k in range(parts)]


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: what is found in a text takes far more memory than the text, so a task holds that of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_TEXTS):
            yield batch.slice(at, HELD_TEXTS)


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, surface_lc, start, len, type, canonical_id, ord, surface`` of every place where an indexed surface stands at
    word borders.

    Texts are read once for each million surfaces, which every task holds; nothing is shuffled and
    no text is copied. Null texts have no place."""
    rows, out = _rows(index), None
    for part in [rows] if rows is not None else _parts(index):

        def find(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            known = Dictionary(part)
            for batch in _some_rows(batches):
                found = [(doc, surface, a, b - a, kind, ident, order, text[a:b]) for doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) if text for surface, a, b, kind, ident, order in known.hits(text)]
                if found:
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _HIT.split(", ")])

        hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _HIT)
        out = hits if out is None else out.unionByName(hits)
    return out


def annotate(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs (doc_id, text)``: the longest surfaces first, then by index
    order and place; a span never overlaps one taken before it (J9, W9). One pass over the texts; an
    index beyond a million surfaces takes one for each so many and gathers a text's own matches."""
    rows = _rows(index)
    if rows is None:
        return _gathered(docs, candidates(docs, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(rows)
        kind = pa.list_(pa.struct([("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("canonical_id", pa.string())]))
        for batch in _some_rows(batches):
            spans = [known.spans(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SPANS)


def _gathered(docs: DataFrame, hits: DataFrame) -> DataFrame:
    span = F.struct((-F.col("len")).alias("l"), "ord", "start", (F.col("start") + F.col("len")).alias("end"), "surface", "type", "canonical_id")
    x = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(span)).alias("c"))
    none = F.expr("filter(c, x -> false)")
    free = lambda acc, s: ~F.exists(acc, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    taken = F.aggregate("c", none, lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    x = x.select("doc_id", F.transform(taken, lambda s: F.struct(s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["canonical_id"].alias("canonical_id"))).alias("spans"))
    return docs.select(F.col("doc_id").cast("long")).join(x, "doc_id", "left").withColumn("spans", F.array_sort(F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")), lambda a, b: a["start"] - b["start"]))


def remapped(docs: DataFrame, parity: bool = False) -> DataFrame:
    """``doc_id, text, spans`` with the markup gone from the texts of ``docs (doc_id, text, spans (start, end, type))`` and the spans moved to
    where they then are, with what stands there as ``surface``; those of which nothing is left go (X12). With ``parity`` places count
    blanks that the clean text has lost (G9). A null text has no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [(None, []) if t is None else udfs.remap_spans(t, s or [], parity) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in moved], pa.string()), pa.array([s for _, s in moved], kind)], names=["doc_id", "text", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    return docs.select("doc_id", "text", spans.alias("spans")).mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<surface:string,start:int,end:int,type:string>>")


def offset_errors(text: Column, spans: Column, context: int = 20) -> Column:
    """Spans whose text isn't their surface, with what stands there and around it."""
    here = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    around = lambda s: F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - context), s["end"] - s["start"] + 2 * context)
    return F.transform(F.filter(spans, lambda s: ~here(s).eqNullSafe(s["surface"])), lambda s: F.struct(s["surface"].alias("surface"), here(s).alias("found"), around(s).alias("context")))


def char_tags(text: Column, spans: Column) -> Column:
    """BIO tags by character; where spans overlap the first one counts (M1)."""
    kind = lambda s: F.when(s["type"] == "entity", "institution").otherwise(s["type"])

    def tag(i: Column) -> Column:
        over = F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
        s = F.get(over, F.lit(0))
        return F.when(F.size(over) == 0, "O").when(s["start"] == i, F.concat(F.lit("B-"), kind(s))).otherwise(F.concat(F.lit("I-"), kind(s)))

    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1), tag)).otherwise(F.expr("cast(array() as array<string>)"))


def token_tags(text: Column, tags: Column) -> Column:
    """``token, start, end, tag``: words take the tag of their first character (M2)."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))
    gaps = F.split(text, r"\S+")
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda p: F.struct(F.length(F.coalesce(p["g"], F.lit(""))).alias("g"), p["w"].alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<token:string,start:int,end:int>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["g"]
        b = a + F.length(F.coalesce(p["w"], F.lit("")))
        out = F.when(p["w"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(p["w"].alias("token"), a.alias("start"), b.alias("end")))))
        return F.struct(b.alias("at"), out.alias("out"))

    found = F.aggregate(sizes, start, step)["out"]
    return F.transform(found, lambda t: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), F.get(tags, t["start"]).alias("tag")))


def bio_islands(tagged: DataFrame) -> DataFrame:
    """``doc_id, type, start, end, confidence`` of the spans of a table of tags ``(doc_id, pos,
    start, end, tag, confidence)``: a B- opens, I- of the same type goes on, anything else closes (M3)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    kind, head = F.substring("tag", 3, 100), F.substring("tag", 1, 1)
    x = tagged.withColumn("kind", kind).withColumn("head", head).withColumn("before", F.lag("kind").over(w)).withColumn("tag0", F.lag("tag").over(w))
    goes_on = (F.col("head") == "I") & (F.col("kind") == F.col("before")) & (F.col("tag0") != "O")
    x = x.withColumn("cut", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("cut").over(w))
    x = x.withColumn("opens", F.max(F.when((F.col("cut") == 1) & (F.col("head") == "B"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "island")))
    x = x.where("opens = 1").groupBy("doc_id", "island").agg(F.min("kind").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("confidence", "pos").alias("confidence"))
    return x.drop("island")
