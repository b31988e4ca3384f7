"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Text and benchmark are normalised to ASCII-lower-case words of letters, digits and
non-ASCII characters, joined by single spaces. A window is ten consecutive words of a
benchmark item (question and answer alike). Each window holds one of the item's pieces
of five words that begin at every fifth word, so these pieces are the patterns, with a
space at either end so that they match whole words only, and the automaton has about one
node for each byte of the benchmark and not for each byte of all its windows. The automaton reads every text
once; where a piece occurs, the words around it are compared with those around it in the
item, and the windows found are mapped back to places in the original bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as w
from ._common import arrow_map, pick, pieces, store, table, text_buffers

WINDOW = 10
#: Bytes of benchmark text in one automaton (about 45 bytes of memory for each); only a
#: larger benchmark is read in blocks.
BLOCK_BYTES = 4_000_000
#: Places of one piece that are compared at once.
_AT_ONCE = 100_000

_NORMAL = bytes(32 if w.NOT_ALNUM[i] else int(w.LOWER[i]) for i in range(256))
_SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])
_OUT = "doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<first_word:int,end_word:int,first_byte:bigint,end_byte:bigint>>"


class Benchmark:
    """The automaton over the pieces of some items, and the words around each piece.

    ``items`` are (id, text); an item of fewer words than ``window`` is one piece, all of it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.step = window, (window + 1) // 2
        self.reach = window - self.step
        self.number: dict[bytes, int] = {}
        self.items: list[str] = []
        of: list[int] = []
        around: list[list[int]] = []
        places: dict[bytes, list[int]] = {}
        whole: dict[bytes, set[str]] = {}
        for item, text in items:
            words = text.encode().translate(_NORMAL).split()
            if 0 < len(words) < window:
                whole.setdefault(b" ".join(words), set()).add(item)
                continue
            ids = [-1] * self.reach + [self.number.setdefault(x, len(self.number)) for x in words] + [-1] * self.reach
            for i in range(0, len(words) - self.step + 1, self.step):
                places.setdefault(b" ".join(words[i : i + self.step]), []).append(len(of))
                of.append(len(self.items))
                around.append(ids[i : i + self.reach][::-1] + ids[i + self.reach + self.step : i + 2 * self.reach + self.step])
            self.items.append(item)
        order = [k for rows in places.values() for k in rows]
        self.of = np.array(of, np.int64)[order]
        self.around = np.array(around, np.int64).reshape(len(of), 2 * self.reach)[order]
        self.auto = ahocorasick.Automaton()
        at = 0
        for piece in places.keys() | whole.keys():
            self.auto.add_word(f" {piece.decode('latin-1')} ", piece)
        self.where: dict[bytes, tuple[int, int]] = {}
        for piece, rows in places.items():
            self.where[piece] = (at, at + len(rows))
            at += len(rows)
        self.whole = whole
        self.some = bool(len(self.auto))
        if self.some:
            self.auto.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(stretches of words that windows of items cover, those items)."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not words or not self.some:
            return spans, items
        joined = b" " + b" ".join(words) + b" "
        found = list(self.auto.iter(joined.decode("latin-1")))
        if not found:
            return spans, items
        ends = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), [e for e, _ in found])
        for end, (_, piece) in zip(ends.tolist(), found, strict=True):
            if piece in self.whole:
                items |= self.whole[piece]
                spans.append((end - piece.count(b" ") - 1, end))
            if piece in self.where:
                first = end - self.step
                left = [self.number.get(x, -2) for x in words[max(0, first - self.reach) : first][::-1]]
                right = [self.number.get(x, -2) for x in words[end : end + self.reach]]
                here = np.array(left + [-2] * (self.reach - len(left)) + right + [-2] * (self.reach - len(right)), np.int64)
                lo, hi = self.where[piece]
                for k in range(lo, hi, _AT_ONCE):
                    same = self.around[k : min(k + _AT_ONCE, hi)] == here
                    before = np.cumprod(same[:, : self.reach], 1).sum(1)
                    after = np.cumprod(same[:, self.reach :], 1).sum(1)
                    ok = np.flatnonzero(before + after >= self.reach)
                    items.update(self.items[self.of[k + j]] for j in ok)
                    spans += {(first - int(before[j]), end + int(after[j])) for j in ok}
        return spans, items


_BUILT: dict[str, Benchmark] = {}


def _built(items: list[tuple[str, str]], window: int, name: str) -> Benchmark:
    """The automaton of a worker; it keeps one, by a digest of all ids and texts."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(items, window)
    return _BUILT[name]


def _scan(items: list[tuple[str, str]], window: int, name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _built(items, window, name)
        for batch in pieces(batches):
            raw, at, _ = text_buffers(batch.column(1))
            low = raw.tobytes().translate(_NORMAL)
            n, hit, ids, spans = [], [], [], []
            had_ids, had_spans = (batch.column(k).to_pylist() for k in (4, 5))
            for i in range(batch.num_rows):
                words = low[at[i] : at[i + 1]].split()
                runs, found = bench.find(words)
                out = had_spans[i]
                if runs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for a, b in [*runs, *((s["first_word"], s["end_word"]) for s in out)]:
                        cover[a] += 1
                        cover[b] -= 1
                    flip = np.flatnonzero(np.diff(np.r_[False, np.cumsum(cover[:-1]) > 0, False])).reshape(-1, 2)
                    here = np.frombuffer(low, np.uint8)[at[i] : at[i + 1]]
                    first, last, _ = w.spans(here, np.array([0, len(here)]), w.NOT_ALNUM)
                    out = [{"first_word": int(a), "end_word": int(b), "first_byte": int(first[a]), "end_byte": int(last[b - 1])} for a, b in flip]
                n.append(len(words))
                hit.append(sum(s["end_word"] - s["first_word"] for s in out))
                ids.append(sorted(found.union(had_ids[i])))
                spans.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))],
                names=["doc_id", "text", "n_words", "n_hit", "items", "spans"],
            )

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text, n_words, n_hit, items, spans`` for every row of ``docs (doc_id, text)``.

    ``spans`` are the merged hit stretches, in words and in bytes of the original
    text; ``items`` are the sorted ids of the items found. A null or empty text has
    no words; an item without words or with a null text or id matches nothing; an
    item of fewer than ``window`` words is one pattern; repeated items count once.
    An empty benchmark leaves all documents clean. Other columns are not read. The
    benchmark is taken to the driver in blocks of ``block_bytes`` and each block is one
    automaton and one pass, whose hits join those before; what a pass gives is written before the next
    block is fetched, so that one is held at a time."""
    out = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"), F.expr("cast(array() as array<struct<first_word:int,end_word:int,first_byte:bigint,end_byte:bigint>>)").alias("spans"))
    for items, name, last in _blocks(benchmark, window, block_bytes):
        out = arrow_map(out, _scan(items, window, name), _OUT)
        out = out if last else store(out, "scanned")
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[list[tuple[str, str]], str, bool]]:
    bench = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).select(F.col("item_id").cast("string"), "text").distinct().collect()
        items = sorted(tuple(r) for r in part)
        yield items, hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest(), b == blocks - 1


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no window of the benchmark occurs."""
    at = docs.columns.index("text")

    def dropper(items: list[tuple[str, str]], name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = _built(items, window, name)
            for batch in pieces(batches):
                raw, offsets, _ = text_buffers(batch.column(at))
                low = raw.tobytes().translate(_NORMAL)
                clean = [not bench.find(low[lo:hi].split())[0] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for items, name, last in _blocks(benchmark, window, block_bytes):
        docs = arrow_map(docs, dropper(items, name), docs.schema)
        docs = docs if last else store(docs, "clean")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = """
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM k)),
w AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM p))),
h AS (SELECT doc_id, i, k, item_id FROM w JOIN p USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
