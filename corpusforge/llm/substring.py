"""Removal of repeated passages through a log-structured fingerprint index.

A window is 50 consecutive words of a text. Its fingerprint is the least of the 26
hashes of 25 consecutive words in it, so equal windows have equal fingerprints, and
neighbouring windows share theirs: a text has about one for every 13 words. A run of the
index is the distinct fingerprints of a batch with the smallest and largest doc_id that
has each, immutable, in buckets of the fingerprint and sorted in them. A new batch becomes a
run and is merge-joined with the runs before it, bucket by bucket, without a shuffle of
either. Only texts that share a fingerprint are looked at again: the windows that have
it, from both sides, are compared by two 64-bit hashes of all 50 words that are independent
from the bytes up. Runs are compacted into larger ones as they gather, so a batch meets
few of them. Beside the runs the index keeps, as they come, the fingerprints of each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as w
from ._common import arrow_map, drop_stored, pick, pieces, shared_dir, store, table, text_buffers

WINDOW = 50
#: Words of the sequences of which a window's least hash is its fingerprint.
ANCHOR = 25
#: Runs of like size that are merged into one.
FAN_IN = 2
#: Batches that the query feeds to the index one after another, by doc_id.
BATCHES = 3
#: So many keys (24 bytes each) are broadcast at most; beyond, the join shuffles.
BROADCAST_KEYS = 300_000
_LAST = (1 << 63) - 1  # stands for a null doc_id in comparisons: after all others


def _hashed(batch: pa.RecordBatch, hashes: int) -> Iterator[tuple]:
    """(row, its word hashes, ``hashes`` arrays) of each text that has a window."""
    data, at, _ = text_buffers(batch.column(batch.schema.get_field_index("text")))
    starts, ends, of = w.spans(data, at, w.SPACES)
    h = [w.word_hashes(data, starts, ends, which=k) for k in range(hashes)]
    for i, (lo, hi) in enumerate(zip(of[:-1], of[1:], strict=True)):
        if hi - lo >= WINDOW:
            yield i, *[x[lo:hi] for x in h]


def _fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint of each window."""
    return w.sliding_min(w.grams(h, ANCHOR), WINDOW - ANCHOR + 1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, found = [], []
        for i, h in _hashed(batch, 1):
            rows.append(i)
            found.append(np.unique(_fingerprints(h)))
        if rows:
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(at), flat)], names=["doc", "version", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=500_000):
        wanted = batch.column(batch.schema.get_field_index("anchors"))
        rows, pos, h1, h2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, h, g in _hashed(batch, 2):
            p = np.flatnonzero(np.isin(_fingerprints(h), np.asarray(wanted[i].values).view(np.uint64)))
            rows.append(np.full(len(p), i))
            pos.append(p.astype(np.int32))
            h1.append(w.grams(h, WINDOW)[p])
            h2.append(w.grams(g, WINDOW)[p])
        at = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(pos))],
            names=["w1", "w2", "doc", "version", "pos"],
        )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, places, whole = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "places", "whole"))
        data, at, nulls = text_buffers(texts)
        raw, marks, whole = data.tobytes(), places.to_pylist() if places.null_count < len(places) else None, whole.to_pylist()
        n, gone, kept, cut = [], [], [], []
        for i in range(batch.num_rows):
            words = raw[at[i] : at[i + 1]].split()
            n.append(len(words))
            spans: list[dict] = []
            p = [0] if whole[i] and len(words) >= WINDOW else marks[i] if marks else None
            if p:
                edge = np.zeros(len(words) + 1, np.int64)
                if whole[i]:
                    edge[0], edge[-1] = 1, -1
                else:
                    p = np.asarray(p)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + WINDOW, -1)
                out = np.cumsum(edge[:-1]) > 0
                flip = np.flatnonzero(np.diff(np.r_[False, out, False]))
                spans = [{"first_word": int(a), "end_word": int(b)} for a, b in flip.reshape(-1, 2)]
                words = [x for x, o in zip(words, out.tolist(), strict=True) if not o]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
            cut.append(spans)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
        )


_STRIPPED = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first_word:int,end_word:int>>"


def _limited(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join by document; ``keys`` are broadcast if they are few."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["doc", "version"], how)


class FingerprintIndex:
    """Bucketed and sorted runs in the shared folder, and the batches met so far."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = shared_dir(spark, "fingerprints")
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[tuple[DataFrame, DataFrame]] = []
        self.made = 0

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame) -> str:
        """A run (a table's name) of ``rows (anchor, lo, hi)``, whose anchors differ."""
        run = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "anchor").write.format("parquet").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        gone = self.spark.range(0)
        gone._stored_at = f"{self.path}/{run}"
        drop_stored(gone)

    def _settle(self, run: str) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN_IN:
                return
            old, self.levels[level] = self.levels[level], []
            rows = self.spark.table(old[0])
            for r in old[1:]:
                rows = rows.unionByName(self.spark.table(r))
            run = self._write(rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            for r in old:
                self._drop(r)
            level += 1

    def ingest(self, batch: DataFrame) -> DataFrame:
        """``doc, version, places``: where windows of the batch start that begin in an
        earlier batch too, or in a document of this batch with a smaller id."""
        found = store(arrow_map(batch, _anchors, "doc long, version long, anchors array<long>"), "postings")
        self.batches.append((batch, found))
        rows = found.select("doc", F.explode("anchors").alias("anchor"))
        run = self._write(rows.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
        new = self.spark.table(run)
        alike = new.where("lo < hi").select("anchor")
        for r in self.runs():
            alike = alike.unionByName(self.spark.table(r).join(new.hint("merge"), "anchor").select("anchor"))
        alike = store(alike.distinct(), "alike")
        few = alike.count() <= BROADCAST_KEYS
        touched = None
        for _, postings in self.batches:
            part = postings.select("doc", "version", F.explode("anchors").alias("anchor"))
            touched = part if touched is None else touched.unionByName(part)
        touched = touched.join(F.broadcast(alike) if few else alike, "anchor")
        touched = store(touched.groupBy("doc", "version").agg(F.collect_set("anchor").alias("anchors")), "touched")
        seen = None
        for no, (texts, _) in enumerate(self.batches):
            part = _limited(texts, touched.select("doc", "version"), "left_semi").join(touched, ["doc", "version"])
            part = arrow_map(part.select("doc", "version", "text", "anchors"), _windows, "w1 long, w2 long, doc long, version long, pos int").withColumn("batch", F.lit(no))
            seen = part if seen is None else seen.unionByName(part)
        seen = store(seen, "windows")
        when = F.struct("batch", "doc")
        first = store(seen.groupBy("w1", "w2").agg(F.min(when).alias("first"), F.max(when).alias("last")).where("first < last").select("w1", "w2", "first"), "repeated")
        now = len(self.batches) - 1
        again = seen.where(F.col("batch") == now).join(first, ["w1", "w2"]).where(F.struct("batch", "doc") > F.col("first"))
        places = store(again.groupBy("doc", "version").agg(F.collect_set("pos").alias("places")), "places")
        for x in (alike, touched, seen, first):
            drop_stored(x)
        self._settle(run)
        return places

    def close(self) -> None:
        """Delete the index; the places that were found stay."""
        for run in self.runs():
            self._drop(run)
        for _, postings in self.batches:
            drop_stored(postings)
        self.levels, self.batches = [], []


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` for every row of ``docs``.

    A word goes if a window of 50 words covers it whose words also start, in the
    same order, in a document with a smaller doc_id. ``docs`` reach the index in
    ``batches`` ranges of doc_id. Exact copies of a text are told by their digest and don't
    enter the index. A null text has no words; a null doc_id counts as larger than
    all ids (as large as the largest long); rows with one and the same doc_id don't remove one another. Texts of
    fewer than 50 words, and an empty table, come back whole. Other columns are
    not read."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text", "doc_id")
    digest = store(docs.where(F.length("text") >= 2 * WINDOW - 1).select("doc", "version", F.sha2(F.col("text"), 256).alias("digest")), "digests")
    firsts = store(digest.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first"), "copied")
    later = store(digest.join(firsts, "digest").where("doc > first").select("doc", "version").distinct(), "later")
    drop_stored(digest)
    drop_stored(firsts)
    fresh = _limited(docs, later, "left_anti").select("doc", "version", "text")
    cuts = docs.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    index, found = FingerprintIndex(spark), []
    edges = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = fresh
        if lo is not None:
            part = part.where(F.col("doc") > lo)
        if hi is not None:
            part = part.where(F.col("doc") <= hi)
        found.append(index.ingest(part))
    index.close()
    marks = later.select("doc", "version", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("whole"))
    for places in found:
        marks = marks.unionByName(places.withColumn("whole", F.lit(False)))
    marks = store(marks, "marks")
    for x in (later, *found):
        drop_stored(x)
    keys = marks.select("doc", "version")
    cut = _limited(docs, keys, "left_semi").join(marks, ["doc", "version"]).select("doc_id", "text", "places", "whole")
    same = _limited(docs, keys, "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(False).alias("whole"))
    return arrow_map(cut.unionByName(same), _strip, _STRIPPED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first_id FROM w GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS x FROM w JOIN f USING (h) WHERE doc_id > first_id),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS x FROM d),
k AS (SELECT e.doc_id, count(c.x) AS n_removed, string_agg(word, ' ' ORDER BY e.x) FILTER (c.x IS NULL) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.x = c.x GROUP BY e.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
