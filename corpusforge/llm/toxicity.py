"""Toxicity of a text by a convolutional classifier over hashed words.

A word has two hashed embeddings, of its whole and of its first four bytes, which are
added; filters of widths 1, 2 and 3 with max pooling over the whole text feed a
softmax, trained in numpy. The same pass adds up hashed word evidence for the
text's language, and the raw score is mapped by that language's own threshold
so that 0.5 is the calibrated cut. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as w
from ._common import arrow_map, pick, pieces, remainder, table, text_buffers
from .convnet import ConvNet

BUCKETS = 1 << 16
PREFIX = 4
#: Rows whose id has remainder 0 by this number are never learned from.
HELD_OUT = 5
#: Labelled texts of either class that are taken to the driver at most.
SAMPLE = 2500
#: Words of all training texts together at most (8 bytes each; rows are met in the order of a hash), and of
#: one; a longer text is learned from in ``PIECES`` pieces spread over it.
SAMPLE_WORDS, LONGEST, PIECES = 8_000_000, 50_000, 50
#: Words of a text that are scored at once; maxima go on from stretch to stretch.
STRETCH = 20_000
EPOCHS = 10
#: Steps of ``BATCH`` texts that training takes at least, so few texts are passed more often.
LEAST_STEPS = 600
BATCH = 32
#: Share of words left out at random in each pass.
DROP = 0.3
#: Training texts that a word or prefix must occur in; rarer ones have no embedding.
LEAST_TEXTS = 3
#: Calibration texts of either class without which a language takes the common threshold.
LEAST_TO_CALIBRATE = 8


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, of its prefix; offsets of the texts)."""
    starts, ends, of = w.spans(data, at, w.NOT_ALNUM)
    whole = w.word_hashes(data, starts, ends, w.LOWER)
    prefix = w.word_hashes(data, starts, ends, w.LOWER, PREFIX)
    half = np.uint64(BUCKETS // 2)
    return (whole % half).astype(np.int64), (prefix % half + half).astype(np.int64), of


class ToxicityModel:
    def __init__(self, net: ConvNet, evidence: np.ndarray, thresholds: np.ndarray, slope: float):
        self.net, self.thresholds, self.slope = net, thresholds, slope
        self.table = np.concatenate([net.tables(), evidence], 1).astype(np.float32)

    def raw(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, number of the guessed language) of each text."""
        return self.raw_of(*features(data, at))

    def raw_of(self, whole: np.ndarray, prefix: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, short = np.diff(of), self.table.shape[1]
        pooled = np.empty((len(size), len(self.net.bias)), np.float32)
        lang = np.zeros((len(size), short - self.net.tables_width), np.float32)
        long = size > STRETCH
        if not long.any():
            pooled, lang = self._pooled(whole, prefix, of, 0)
        for i in range(len(size)) if long.any() else ():  # a long text is pooled stretch by stretch
            best = None
            for lo in range(int(of[i]), max(int(of[i + 1]), int(of[i]) + 1), STRETCH):
                end = min(int(of[i + 1]), lo + STRETCH)
                more = min(int(of[i + 1]), end + self.net.pad()) - end
                p, e = self._pooled(whole[lo : end + more], prefix[lo : end + more], np.array([0, end + more - lo]), more)
                best, lang[i] = p if best is None else np.maximum(best, p), lang[i] + e[0]
            pooled[i] = best[0]
        z = self.net.logits(self.net.activate(pooled))
        return z[:, 1] - z[:, 0], lang.argmax(1) if lang.shape[1] else np.zeros(len(size), np.int64)

    def _pooled(self, whole: np.ndarray, prefix: np.ndarray, of: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
        """(maxima, language evidence) of each text; its last ``over`` words only end filters."""
        n, pad = len(of) - 1, self.net.pad()
        size = np.diff(of) + pad
        starts = np.cumsum(size) - size
        place = np.arange(len(whole)) + np.repeat(np.arange(n) * pad, np.diff(of))
        rows = np.zeros((int(size.sum()), self.table.shape[1]), np.float32)
        rows[place] = self.table[whole]
        rows[place] += self.table[prefix]
        quiet = np.ones(len(rows), bool)
        quiet[place] = False
        if over:
            quiet[place[-over:]] = True
            rows[place[-over:], self.net.tables_width :] = 0
        width = self.net.tables_width
        return self.net.pool(rows[:, :width], starts, quiet), np.add.reduceat(rows[:, width:], starts, 0)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z, lang = self.raw(data, at)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.thresholds[lang]), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most about ``sample`` labelled texts of each class, by a hash of the id, in a fixed order."""
    marks = pick(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col("toxic") == k) & (u < min(1.0, sample / n)))
    few = marks.where(keep)
    # Two times ``sample`` rows at most, about.
    return docs.where("text is not null").join(F.broadcast(few), "doc_id").select("text", "lang", "toxic").orderBy(u, "doc_id", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel | None:
    """A model of the rows of ``docs (doc_id, text, lang)`` that ``labels (doc_id, toxic)`` mark.

    A quarter of either class is kept from the network and sets the thresholds, one for
    each language of the training rows: half way between the scores where precision and
    recall are best. None if either class has no rows. The language label only
    groups training texts; for a new text it is guessed from its words."""
    texts, marks, spoken, room = [], [], [], SAMPLE_WORDS
    for r in _sample(pick(docs, "doc_id", "text", "lang"), labels, sample).toLocalIterator():  # one text in memory at a time
        b = r["text"].encode()
        whole, prefix, _ = features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        if len(whole) > LONGEST:
            size = LONGEST // PIECES
            at = np.concatenate([np.arange(i, i + size) for i in np.linspace(0, len(whole) - size, PIECES).astype(int)])
            whole, prefix = whole[at], prefix[at]
        room -= len(whole)
        if room < 0:
            break
        texts.append([whole.astype(np.int32), prefix.astype(np.int32)])
        marks.append(int(r["toxic"] > 0))
        spoken.append(r["lang"])
    y = np.array(marks, np.int64)
    if len(set(marks)) < 2:
        return None
    langs = sorted({k for k in spoken if k is not None})
    seen = np.ones((BUCKETS, len(langs)), np.float64)
    for k, t in zip(spoken, texts, strict=True):
        if k is not None:
            for f in t:
                np.add.at(seen[:, langs.index(k)], np.unique(f), 1)
    words = np.log(seen / seen.sum(0, keepdims=True))
    words -= words.mean(1, keepdims=True) if langs else 0
    fit, r = np.ones(len(y), bool), np.random.default_rng(4)
    for k in (0, 1):
        own = r.permutation(np.flatnonzero(y == k))
        fit[own[: len(own) // 4]] = False
    net = ConvNet(BUCKETS, 2, embed=12, widths=(1, 2, 3), filters=8)
    net.embedding *= 0.04
    often = np.zeros(BUCKETS, np.int64)
    for t, k in zip(texts, fit, strict=True):
        for f in t if k else ():
            often[np.unique(f)] += 1
    rare = often < LEAST_TEXTS
    net.silent = int(np.flatnonzero(rare)[0]) if rare.any() else None
    net.embedding[rare] = 0
    heard = [[np.where(rare[f], net.silent, f) if rare.any() else f for f in t] for t, k in zip(texts, fit, strict=True) if k]
    net.train(heard, y[fit], max(EPOCHS, -(-LEAST_STEPS * BATCH // int(fit.sum()))), batch=BATCH, rate=0.05, drop=DROP)
    net.tables_width = sum(net.widths) * net.filters
    model = ToxicityModel(net, words, np.zeros(max(1, len(langs))), 1.0)
    z, lang = (np.concatenate(v) for v in zip(*[model.raw_of(whole, prefix, np.array([0, len(whole)])) for whole, prefix in texts], strict=True))
    everyone = _cut(z[~fit], y[~fit], None)
    cuts = [_cut(z[~fit & (lang == k)], y[~fit & (lang == k)], everyone) for k in range(max(1, len(langs)))]
    model.thresholds = np.array(cuts)
    net.forget()
    return model


def _cut(z: np.ndarray, y: np.ndarray, other: float | None) -> float:
    """The middle of the gap at which F1 is highest; ``other`` (0 if None) if a class has too few texts."""
    least = 1 if other is None else LEAST_TO_CALIBRATE
    if min(y.sum(), len(y) - y.sum()) < least:
        return 0.0 if other is None else other
    o = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[o])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    return float((z[o[i]] + (z[o[i + 1]] if i + 1 < len(z) else z[o[i]] - 1)) / 2)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs (doc_id, text)``.

    Null and empty texts are scored as texts without words; a tie at 0.5 is predicted 1. Without
    a model (nothing to learn from) all scores are 0. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=400_000):
            data, at, _ = text_buffers(batch.column(1))
            s = model.score(data, at) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that are not predicted toxic by a model of
    the ``labels`` that aren't held out."""
    model = train(docs, labels.where(remainder("doc_id", HELD_OUT) != 0))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=400_000):
            data, offsets, _ = text_buffers(batch.column(at))
            yield batch.filter(pa.array(model.score(data, offsets) < 0.5)) if model is not None else batch

    return arrow_map(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", HELD_OUT) != 0)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "score", "predicted")
