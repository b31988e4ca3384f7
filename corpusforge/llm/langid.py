"""Language of a text by a byte convolutional network over fixed windows.

A text's bytes, letters folded to lower case, are cut into windows of 256; filters
of widths 2, 3 and 4 over byte embeddings, max pooling and a softmax give each
window's language, and the windows' log-probabilities, weighted by length, that of
the whole text. The network is trained in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words as w
from ._common import arrow_map, pick, pieces, remainder, table, text_buffers
from .convnet import ConvNet, softmax

WINDOW = 256
#: Labelled texts for each language that training takes at most, and windows of each.
SAMPLE = 600
WINDOWS_OF_ONE = 3
EPOCHS = 5
_BLOCK = 128  # windows whose responses are in memory at once

#: ASCII letters fold to lower case, all other ASCII bytes are one space.
FOLD = np.where(np.arange(256) < 0x80, 0x20, np.arange(256)).astype(np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters (second byte after C3)."""
    out = FOLD[data]
    if len(out) > 1:
        up = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
        out[1:][up] += 0x20
    return out


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x 256 bytes, 0 beyond a text; the text of each; its length)."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][of] + nth * WINDOW
    length = np.minimum(WINDOW, at[1:][of] - begin)
    place = begin[:, None] + np.arange(WINDOW)
    x = np.concatenate([data, np.zeros(1, np.uint8)])[np.minimum(place, len(data))]
    x[np.arange(WINDOW) >= length[:, None]] = 0
    return x, of, length


class LanguageModel:
    def __init__(self, langs: list[str], net: ConvNet):
        self.langs, self.net = langs, net
        single = net.tables()
        single[0] = 0  # byte 0 is padding
        f, c, self.tables = net.filters, 0, []
        for k in net.widths:  # neighbouring bytes are looked up together
            parts = [single[:, c + j * f : c + (j + 1) * f] for j in range(k)]
            pairs = [(parts[j][:, None] + parts[j + 1][None]).reshape(-1, f) for j in range(0, k - 1, 2)]
            self.tables.append((k, [np.ascontiguousarray(p) for p in pairs], np.ascontiguousarray(parts[-1]) if k % 2 else None))
            c += k * f

    def window_logs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for lo in range(0, len(x), _BLOCK):
            b = np.zeros((min(_BLOCK, len(x) - lo), WINDOW + 3), np.uint16)
            b[:, :WINDOW] = x[lo : lo + _BLOCK]
            pair = b[:, :-1] * np.uint16(256) + b[:, 1:]
            pooled = []
            for _, pairs, last in self.tables:
                y = pairs[0][pair[:, :WINDOW]]
                for j, p in enumerate(pairs[1:], 1):
                    y += p[pair[:, 2 * j : 2 * j + WINDOW]]
                if last is not None:
                    y += last[b[:, 2 * len(pairs) : 2 * len(pairs) + WINDOW]]
                pooled.append(y.max(1))
            p = softmax(self.net.logits(np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0)))
            out[lo : lo + _BLOCK] = np.log(np.maximum(p, 1e-6))
        return out

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, probability) of each text."""
        n = len(at) - 1
        total, weight = np.zeros((n, len(self.langs))), np.zeros(n)
        x, of, length = windows(fold(data), at)
        if len(x):
            share = length / WINDOW
            logs = self.window_logs(x) * share[:, None]
            np.add.at(total, of, logs)
            np.add.at(weight, of, share)
        p = softmax(total / np.maximum(weight, 1e-9)[:, None])
        return p.argmax(1), p.max(1)


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model of the labelled rows of ``docs (doc_id, text, lang)``; None if there are none.

    At most ``sample`` texts of each language, by a hash of the id, then of the text, are taken to the driver, three
    windows of each, spread over the whole text. Every language has one at least, whatever the ids are."""
    docs = docs.where("lang is not null and text is not null and octet_length(text) > 0")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000)) / 1e6
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / counts[k]))]), F.col("lang"))
    step = F.greatest(F.lit(0), (F.length("text") - WINDOW) / (WINDOWS_OF_ONE - 1))
    cuts = [F.expr("substring(text, {}, {})".format("1 + cast(step * %d as int)" % i, WINDOW)) for i in range(WINDOWS_OF_ONE)]
    cut = docs.withColumn("step", step).select("lang", F.array_distinct(F.array(*cuts)).alias("cuts"), u.alias("u"), share.alias("share"), F.xxhash64("text").alias("t"))
    # Rows with one id, or none, are all below the share or all not: the rank bounds them, and the least row stands in for none.
    some = cut.where("u < share").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("u", "t"))).where(F.col("nth") <= sample)
    rows = some.select("lang", F.explode("cuts").alias("x")).orderBy("lang", "x").collect()
    if lost := sorted(set(langs) - {r["lang"] for r in rows}):
        least = cut.where(F.col("lang").isin(lost)).groupBy("lang").agg(F.min_by("cuts", F.struct("u", "t")).alias("cuts"))
        rows += least.select("lang", F.explode("cuts").alias("x")).orderBy("lang", "x").collect()
    number = {k: i for i, k in enumerate(langs)}
    texts, y, random = [], [], np.random.default_rng(7)
    for r in rows:
        b = fold(np.frombuffer(r["x"].encode()[:WINDOW], np.uint8))
        # A piece of any length beside each window, so that short texts are learned too.
        n = int(np.exp(random.uniform(np.log(3), np.log(WINDOW))))
        at = int(random.integers(0, max(1, len(b) - n)))
        for x in (b, b[at : at + n]):
            if len(x):
                texts.append([x.astype(np.int64)])
                y.append(number[r["lang"]])
    net = ConvNet(256, len(langs), embed=8, widths=(2, 3, 4), filters=12)
    net.train(texts, np.array(y), EPOCHS)
    net.forget()
    return LanguageModel(langs, net)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs (doc_id, text)``.

    ``und`` with score 0 if a text is null, empty or has no letter, or if nothing could be learned; ties go
    to the first language by name. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            data, at, _ = text_buffers(batch.column(1))
            letters = np.asarray(batch.column(2))
            if model is None:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                best, p = model.predict(data, at)
                lang = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    x = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return arrow_map(x, run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(pick(docs, "doc_id", "text", "lang").where(remainder("doc_id", 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
