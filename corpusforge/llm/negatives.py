"""Hard negatives by distributed radix selection.

For each anchor the positives are its best rows of the same label, and for each positive the negatives are the
best rows of other labels within a window of scores relative to the positive's. Both are the first k
rows of a window of integer scores, and no window is ever sorted or gathered: every task counts
its rows by the leading digit of their distance from the window's top, the counts of all tasks add up to a
histogram, and the bucket in which the k-th row lies is the window of the next, finer digit. After
the last one the k-th score is known, and a second kind of pass gathers the rows above it and, of those
that tie with it, the fewest by id. A task reports only buckets up to the one in which its own rows
reach k, as later ones can't matter.

Anchors are taken in blocks, each a bounded table that every task holds while it reads the vectors in batches;
its results are written before the next block begins. Scores are exact integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, blocks, pick, shared_dir, store, table
from .mtree import order_key, quantised

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Bits of a digit.
DIGIT = 9
#: Anchors that are on the driver, and in each task, at once.
ANCHOR_BLOCK = 2048
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Every ANCHOR_EVERY-th vec_id is an anchor, every MOVED_EVERY-th row has the next of LABELS labels.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
_LONG = (1 << 63) - 1
_KINDS = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int32())
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x, copies``: the rows that take part, equal ones as one with their number."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = pick(vectors, "vec_id", "label", "embedding").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    return ok.groupBy("vec_id", "label", "x").agg(F.count(F.lit(1)).alias("copies"))


class Block:
    """Some anchors, by the length of their vectors, as a task holds them."""

    def __init__(self, rows: list):
        self.ids, self.labels = [np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label")]
        self.copies = [r["copies"] for r in rows]
        sizes = [len(r["x"]) for r in rows]
        self.by_size = {s: np.array([i for i, v in enumerate(sizes) if v == s]) for s in set(sizes)}
        self.x = {s: np.array([rows[i]["x"] for i in at], np.float64).reshape(len(at), s) for s, at in self.by_size.items()}

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(anchors, ids, labels, copies, scores) of pieces of the rows; the rows' copies are less the
        anchor itself where a row is that, and so are by row and anchor."""
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size = np.asarray(col["x"].value_lengths())
            ids, labels, copies = (np.asarray(col[c]) for c in ("vec_id", "label", "copies"))
            flat, start = np.asarray(col["x"].flatten(), np.float64), np.cumsum(size) - size
            for s, anchors in self.by_size.items():
                mine = np.flatnonzero(size == s)
                step = max(1, SCORES // len(anchors))
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    raw = flat[start[rows][:, None] + np.arange(s)] if s else np.zeros((len(rows), 0))
                    both = quantised(np.concatenate([raw, self.x[s]]))
                    score = both[: len(rows)] @ both[len(rows) :].T
                    score = score.astype(np.int64) if score.dtype != object else score
                    times = np.repeat(copies[rows][:, None], len(anchors), 1)
                    for r, a in zip(*np.nonzero(ids[rows][:, None] == self.ids[anchors]), strict=True):
                        if labels[rows[r]] == self.labels[anchors[a]] and np.array_equal(raw[r], self.x[s][a]):
                            times[r, a] -= 1
                    yield anchors, ids[rows], labels[rows], times, score


def _numbers(values: list[int]) -> np.ndarray:
    """Whole numbers, as longs if sums and differences of any two fit."""
    return np.array(values, np.int64 if all(-(1 << 61) < v < 1 << 61 for v in values) else object)


class Windows:
    """Windows of scores, one or none for each slot and anchor: of one with its label or of all others, from
    ``top`` down over ``width`` scores, and what is known of the ``need``-th row in it: it lies in ``bits``
    bits from ``base`` below the top. With no bits left that is its place; ``whole``: all rows to the end of the
    bucket count, those of a window with too few rows among them."""

    def __init__(self, top: list[list[int | None]], bottom: list[list[int]], need: int, same: bool):
        self.same, self.k = same, need
        flat = [(j, i) for j, row in enumerate(top) for i, v in enumerate(row) if v is not None and v >= bottom[j][i]]
        self.slots = max((j for j, _ in flat), default=-1) + 1
        self.at = {pair: n for n, pair in enumerate(flat)}
        self.slot, self.anchor = (np.array([p[c] for p in flat], np.int64) for c in (0, 1))
        self.top = _numbers([top[j][i] for j, i in flat])
        self.width = _numbers([top[j][i] - bottom[j][i] + 1 for j, i in flat])
        self.base = _numbers([0] * len(flat)) if self.top.dtype != object else np.array([0] * len(flat), object)
        self.bits = np.array([(int(w) - 1).bit_length() for w in self.width], np.int64)
        self.need = np.full(len(flat), need, np.int64)
        self.whole = np.zeros(len(flat), bool)

    def open(self) -> np.ndarray:
        return np.flatnonzero((self.bits > 0) & ~self.whole)

    def of(self, slot: int, anchors: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, their columns) of a slot among the anchors of one piece."""
        column = np.full(int(self.anchor.max(initial=-1)) + 1, -1)
        inside = anchors < len(column)
        column[anchors[inside]] = np.flatnonzero(inside)
        mine = which[(self.slot[which] == slot) & (column[self.anchor[which]] >= 0)]
        return mine, column[self.anchor[mine]]

    def hits(self, block: Block, piece: tuple, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(window, row, copies, distance from the top) of the rows of a piece in the known part of each window."""
        anchors, _, labels, times, score = piece
        own = labels[:, None] == block.labels[anchors]
        for slot in range(self.slots):
            w, c = self.of(slot, anchors, which)
            if not len(w):
                continue
            below = self.top[w] - score[:, c]
            fits = (below >= 0) & (below < self.width[w]) & (own[:, c] == self.same) & (times[:, c] > 0)
            r, k = np.nonzero(fits)
            yield w[k], r, times[r, c[k]], below[r, k]

    def locate(self, found: list) -> None:
        """Take in the bucket of each open window in which its ``need``-th row lies, and the rows before it and in it."""
        shift = {int(n): max(0, int(self.bits[n]) - DIGIT) for n in self.open()}
        for n, s in shift.items():
            self.bits[n] = s
        for w, bucket, before, inside in found:
            self.base[w] += bucket << shift.pop(w)
            self.need[w] -= before
            self.whole[w] = inside == self.need[w]
        for n in shift:  # fewer rows than are needed, all told
            self.base[n], self.bits[n], self.whole[n] = 0, int(self.width[n] - 1).bit_length(), True


def _counter(block: Block, windows: Windows):
    which = windows.open()
    place = np.full(len(windows.top), -1)
    place[which] = np.arange(len(which))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(which), 1 << DIGIT), np.int64)
        shift = np.maximum(0, windows.bits - DIGIT)
        for piece in block.scores(batches):
            for w, _, times, below in windows.hits(block, piece, which):
                digit = (below - windows.base[w]) >> (shift[w] if below.dtype != object else shift[w].astype(object))
                ok = (digit >= 0) & (digit < 1 << np.minimum(windows.bits[w], DIGIT))
                np.add.at(counts, (place[w[ok]], digit[ok].astype(np.int64)), times[ok])
        before = counts.cumsum(1) - counts
        w, bucket = np.nonzero((counts > 0) & (before < windows.need[which][:, None]))
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array(which[w].astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[w, bucket])], names=["w", "bucket", "n"])

    return run


def _gatherer(block: Block, windows: Windows):
    which = np.arange(len(windows.top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, list[tuple[int, int, int]]] = {}
        out: list[tuple[int, int, int, int]] = []

        def batch_of(rows: list) -> pa.RecordBatch:
            scored = [(w, i, int(windows.top[w]) - b, n) for w, i, b, n in rows]
            columns = zip(*[(w, i, str(s), order_key(s), n) for w, i, s, n in scored], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=["w", "vec_id", "score", "key", "n"])

        size = np.array([1 << int(b) for b in windows.bits], windows.top.dtype)
        last = np.minimum(windows.base + size, windows.width)
        for piece in block.scores(batches):
            for w, r, times, below in windows.hits(block, piece, which):
                sure = (below < windows.base[w]) | windows.whole[w] & (below < last[w])
                tied = ~windows.whole[w] & (below == windows.base[w])
                for k in np.flatnonzero(sure | tied).tolist():
                    n, item = int(w[k]), (int(w[k]), int(piece[1][r[k]]), int(below[k]), int(min(times[k], windows.k)))
                    if sure[k]:
                        out.append(item)
                        continue
                    heap = ties.setdefault(n, [])
                    heap.append(item)
                    if len(heap) > 64:
                        heap.sort(key=lambda x: x[1])
                        del heap[windows.need[n] :]
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        for n, heap in ties.items():
            out += sorted(heap, key=lambda x: x[1])[: windows.need[n]]
        if out:
            yield batch_of(out)

    return run


def select(rows: DataFrame, block: Block, windows: Windows) -> DataFrame:
    """``w, rank, vec_id, score``: of each window the first ``k`` rows; scores are whole numbers in digits."""
    whole = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    while len(windows.open()):
        n = arrow_map(rows, _counter(block, windows), "w int, bucket int, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        need = F.element_at(F.lit(windows.need.tolist()), F.col("w") + 1)
        n = n.withColumn("upto", F.sum("n").over(whole)).where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
        windows.locate([tuple(x) for x in n.select("w", "bucket", F.col("upto") - F.col("n"), "n").collect()])
    out = arrow_map(rows, _gatherer(block, windows), "w int, vec_id long, score string, key binary, n int")
    order = Window.partitionBy("w").orderBy(F.desc("key"), "vec_id")
    out = out.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= windows.k).select("w", "rank", "vec_id", "score")


def _long(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row of ``vectors
    (vec_id, label, embedding)`` with ``is_anchor`` and each of its ``positives`` best other rows of its label
    the ``negatives`` best rows of other labels whose score is at least ``least`` and at most ``most``
    hundredths of the positive's. A score is the inner product of the vectors times 256, floored; ties go
    to the smaller vec_id.

    Rows without id, label or vector, or with a null or non-finite component, take no part; vectors of
    different lengths are not compared. Equal rows and rows of one id count as they are: each may be an
    anchor, a positive and a negative of its own. A positive of a negative score has no
    negatives. Fewer rows than asked for give fewer; an empty table none. Scores are compared whole; one beyond 64 bits is given as the
    nearest long. Labels are whole numbers; further columns are not read."""
    spark = vectors.sparkSession
    rows = store(usable(vectors), "vectors")
    floor = F.transform("x", lambda v: F.floor(v * 256).cast("double"))
    square = F.aggregate(floor, F.lit(0.0), lambda a, v: a + v * v)
    longest, largest, size = rows.agg(F.max(F.sqrt(square)), F.max(F.array_max(F.transform("x", F.abs))), F.max(F.size("x"))).first()
    paths = []
    for anchors in blocks(rows.where(is_anchor), anchor_block):
        if not anchors:
            continue
        block = Block(anchors)
        if longest < 1e15 and largest < 1e13:  # the product of lengths bounds a score, with room for rounding
            own = [math.sqrt(sum(math.floor(v * 256) ** 2 for v in a["x"])) for a in anchors]
            bound = [int(v * longest * 1.000001) + 1 for v in own]
        else:
            bound = [size * (int(largest * 256 if largest < 1e300 else int(largest) * 256) + 1) ** 2] * len(anchors)
        windows = Windows([bound], [[-b for b in bound]], positives, same=True)
        found = sorted(select(rows, block, windows).collect(), key=lambda r: (r["w"], r["rank"]))
        top: list[list] = [[None] * len(anchors) for _ in range(positives)]
        bottom: list[list] = [[0] * len(anchors) for _ in range(positives)]
        about = {}
        for r in found:
            a, slot, score = int(windows.anchor[r["w"]]), r["rank"] - 1, int(r["score"])
            top[slot][a], bottom[slot][a] = most * score // 100, -(-least * score // 100)
            about[slot, a] = (anchors[a]["vec_id"], r["vec_id"], _long(score), anchors[a]["copies"])
        windows = Windows(top, bottom, negatives, same=False)
        if not windows.slots:
            continue
        named = spark.createDataFrame([(w, *about[pair]) for pair, w in windows.at.items()], "w int, anchor_id long, positive_id long, positive_score long, copies int")
        result = select(rows, block, windows).join(F.broadcast(named), "w").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        nearest = F.when(F.col("score").startswith("-"), F.lit(-_LONG - 1)).otherwise(F.lit(_LONG))
        clamped = F.coalesce(F.col("score").try_cast("long"), nearest)
        paths.append(shared_dir(spark, "negatives"))
        result.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", clamped.alias("negative_score")).write.parquet(paths[-1])
    return spark.read.schema(_OUT).parquet(*paths) if paths else spark.createDataFrame([], _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
), p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.r, nth ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
