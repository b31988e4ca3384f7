"""Exact top-k by inner product: M-trees searched best first.

Inner products become a metric by one more coordinate: with x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0), the squared distance is |q|^2 + M^2 - 2 qx, so the nearest vectors are
those of the largest product. The vectors are dealt over shards by a hash of the
id; each shard is an M-tree of bounded size, built once and stored: its nodes are pages with a
routing vector, a covering radius and the distance to the parent's routing vector, a leaf
page holds its vectors with their distances to the routing vector. A query takes the
page with the least possible distance from a heap; a page or vector whose stored distances
already put it beyond the k-th best by the triangle inequality is passed over without
computing its own. A task goes on from tree to tree with the best found so far and gives
up only k rows a query. Scores are exact integers of any size. Queries are taken in blocks; the rows
found for one are written before the next is fetched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, blocks, grouped, pick, shared_dir, store, table

K = 5
#: Vectors of one M-tree at most, and at least where there are cores for more trees.
SHARD_ROWS, LEAST_ROWS = 10_000, 2_000
#: Vectors of a leaf page; children of a routing node.
PAGE = 128
FAN_OUT = 16
#: Queries that are on the driver, and in each task, at once.
QUERY_BLOCK = 4096
#: Every QUERY_EVERY-th vec_id is a query.
QUERY_EVERY = 50
#: What distances in doubles may be off by, as a share of the largest, for vectors of exact doubles and others.
_SLACK, _MORE_SLACK = 1e-9, 1e-6
_LONG = (1 << 63) - 1
_PAGES = "route array<int>, radius array<double>, parent array<double>, kids_from array<int>, kids_to array<int>, rows_from array<int>, rows_to array<int>"
_TREE = f"size int, shard int, ids array<long>, copies array<long>, x array<double>, far array<double>, {_PAGES}"
_FOUND = "query int, query_id long, copies long, vec_id long, score long, key binary, pages long, distances long, avoided long"
_OUT = "query_id long, rank int, vec_id long, score long, pages long, distances long, avoided long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x, copies``: the vectors as doubles, equal rows as one with their number. Those that are null or
    hold null or non-finite components, and rows without an id, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = pick(vectors, "vec_id", "embedding").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return ok.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles if every inner product is exact in them, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * 256)
    most = max(float(np.abs(y).max(initial=0)), 1.0)
    if most * most * max(1, x.shape[-1]) < 1 << 53:
        return y
    whole = [int(v) * 256 if abs(v) >= 1 << 53 else math.floor(v * 256) for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def order_key(score: int) -> bytes:
    """Bytes in the order of integers of any size."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return (0x8000 + size).to_bytes(2, "big") + score.to_bytes(size, "big")
    return (0x8000 - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def _metric(y: np.ndarray) -> tuple[np.ndarray, float]:
    """(points of the metric, M^2); without order if squares are beyond doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        real = y.astype(np.float64)
        norm = (real * real).sum(1)
        top = float(norm.max(initial=0.0))
        if not math.isfinite(4 * top):
            return np.zeros((len(y), y.shape[1] + 1)), math.inf
        return np.concatenate([real, np.sqrt(np.maximum(top - norm, 0))[:, None]], 1), top


def build(ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The pages of one M-tree over quantised vectors ``y``, and the ``order`` of rows in which
    those of a leaf lie together, by id."""
    order = np.argsort(ids, kind="stable")
    metric, _ = _metric(y[order])
    pages: list[dict] = []
    rows_of: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0

    def far(rows: np.ndarray, to: int) -> np.ndarray:
        d = metric[rows] - metric[to]
        return np.sqrt((d * d).sum(1))

    def split(rows: np.ndarray, away: np.ndarray) -> list[tuple[int, np.ndarray]]:
        # Routing vectors: each the farthest from those before it, so that equal vectors stay together.
        chosen, owner = [int(rows[away.argmax()])], np.zeros(len(rows), np.int64)
        near = far(rows, chosen[0])
        while len(chosen) < min(FAN_OUT, -(-len(rows) // PAGE) * 2) and near.max() > 0:
            chosen.append(int(rows[near.argmax()]))
            d = far(rows, chosen[-1])
            owner = np.where(d < near, len(chosen) - 1, owner)
            near = np.minimum(near, d)
        parts = [(c, rows[owner == k]) for k, c in enumerate(chosen)]
        return [(c, p) for c, p in parts if len(p)]

    level = [(0, np.arange(len(ids)), 0.0)] if len(ids) else []
    while level:  # breadth first, so that the children of a page have neighbouring numbers
        nxt, first = [], len(pages) + len(level)
        for route, rows, to_parent in level:
            away = far(rows, route)
            page = {"route": route, "radius": float(away.max()), "parent": to_parent, "kids_from": 0, "kids_to": 0, "rows_from": 0, "rows_to": 0}
            kids = split(rows, away) if len(rows) > PAGE and away.max() > 0 else []
            if len(kids) > 1:
                page |= {"kids_from": first + len(nxt), "kids_to": first + len(nxt) + len(kids)}
                nxt += [(c, p, float(far(np.array([c]), route)[0])) for c, p in kids]
            else:  # few vectors, or such as can't be parted by distance
                page |= {"rows_from": done, "rows_to": done + len(rows)}
                done += len(rows)
                rows_of.append((rows, away))
            pages.append(page)
        level = nxt
    rows = np.concatenate([r for r, _ in rows_of]) if rows_of else np.zeros(0, np.int64)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    out = {c: np.array([p[c] for p in pages]) for c in ("radius", "parent", "kids_from", "kids_to", "rows_from", "rows_to")}
    far_of = np.concatenate([a for _, a in rows_of]) if rows_of else np.zeros(0)
    return out | {"route": place[[p["route"] for p in pages]], "order": order[rows], "ids": ids[order][rows], "far": far_of}


class MTree:
    """A tree over quantised vectors ``x``, open for searches: built, or from its stored pages, with the rows'
    ``copies`` and unquantised vectors ``raw``. Counts what searches read and what they passed over."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pages: dict[str, np.ndarray] | None = None, copies: np.ndarray | None = None, raw: np.ndarray | None = None):
        if pages is None:
            pages = build(ids, x)
            x = x[pages["order"]]
        self.t, self.ids, self.x, self.raw = pages, pages["ids"], x, raw
        self.copies = np.ones(len(x), np.int64) if copies is None else copies
        self.metric, self.top = _metric(x)
        self.slack = (_SLACK if x.dtype != object else _MORE_SLACK) * (1 + 4 * self.top) ** 0.5 + 1e-6
        #: For each leaf page its rows and their distances to the routing vector.
        self.rows = [(np.arange(lo, hi), pages["far"][lo:hi]) if hi else None for lo, hi in zip(pages["rows_from"], pages["rows_to"], strict=True)]
        self.pages = self.distances = self.avoided = 0

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]] | None = None, raw: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (score, vec_id), ties to the smaller id, without the query's own row: that of the id ``own``
        and the vector ``raw``, or all with that id if no vector is given. ``best``, what other trees
        gave, is a heap of (score, -vec_id) with the worst first, and made better."""
        best = [] if best is None else best
        if len(self.ids):
            self._search(q, own, k, best, raw)
        return [(s, -i) for s, i in sorted(best, key=lambda b: (-b[0], -b[1]))]

    def _search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]], raw: np.ndarray | None) -> None:
        t, real = self.t, q.astype(np.float64)
        point = np.append(real, 0.0)
        whole = float(real @ real) + self.top if math.isfinite(self.top) else math.inf

        def distance(rows) -> np.ndarray:
            d = self.metric[rows] - point
            return np.sqrt((d * d).sum(-1))

        def reach() -> float:
            return max(0.0, whole - 2.0 * float(best[0][0])) ** 0.5 + self.slack if len(best) == k and math.isfinite(whole) else math.inf

        limit = reach()
        d0 = float(distance(t["route"][0])) if math.isfinite(whole) else 0.0
        self.distances += 1
        heap = [(max(0.0, d0 - t["radius"][0]), 0, d0)]
        while heap:
            low, n, d = heapq.heappop(heap)
            if low > limit:
                break
            if t["kids_to"][n] == 0:
                self.pages += 1
                every, far = self.rows[n]
                rows = every[np.abs(d - far) <= limit] if limit < math.inf else every
                self.avoided += len(every) - len(rows)
                self.distances += len(rows)
                score = self.x[rows] @ q
                if len(best) == k:
                    keep = score >= best[0][0]
                    rows, score = rows[keep], score[keep]
                if len(rows) > 4 * k:  # by score, then by id (a page's rows are in the order of ids)
                    cut = np.argsort(-score, kind="stable")[: k + 1]
                    rows, score = rows[cut], score[cut]
                for row, i, s in zip(rows.tolist(), self.ids[rows].tolist(), score.tolist(), strict=True):
                    times, item = min(k + 1, int(self.copies[row])), (int(s), -i)
                    if i == own:
                        times -= 1 if raw is not None and np.array_equal(self.raw[row], raw) else times if raw is None else 0
                    for _ in range(times):
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                        else:
                            break
                limit = reach()
                continue
            kids = np.arange(t["kids_from"][n], t["kids_to"][n])
            some = kids[np.abs(d - t["parent"][kids]) - t["radius"][kids] <= limit]
            self.avoided += len(kids) - len(some)
            if len(some):
                self.distances += len(some)
                away = distance(t["route"][some])
                lows = np.maximum(0.0, away - t["radius"][some])
                for i in np.flatnonzero(lows <= limit):
                    heapq.heappush(heap, (float(lows[i]), int(some[i]), float(away[i])))


def _plant(x: pa.RecordBatch) -> pa.RecordBatch:
    """The tree of one shard, as a row."""
    col = {n: x.column(i) for i, n in enumerate(x.schema.names)}
    size = col["size"][0].as_py()
    flat = np.asarray(col["x"].flatten(), np.float64).reshape(x.num_rows, size)
    tree = build(np.asarray(col["vec_id"]), quantised(flat))
    tree["x"], tree["copies"] = flat[tree["order"]], np.asarray(col["copies"])[tree["order"]]
    kinds = [(f.split()[0], pa.list_({"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split("<")[1][:-1]])) for f in _TREE.split(", ")[2:]]
    lists = [pa.array([np.ravel(tree[n])], k) for n, k in kinds]
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([col["shard"][0].as_py()], pa.int32()), *lists], names=["size", "shard", *[n for n, _ in kinds]])


def plant(vectors: DataFrame) -> DataFrame:
    """The stored M-trees of ``vectors (vec_id, x, copies)``, one row each: a table that any number of
    searches can read."""
    spark = vectors.sparkSession
    n = vectors.count()
    shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    dealt = vectors.select("vec_id", "x", "copies", F.size("x").alias("size"), F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard")).repartitionById(shards, F.col("shard"))
    return store(grouped(dealt, ["size", "shard"], _plant, _TREE, dealt=True), "trees")


def _searcher(queries: list, k: int):
    """Searches trees for ``queries (vec_id, x, copies)``, told apart by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[list[int], np.ndarray]] = {}
        for size in {len(q["x"]) for q in queries}:
            mine = [n for n, q in enumerate(queries) if len(q["x"]) == size]
            by_size[size] = (mine, np.array([queries[n]["x"] for n in mine], np.float64).reshape(len(mine), size))
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        counts = [[0, 0, 0] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                size = batch.column(0)[row].as_py()
                if size not in by_size:
                    continue
                tree = {n: np.asarray(batch.column(c)[row].values) for c, n in enumerate(batch.schema.names) if c > 1}
                places, raw = by_size[size]
                stored = tree["x"].reshape(len(tree["ids"]), size)
                both = quantised(np.concatenate([stored, raw]))
                searched = MTree(tree["ids"], both[: len(tree["ids"])], tree, tree["copies"], stored)
                for n, q, x in zip(places, both[len(tree["ids"]) :], raw, strict=True):
                    searched.pages = searched.distances = searched.avoided = 0
                    searched.search(q, queries[n]["vec_id"], k, best[n], x)
                    for i, c in enumerate((searched.pages, searched.distances, searched.avoided)):
                        counts[n][i] += c
        found = [
            (n, queries[n]["vec_id"], queries[n]["copies"], -i, max(-_LONG - 1, min(_LONG, s)), order_key(s), *(counts[n] if at == 0 else (0, 0, 0)))
            for n, heap in enumerate(best)
            for at, (s, i) in enumerate(heap)
        ]
        if found:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: ``counted_top_k`` without the counts."""
    return counted_top_k(vectors, is_query, k, query_block).select("query_id", "rank", "vec_id", "score")


def counted_top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score, pages, distances, avoided``: for each row of ``vectors (vec_id,
    embedding)`` with ``is_query`` the ``k`` other rows of the highest inner product, ties to the
    smaller vec_id; and, in all trees together, the leaf pages that the query read, the
    distances it computed and those that stored ones made needless (pages never reached not counted).

    Vectors of different lengths are not compared. Null vectors and those with null or non-finite
    components take no part, nor do rows without an id. Rows count as they are: of equal rows, or rows of
    one id, each is a candidate for the others and, if it is a query, has results of its own.
    Fewer than ``k`` candidates give fewer rows; an empty table none. Scores are
    compared whole; one beyond 64 bits is then given as the nearest long. Further columns are not read."""
    spark = vectors.sparkSession
    x = store(usable(vectors), "vectors")
    trees = plant(x)
    own = Window.partitionBy("query")
    sums = {c: F.sum(c).over(own) for c in ("pages", "distances", "avoided")}
    paths = []
    for queries in blocks(x.where(is_query), query_block):
        if queries:
            # At most k rows a query from each task.
            ranked = arrow_map(trees, _searcher(queries, k), _FOUND).withColumns({"rank": F.row_number().over(own.orderBy(F.desc("key"), "vec_id")), **sums})
            ranked = ranked.where(F.col("rank") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            paths.append(shared_dir(spark, "found"))
            ranked.select("query_id", "rank", "vec_id", "score", *sums).write.parquet(paths[-1])
    return spark.read.schema(_OUT).parquet(*paths) if paths else spark.createDataFrame([], _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
