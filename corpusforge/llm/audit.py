"""Interaction of filters: what each removes in every order, and its fair share.

Each document has a mask of the filters that it fails, so all orders follow from the counts of
documents by part and mask, the cells: at most 2**n for each part, whatever the number of
documents. The orders are visited by swaps of neighbours (Steinhaus, Johnson and Trotter), each
order once. A swap changes what its two steps remove and nothing else, so only these are
taken anew from the cells; a filter's Shapley sum grows by what it removed times the orders
for which that held. Parts are rows of a table, walked in batches side by side.

That a text repeats an earlier one is found from counts too: documents are counted by digest, part, mask
and labels, and of each digest only the count at the smallest id is no repetition. No
text is shuffled, and a text that a third of all documents hold is one row for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, pick, table

#: A null doc_id stands after all others.
_LAST = (1 << 63) - 1
#: Documents without an id are dealt by their digests to so many groups.
_SALTS = 4096
#: With more filters an audit has too many orders to be read by anyone.
MOST_FILTERS = 8
#: Steps of parts that are walked side by side in a task.
STEPS_AT_ONCE = 40_000

_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: Failure conditions in SQL of ``text``, ``words`` (maximal runs without space and ASCII controls 9 to 13) and ``distinct_words`` (their numbers).
FILTERS: dict[str, str] = {
    "A": "words < 200",
    "B": "100L * distinct_words < 50L * words",
    "C": "100L * regexp_count(text, '[A-Z]') > 2L * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
#: The letter of the filter that a text fails if a smaller doc_id has the same text.
REPEATED = "E"


def swaps(n: int) -> Iterator[int]:
    """Places ``i`` of which ``i`` and ``i + 1`` are swapped, one after another, to visit all orders of ``n``."""
    order, way = list(range(n)), [-1] * n
    while True:
        free = [(x, i) for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not free:
            return
        x, i = max(free)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(i, j)


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """(orders, removed, kept, shapley) of ``cells``: for each part and mask the number of documents, then
    other numbers that count with them. ``removed`` is by part, order, step and number, ``kept`` by
    part, order and step, ``shapley`` by part and filter."""
    masks = np.arange(1 << n)

    def gone(before: int, f: int) -> np.ndarray:
        return cells[:, (masks & before == 0) & (masks >> f & 1 == 1)].sum(1)

    many = math.factorial(n)
    order, orders = list(range(n)), []
    removed = np.zeros((len(cells), many, n, cells.shape[2]), np.int64)
    kept = np.zeros((len(cells), many, n), np.int64)
    shapley = np.zeros((len(cells), n), np.int64)
    now = np.stack([gone((1 << k) - 1, k) for k in range(n)], 1) if n else removed[:, 0]
    left = cells[:, :, 0].sum(1)[:, None] - now[:, :, 0].cumsum(1)
    since = [0] * n

    def settle(f: int, place: int, at: int) -> None:
        """What ``f`` removed up to order ``at`` goes into its sum."""
        shapley[:, f] += now[:, place, 0] * (at - since[f])
        since[f] = at

    for at, i in enumerate([None, *swaps(n)]):
        if i is not None:
            a, b = order[i], order[i + 1]
            settle(a, i, at)
            settle(b, i + 1, at)
            before = sum(1 << f for f in order[:i])
            first = left[:, i] + now[:, i, 0]
            order[i], order[i + 1] = b, a
            now[:, i], now[:, i + 1] = gone(before, b), gone(before | 1 << b, a)
            left[:, i] = first - now[:, i, 0]
        orders.append(tuple(order))
        removed[:, at], kept[:, at] = now, left
    for place, f in enumerate(order):
        settle(f, place, many)
    return orders, removed, kept, shapley


def _walker(letters: str):
    n = len(letters)
    bits = 1 << np.arange(n)
    step = max(1, STEPS_AT_ONCE // (math.factorial(n) * n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                p = batch.num_rows
                cells = np.zeros((p, 1 << n, 3), np.int64)
                for i, row in enumerate(batch.column(1).to_pylist()):
                    for c in row:
                        cells[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, removed, kept, shapley = walk(cells, n)
                by_step = np.array(orders, np.int64)
                fails = np.stack([cells[:, np.arange(1 << n) & b > 0, 0].sum(1) for b in bits], 1)
                only = cells[:, bits, 0]
                shape = (p, len(orders), n)
                named = np.array(["".join(letters[f] for f in o) for o in orders])
                columns = {
                    "part": batch.column(0).take(pa.array(np.repeat(np.arange(p), len(orders) * n))),
                    "filter_order": pa.array(np.broadcast_to(named[None, :, None], shape).ravel().tolist(), pa.string()),
                    "step": pa.array(np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), shape).ravel()),
                    "kept": kept,
                    "removed": removed[..., 0],
                    "redundant": fails[:, by_step] - removed[..., 0],
                    "unique_fails": only[:, by_step],
                    "good_lost": removed[..., 1],
                    "toxic_lost": removed[..., 2],
                    "shapley": shapley[:, by_step],
                }
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).ravel()) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))

    return run


def masked(docs: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """``doc_id, doc, part, digest, mask``: by bit, in the filters' order, which of ``filters`` each document fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    x = x.withColumn("v", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    x = x.select("doc_id", "part", "text", F.size("v").alias("words"), F.size(F.array_distinct("v")).alias("distinct_words"))
    bits = [F.coalesce(F.expr(fails), F.lit(False)).cast("int") * F.lit(1 << i) for i, fails in enumerate(filters.values())]
    return x.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by failed filters, the last bit for a repeated
    text, and how many of them ``labels (doc_id, quality, toxic)`` calls good and toxic."""
    x = masked(docs, filters)
    # Rows without an id have no label; their digests deal them out.
    x = x.withColumn("salt", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc"), F.lit(0).alias("salt"))
    known = known.agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    x = x.join(known, ["doc", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["digest", "part", "mask", "good", "toxic"]
    x = x.groupBy("doc", "salt", *keys).agg(F.count(F.lit(1)).alias("n"))
    x = x.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("doc").alias("lo"), F.min_by("n", "doc").alias("at_lo"))
    x = x.withColumn("first", F.when(F.col("lo") == F.min("lo").over(Window.partitionBy("digest")), F.col("at_lo")).otherwise(F.lit(0)))
    again = 1 << len(filters)
    x = x.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    x = x.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, repeated: str = REPEATED) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``:
    for each source, order of the filters and step the documents left after it, those that it
    removes, those that fail its filter but are gone before, those that fail no other filter, the
    labelled good and toxic ones among the removed, and what its filter removes summed over all orders.

    ``filters`` are failure conditions in SQL under one letter each, a null is no failure; ``repeated`` is the letter of
    one more: the text equals that of a smaller doc_id, whether that is removed or not. A null text is
    an empty one, a null source the empty string. A null doc_id stands after all others, and such rows
    don't repeat one another, nor do rows with one doc_id. A document with several labels is good or
    toxic if one of them says so. An empty table has no parts and gives no rows. Further columns are not read."""
    letters = "".join([*filters, repeated])
    if any(len(f) != 1 for f in filters) or len(set(letters)) < len(letters) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters need different letters, and an audit has at most {MOST_FILTERS} of them: {letters}")
    by_part = cells(docs, labels, filters).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return arrow_map(by_part, _walker(letters), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, g.i, e.i] AS ids, a.x || b.x || c.x || g.x || e.x AS filter_order FROM f a, f b, f c, f g, f e
  WHERE len(list_distinct([a.i, b.i, c.i, g.i, e.i])) = 5
),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT filter_order, k AS step, ids[k] AS own, ids[1:k - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit,
    len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS many
  FROM s, c
),
a AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""
