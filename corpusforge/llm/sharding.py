"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is 65,536 arcs. A row's key hashes to an arc, each shard owns the arcs up to
its virtual nodes, and a row belongs to the owner of its arc. No shard takes more than
its bound: the ring is walked clockwise, and what an arc holds beyond its owner's
bound goes on to the shards of the next virtual nodes. By default the bounds differ by one
row at most and add up to the row count, so shards do too (law ``rows``); with slack each is so much above the
mean, and fewer rows move when a shard comes.

Only counts by arc meet on the driver, 65,536 numbers for any input; the walk over
them says which ranks of each arc go to which shard, and rows take their shard and
slot from their rank. All row-wise work is DataFrame operations.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import pick, store, table

ARCS = 1 << 16
VIRTUAL_NODES = 128
SHARDS = 8
#: Rows of one arc beyond which equal rows in it are ranked in parts, and those parts.
HOT_ARC, PARTS = 1_000_000, 64
_ALIKE = ["key", "doc_id", "size", "text_crc32"]


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """(arcs where virtual nodes stand, in order; the shard of each). Adding a shard adds
    only its own nodes."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % ARCS, s, v) for s in range(shards) for v in range(virtual_nodes))
    return [n[0] for n in nodes], [n[1] for n in nodes]


def plan(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for the rows of every arc.

    Two walks: in the first each owner takes what fits, arc by arc, clockwise; in
    the second what was left over goes to the next virtual node's shard with room."""
    at, whose = ring(shards, virtual_nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [math.ceil(total * (1 + slack) / shards)] * shards
    used = [0] * shards
    out, over = [], []

    def take(arc: int, lo: int, n: int, s: int) -> int:
        k = min(n, room[s] - used[s])
        if k:
            out.append((arc, lo, lo + k, s, used[s]))
            used[s] += k
        return k

    for arc in sorted(counts):
        node = bisect_left(at, arc) % len(at)
        k = take(arc, 0, counts[arc], whose[node])
        if k < counts[arc]:
            over.append((arc, k, node))
    for arc, done, node in over:
        left = counts[arc] - done
        while left:
            node = (node + 1) % len(at)
            k = take(arc, counts[arc] - left, left, whose[node])
            left -= k
    return out


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, hot_arc: int = HOT_ARC) -> DataFrame:
    """``doc_id, size, text_crc32, arc, shard, slot`` for every row of ``docs (doc_id, text)``.

    ``size`` is the UTF-8 bytes of the text (none if null) plus 1, ``text_crc32`` its unsigned CRC32. The
    key is the doc_id with the text's size and CRC, so that rows without an id, or with
    the same one, spread as well. Rows alike in all three are alike in all but their slot, and if an arc holds more than ``hot_arc`` rows are ranked in
    parts. Slots of a shard run from 0 without a gap. With ``slack`` a shard may hold that share above the mean. An empty table
    stays empty; further columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    x = x.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "size", "text_crc32")).withColumn("arc", F.pmod(F.shiftrightunsigned("key", 48), F.lit(ARCS)).cast("int"))
    counts = {r["arc"]: r["n"] for r in x.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    legs = _rows(docs.sparkSession, plan(counts, shards, virtual_nodes, slack))
    hot = [arc for arc, n in counts.items() if n > hot_arc]
    rank = F.row_number().over(Window.partitionBy("arc").orderBy(*_ALIKE)).cast("long") - 1
    ranked = x.where(~F.col("arc").isin(hot)).withColumn("rank", rank).unionByName(_in_parts(x.where(F.col("arc").isin(hot)))) if hot else x.withColumn("rank", rank)
    # At most one leg for each arc and one more for each shard that fills up in it: a bounded table.
    out = ranked.join(F.broadcast(legs), "arc").where("rank >= lo and rank < hi")
    return out.select("doc_id", "size", "text_crc32", "arc", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def _in_parts(x: DataFrame) -> DataFrame:
    """``x`` with ``rank`` in its arc, as many equal rows have it in one: equal rows are counted, dealt over
    parts and ranked within them, so no task has more than a part of them. At most rows / ``hot_arc`` arcs are so."""
    x = store(x.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "hot-arcs")
    own = Window.partitionBy("arc", *_ALIKE, "part").orderBy("part")
    parts = x.groupBy("arc", *_ALIKE, "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("arc").orderBy(*_ALIKE, "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    ranked = x.withColumn("nth", F.row_number().over(own).cast("long") - 1)
    return ranked.join(parts, [ranked[c].eqNullSafe(parts[c]) for c in ("arc", *_ALIKE, "part")]).select(*[ranked[c] for c in x.columns if c != "part"], (parts["before"] + ranked["nth"]).alias("rank"))


def _rows(spark: SparkSession, legs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The plan as a table, made in the JVM from one literal."""
    names = ("arc", "lo", "hi", "shard", "slot0")
    lists = json.dumps({n: [x[i] for x in legs] for i, n in enumerate(names)})
    kinds = "arc array<int>, lo array<bigint>, hi array<bigint>, shard array<int>, slot0 array<bigint>"
    x = spark.range(1).select(F.from_json(F.lit(lists), kinds).alias("x")).select("x.*")
    return x.select(F.inline(F.arrays_zip(*names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(table(spark, sf_dir, "documents"))


def result(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
