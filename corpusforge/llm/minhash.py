"""Near-duplicate groups of documents: universal-hash minima, bands, verified links.

1. Each text becomes its set of distinct five-word shingles. Texts with one and
   the same set form a class; the smallest doc_id stands for it from here on.
2. A class has 128 minima of universal hashes, cut into 32 bands of 4. At the
   least linked similarity, 0.75, a pair shares no band with probability 5e-6.
3. Each member of a band's bucket is a candidate with the bucket's smallest
   member (a star, not all pairs); candidates whose signatures agree too little
   go, the others are confirmed on the full sets.
4. Components by large-star and small-star. In buckets that still hold several
   components, the members outside the pivot's component (the strays) are tried against
   all members of other components, on signatures and then on the full sets, within blocks
   of bounded size, so no link is lost to the star and no pair that is not linked ever becomes
   a row; members that are no strays only meet blocks of strays. The components are then joined.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as w
from ._common import arrow_map, drop_stored, grouped, pick, pieces, store, table, text_buffers
from .components import connected_components

SHINGLE = 5
PERCENT = 75
MINIMA = 128
BANDS = 32
#: A signature agreeing in fewer than this many of 128 places stems from a pair of
#: similarity 0.75 with probability under 1e-4 (4 deviations); such pairs go.
LEAST_AGREEING = 76
#: Members of one bucket that are compared with one another in one task, and the shingles
#: that they may have together (8 bytes each).
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
#: So many ids (8 bytes each) are broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 400_000
#: So many buckets with the numbers of their blocks that have strays are broadcast at most.
BROADCAST_BUCKETS = 50_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def shingle_sets(batch: pa.RecordBatch, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    data, at, _ = text_buffers(batch.column(batch.schema.get_field_index("text")))
    starts, ends, of = w.spans(data, at, w.SPACES)
    h = w.word_hashes(data, starts, ends, w.LOWER)
    g = w.grams(h, shingle)
    out = []
    for lo, hi in zip(of[:-1], of[1:], strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(g[lo : hi - shingle + 1]))
        elif hi > lo:  # fewer words: the whole sequence is the one shingle
            out.append(w.mix(w.grams(h[lo:hi], int(hi - lo)) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each non-empty set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests of each set, whatever the order in it."""
    both = [[w.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(w.mix(s + np.uint64(0x1234567)), initial=np.uint64(0))] for s in sets]
    return np.array(both, np.uint64).reshape(len(sets), 2).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_sets(batch)
        own = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        n = np.array([len(s) for s in sets], np.int64)
        h = digests(sets)
        some = np.flatnonzero(n)
        sig = np.zeros((len(sets), MINIMA), np.uint32)
        if len(some):
            sig[some] = signatures([sets[i] for i in some])
        rows = MINIMA // BANDS
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for k in range(rows):
            keys = keys * np.uint64(0xD1342543DE82EF95) + sig[:, k::rows].astype(np.uint64)
        keys = w.mix(keys).view(np.int64)
        short = (sig >> 16).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in own],
                pa.array(n),
                pa.array(h[:, 0]),
                pa.array(h[:, 1]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                pa.array([r.tobytes() for r in short], pa.binary()),
            ],
            names=[*[batch.schema.names[i] for i in own], "n_shingles", "h1", "h2", "bands", "sig"],
        )


_SIGNED = "doc_id long, version long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        if len(x):
            a, b = (np.frombuffer(b"".join(x[c]), np.uint16).reshape(len(x), MINIMA) for c in ("sig_a", "sig_b"))
            yield x.loc[(a == b).sum(1) >= LEAST_AGREEING, ["a", "b"]]


class _Block:
    """The members of a block pair: which of them are still to be compared."""

    def __init__(self, x: pa.RecordBatch):
        col = {n: x.column(i) for i, n in enumerate(x.schema.names)}
        self.sig = np.frombuffer(b"".join(col["sig"].to_pylist()), np.uint16).reshape(x.num_rows, MINIMA)
        self.ids, self.comp, self.blk, self.n, self.stray = (col[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "blk", "n_shingles", "stray"))
        self.same_block = col["lo"][0].as_py() == col["hi"][0].as_py()
        self.band = col["band"][0].as_py()
        self.keys = col["bands"].flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, BANDS)

    def near(self):
        """(i, partners j): pairs across components whose signatures agree enough; a
        pair that several buckets hold comes with the first band whose bucket it shares
        (cut minima also agree where the buckets differ, so they can't tell which one)."""
        for i in np.flatnonzero(self.stray):
            ok = (self.comp != self.comp[i]) & (self.same_block | (self.blk != self.blk[i])) & (~self.stray | (self.ids > self.ids[i]))
            ok &= 100 * np.minimum(self.n, self.n[i]) >= PERCENT * np.maximum(self.n, self.n[i])
            j = np.flatnonzero(ok)
            if len(j):
                j = j[(self.sig[j] == self.sig[i]).sum(1) >= LEAST_AGREEING]
                if len(j):
                    j = j[(self.keys[j] == self.keys[i]).argmax(1) == self.band]
                    if len(j):
                        yield i, j


def _hopeful(x: pa.RecordBatch) -> pa.RecordBatch | None:
    """The members of a block pair that some pair still needs."""
    used = np.zeros(x.num_rows, bool)
    for i, j in _Block(x).near():
        used[i] = True
        used[j] = True
    return x.filter(pa.array(used)) if used.any() else None


def _linked(x: pa.RecordBatch) -> pa.RecordBatch | None:
    """The pairs of a block pair whose full sets are similar enough."""
    sets = x.column(x.schema.get_field_index("shingles"))
    at = np.asarray(sets.offsets).astype(np.int64)
    _, word = np.unique(np.asarray(sets.values)[at[0] : at[-1]], return_inverse=True)
    at = at - at[0]
    block, mark, found = _Block(x), np.zeros(word.max(initial=0) + 2, np.int64), []
    for i, j in block.near():
        mine = word[at[i] : at[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[word], at[:-1])[j]
        mark[mine] = 0
        ok = 100 * both >= PERCENT * (block.n[i] + block.n[j] - both)
        found += [(block.ids[i], block.ids[k]) for k in j[ok]]
    if not found:
        return None
    pairs = np.array(found, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_sets(batch)
        at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "shingles"])


def sets_of(texts: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """``node, shingles`` of ``nodes (node, doc_id, version)``, stored; ``texts (doc_id, version, text)``
    has the text of each, several times if ``repeated``."""
    nodes = store(nodes.select("node", "doc_id", "version").distinct(), "candidates", slim=True)
    found = texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, ["doc_id", "version"])
    found = found.select("node", "text")
    sets = arrow_map(found.groupBy("node").agg(F.first("text").alias("text")) if repeated else found, _sets, "node long, shingles array<long>")
    return store(sets, "sets")


def confirm(texts: DataFrame, reps: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """Those of ``pairs (a, b)`` of nodes whose full shingle sets are similar enough."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(texts, reps.join(some, "node"), repeated)
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    x = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return x.where(100 * F.col("both") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")


def _limited(x: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    return x.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)


def _graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their class ``node``, links between nodes, links between the nodes of one doc_id).

    A node is a set of shingles. Its number is the smallest doc_id that has it, so nodes with
    smaller numbers have smaller ids; only where ids come back with other texts, the further
    nodes of an id have negative numbers of their own, so that texts are never mistaken."""
    texts = _texts(docs)
    signed = store(arrow_map(texts, _sign, _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    rest = F.struct("doc_id", "version", "n_shingles", "bands", "sig")
    classes = some.groupBy("h1", "h2").agg(F.min_by(rest, F.struct("doc_id", "version")).alias("r")).select("h1", "h2", "r.*")
    by_id = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[f(F.struct("h1", "h2")).alias(c) for f, c in ((F.min, "x"), (F.max, "y"))]).where("n > 1")
    by_id = store(by_id.select("doc_id", F.col("x.h1").alias("x1"), F.col("x.h2").alias("x2"), (F.col("x") != F.col("y")).alias("apart")), "repeated-ids", slim=True)
    several = by_id.where("apart").drop("apart")
    repeated, again = not by_id.isEmpty(), not several.isEmpty()
    if again:
        own = F.col("x1").isNull() | ((F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")))
        number = F.xxhash64("h1", "h2").bitwiseOR(F.lit(-(1 << 63)))
        classes = _limited(classes, several, ["doc_id"], "left").withColumn("node", F.when(own, F.col("doc_id")).otherwise(number)).drop("x1", "x2")
    else:
        classes = classes.withColumn("node", F.col("doc_id"))
    classes = store(classes, "classes")
    reps = classes.select("node", "doc_id", "version", "n_shingles", "bands", "sig")
    banded = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    shared = store(shared.where("members > 1"), "buckets")
    member = store(banded.drop("n_shingles").join(shared, ["band", "key"]), "members")
    star = member.where("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    tried = store(_similar(star, reps), "stars-tried")
    links = store(confirm(texts, reps, tried, repeated), "links", slim=True)
    comp = store(connected_components(links), "components", slim=True)
    drop_stored(tried)

    # What the stars can't have seen: pairs across components within a bucket.
    named = member.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = named.where("node = pivot").select("band", "key", F.col("component").alias("main"))
    mixed = named.groupBy("band", "key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band", "key")
    top = store(top.join(mixed, ["band", "key"]).distinct(), "mixed", slim=True)
    named = named.join(top, ["band", "key"]).withColumn("stray", F.col("component") != F.col("main"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    named = named.withColumn("parts", parts).withColumn("blk", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    named = store(named.select("band", "key", "node", "component", "stray", "parts", "blk"), "named")
    strays = named.where("stray").groupBy("band", "key").agg(F.collect_set("blk").alias("astray"))  # a number for each block with one
    strays = store(strays, "strays", slim=True)
    named = named.join(F.broadcast(strays) if strays.count() <= BROADCAST_BUCKETS else strays, ["band", "key"])
    meets = F.when(F.array_contains("astray", F.col("blk")), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.col("astray"))
    named = named.withColumn("other", F.explode(meets))
    named = named.select("band", "key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "node", "component", "stray")
    named = named.join(reps.select("node", "n_shingles", "bands", "sig"), "node")
    named = named.select("band", "key", "lo", "hi", "blk", F.col("node").alias("doc_id"), "component", "stray", "n_shingles", "bands", "sig")
    block = ["key", "band", "lo", "hi"]
    hopeful = store(grouped(named, block, _hopeful, named.schema), "hopeful")
    sets = sets_of(texts, reps.join(hopeful.select(F.col("doc_id").alias("node")).distinct(), "node"), repeated)
    more = store(grouped(hopeful.join(sets.withColumnRenamed("node", "doc_id"), "doc_id"), block, _linked, "a long, b long").distinct(), "links-across", slim=True)

    rows = signed.select("doc_id", "version", "n_shingles", "h1", "h2").join(classes.select("h1", "h2", "node", F.col("doc_id").alias("node_doc")), ["h1", "h2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = rows.select("doc_id", "version", "n_shingles", *[F.when(linked, F.col(c)).alias(c) for c in ("node", "node_doc")])
    if again:
        rows = store(rows, "rows")
        one = rows.join(several.select("doc_id"), "doc_id", "left_semi")
        one = one.join(one.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    else:
        one = links.limit(0)
    return rows, links.unionByName(more), one


def _components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``: the smallest doc_id of their component, or their own."""
    comp = store(connected_components(links), "components", slim=True)
    out = rows.join(comp, "node", "left")
    if comp.where("node < 0").isEmpty():  # numbers are ids, in their order
        return out.withColumn("component_id", F.coalesce("component", "node_doc", "doc_id"))
    named = rows.select("node", "node_doc").distinct().join(comp, "node")
    least = store(named.groupBy("component").agg(F.min("node_doc").alias("least")), "least", slim=True)
    return out.join(least, "component", "left").withColumn("component_id", F.coalesce("least", "node_doc", "doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Texts that are null, empty or without words have no shingles and no link and
    are kept. A null doc_id is linked with nothing and kept, its component_id is
    null. Rows that share a doc_id are one document in the graph, so all their texts'
    links meet in it (and each row has the size of its own set). Equal texts are
    always linked; ties fall to the smallest doc_id. Other columns are not read."""
    rows, links, one = _graph(docs)
    out = _components(rows, links.unionByName(one))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _similar(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    a, b = (reps.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    x = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return x.select("a", "b", "sig_a", "sig_b").mapInPandas(_agree, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, without those whose text has a near copy that stays.

    Of each group of linked texts the rows of the smallest doc_id stay. Rows go one by
    one: if an id comes back with another text, that row stays unless its own text has a copy
    elsewhere, so no text is lost with another one's copy. Rows without an id stay."""
    rows, links, _ = _graph(docs)
    lost = _components(rows, links).where("doc_id != component_id").select("doc_id", F.col("version").alias("_version")).distinct()
    lost = store(lost, "near-copies", slim=True)
    x = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_version"))
    return _limited(x, lost, ["doc_id", "_version"], "left_anti").select("_row.*")


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
