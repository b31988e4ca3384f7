"""BM25 retrieval: sums of weights over batches of documents, and the k best of each task before any shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ._stored import store

K1, B = 1.5, 0.75
#: Query tokens that every task holds at most; beyond, they are joined with the documents'.
BROADCAST_ROWS = 500_000
#: Queries that are scored together, and weights that a task adds up at once.
QUERY_BLOCK = 512
SCORED_AT_ONCE = 2_000_000


def token_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One row per distinct token: ``id, token, n_tokens``.

    The outer explode keeps the optimizer from repeating the tokens in a filter on
    their number, which would make them twice."""
    x = df.select(F.col(id_col).alias("id"), tokens(text).alias("ts"))
    return x.select("id", F.size("ts").alias("n_tokens"), F.explode_outer("ts").alias("token")).where("token is not null")


def document_frequency(rows: DataFrame) -> DataFrame:
    """``token, df``."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(df: DataFrame, text: Column) -> DataFrame:
    """One row ``n_docs, avg_tokens`` over all documents, also those without tokens."""
    return df.select(F.size(tokens(text)).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_tokens"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best documents of each query: ``query_id, rank, doc_id, score``.

    ``queries (query_id, text)``, ``docs (doc_id, text)``. A token counts once in a
    document; ties go to the smaller doc_id; only positive scores are ranked. Documents are tokenised
    once: the query tokens of each are written as their numbers, beside its length.
    Queries are then scored in blocks: a task holds the idf of a block's tokens by query as a matrix, adds up its
    rows for the tokens of each document and keeps ``k`` documents for each query, so what is shuffled are
    ``k`` rows a query and task, whatever a token's frequency. Too many query tokens to be held
    are joined instead. Documents without an id count in the corpus and aren't ranked."""
    wanted = store(token_rows(queries, "query_id", F.col("text")).select(F.col("id").alias("query_id"), "token"), "query-tokens")
    if wanted.count() > BROADCAST_ROWS:
        return _joined(wanted, docs, k)
    vocabulary, kind = sorted(r[0] for r in wanted.select("token").distinct().collect()), docs.schema["doc_id"].dataType.simpleString()
    have = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    have = store(have.mapInArrow(_numbered(vocabulary), f"doc_id {kind}, n_tokens int, ts array<int>"), "postings")
    df = {r["t"]: r["n"] for r in have.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs, avg_tokens = have.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
    avg_tokens = max(avg_tokens or 0.0, 1.0)
    place = {t: i for i, t in enumerate(vocabulary)}
    by_query: dict = {}
    for r in wanted.collect():
        by_query.setdefault(r["query_id"], []).append(place[r["token"]])
    names, out = sorted(by_query), None
    for at in range(0, len(names), QUERY_BLOCK):
        mine = names[at : at + QUERY_BLOCK]
        used = sorted({t for q in mine for t in by_query[q] if t in df})
        if not used:
            continue
        column = {t: i for i, t in enumerate(used)}
        weight = np.zeros((len(used), len(mine)))
        for j, q in enumerate(mine):
            for t in by_query[q]:
                if t in df:
                    weight[column[t], j] = math.log((n_docs - df[t] + 0.5) / (df[t] + 0.5) + 1)
        number = np.full(len(vocabulary), -1, np.int32)
        number[used] = np.arange(len(used))
        part = have.mapInArrow(_scorer(number, weight, avg_tokens, k), f"q int, doc_id {kind}, score double")
        part = part.join(F.broadcast(_named(queries, mine)), "q")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, doc_id {kind}, score double")
    top = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def _named(queries: DataFrame, ids: list) -> DataFrame:
    """``q, query_id`` of the queries of a block."""
    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind}")


def _numbered(vocabulary: list[str]):
    """Which of the vocabulary a document's tokens are, and how many it has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column(1)
            known_sizes = lists.value_lengths()  # null for a null text, which has no part in the mean
            sizes = np.asarray(known_sizes.fill_null(0))
            found = pc.index_in(lists.flatten().cast(pa.string()), known)
            row = np.repeat(np.arange(batch.num_rows), sizes)[np.asarray(found.is_valid())]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), known_sizes.cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), found.drop_null().cast(pa.int32()))], names=["doc_id", "n_tokens", "ts"])

    return run


def _scorer(number: np.ndarray, weight: np.ndarray, avg_tokens: float, k: int):
    """The ``k`` best documents of a task for each query of a block."""
    n = weight.shape[1]
    most = max(1, SCORED_AT_ONCE // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names, kind = np.zeros((n, 0)), None, None
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            kind = batch.column(0).type
            ids, sizes, lists = np.array(batch.column(0).to_pylist()), np.asarray(batch.column(1).fill_null(0)), batch.column(2)
            term = number[np.asarray(lists.flatten())]
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))[term >= 0]
            term = term[term >= 0]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            at = 0
            while at < len(first):  # documents with about ``most`` tokens of the block
                end = max(at + 1, int(np.searchsorted(first, first[at] + most)))
                lo, hi = first[at], first[end] if end < len(first) else len(row)
                docs = row[first[at:end]]
                score = np.add.reduceat(weight[term[lo:hi]], first[at:end] - lo) * ((K1 + 1) / (1 + K1 * (1 - B + B * sizes[docs] / avg_tokens)))[:, None]
                mine = np.broadcast_to(ids[docs], (n, len(docs)))
                best, names = np.concatenate([best, score.T], 1), mine if names is None else np.concatenate([names, mine], 1)
                # As ranks go: by the score to six places, then by id.
                order = np.lexsort((names, -np.floor(best * 1e6 + 0.5)))[:, :k]
                best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
                at = end
        q, j = np.nonzero(best > 0)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(names[q, j].tolist(), kind), pa.array(best[q, j])], names=["q", "doc_id", "score"])

    return run


def _joined(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``bm25`` by joins on tokens, for more query tokens than a task can hold."""
    have = store(docs.select("doc_id", tokens(F.col("text")).alias("ts")).withColumn("n_tokens", F.size("ts")), "tokens")
    n, avg = have.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
    n_docs, avg_tokens = F.lit(n), F.lit(max(avg or 0.0, 1.0))
    have = have.select("doc_id", "n_tokens", F.explode_outer("ts").alias("token"))
    have = store(have.join(wanted.select("token").distinct(), "token", "left_semi"), "postings")
    weighed = wanted.join(document_frequency(have), "token").select("query_id", "token", idf(n_docs, F.col("df")).alias("idf"))
    # A token counts once in a document, so a pair's score is the sum of its tokens' idf by the document's own length.
    norm = 1 + K1 * (1 - B + B * F.col("n_tokens") / avg_tokens)
    scored = have.join(weighed, "token").groupBy("query_id", "doc_id", "n_tokens").agg(F.sum("idf").alias("idf")).select("query_id", "doc_id", (F.col("idf") * (K1 + 1) / norm).alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    ranked = scored.where("score > 0 and doc_id is not null").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def boosts(intent: Column, feats: Column, category: Column) -> Column:
    """What matching features add to a score."""
    has = lambda c: F.size(intent[c]) > 0
    op = intent["operator"]
    out = F.when(op == feats["operator"], 5.0).when(F.array_contains(feats["operators"], op), 3.0).otherwise(0.0)
    out = out + F.when(has("authors") & feats["has_author"], 2.0).otherwise(0.0)
    out = out + F.when((intent["year_from"].isNotNull() | intent["year_to"].isNotNull()) & feats["has_year"], 1.5).otherwise(0.0)
    for mine, theirs in (("doctype", "doctypes"), ("property", "properties"), ("bibgroup", "bibgroups"), ("collection", "collections")):
        out = out + 1.5 * F.size(F.array_intersect(intent[mine], feats[theirs]))
    out = out + F.when(op.isNotNull() & category.isin("operator", "citations", "second_order"), 1.0).otherwise(0.0)
    out = out + F.when(has("authors") & category.isin("author", "first_author"), 1.0).otherwise(0.0)
    return out + F.when(has("property") & category.isin("property", "properties", "conversational"), 1.0).otherwise(0.0)
