"""Operators on large dictionaries, near spans and many candidates, against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.udfs import indel_similarity
from corpusforge.operators import annotate, evaluate, link, retrieval

ENTRIES = "id string, label string, aliases array<string>, type string, ord long"


def brute_hits(text, surfaces):
    low, out = annotate.lowered(text), set()
    for s in surfaces:
        a = low.find(s)
        while a >= 0:
            b = a + len(s)
            if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                out.add((s, a, b))
            a = low.find(s, a + 1)
    return out


def test_the_trie_finds_what_a_search_for_each_surface_finds():
    r = random.Random(5)
    words = ["a", "ab", "of", "the", "x-ray", "2", "é", "st.", "(1)", "o'k", "_", "ß"]
    surfaces = sorted({r.choice(["", "(", "- "]) + r.choice([" ", "-", "  ", ""]).join(r.choices(words, k=r.randrange(1, 5))) + r.choice(["", ")", "."]) for _ in range(600)} - {""})
    known = annotate.Dictionary([(s.lower(), "t", s, i) for i, s in enumerate(surfaces)])
    for _ in range(300):
        text = r.choice(["", " "]).join(r.choices([*words, "(", ")", ". ", "- ", "AB", "The", "İ", "\n"], k=r.randrange(1, 40)))
        assert {h[:3] for h in known.hits(text)} == brute_hits(text, {s.lower() for s in surfaces})


def test_three_hundred_thousand_surfaces_in_one_pass(spark):
    index = spark.range(300_000).select(F.format_string("university of place%s", "id").alias("surface"), F.col("id")).select(F.col("surface").alias("surface_lc"), "surface", F.format_string("u%s", "id").alias("canonical_id"), F.lit("entity").alias("type"), F.col("id").alias("ord"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.format_string("The University of Place%s and university of place%s, not university of placex%s", F.col("id") * 700, F.col("id"), "id").alias("text"))
    x = annotate.annotate(docs, index)
    assert x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: [s.canonical_id for s in r.spans] for r in x.collect()}
    assert got == {i: [f"u{700 * i}", f"u{i}"] if 700 * i < 300_000 else [f"u{i}"] for i in range(400)}


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_fuzzy_links_lose_none(spark, least):
    r = random.Random(int(least * 100))
    base = ["".join(r.choices("abcde -", k=r.randrange(1, 25))).strip() or "z" for _ in range(150)]

    def changed(s):
        s = list(s)
        for _ in range(r.randrange(0, 5)):
            i = r.randrange(len(s) + 1)
            s[i : i + r.randrange(2)] = r.choice(["", "x", "a", "é"])
        return "".join(s)

    entries = [(f"e{i}", s, [changed(s)], r.choice(["t", "u"]), i) for i, s in enumerate(base)] + [("aa", "aaaaaaaa", None, "t", 900), ("b", "ab" * 12, None, "t", 901)]
    spans = [(i, changed(r.choice(base)), r.choice(["t", "u"])) for i in range(250)] + [(900, "aaaaaaa", "t"), (901, "", "t"), (902, "ba" * 12, "t"), (903, "aaaaaaaab", "t")]
    index = link.linking_index(spark.createDataFrame(entries, ENTRIES))
    got = {x.span_id: x.canonical_id for x in link.link_fuzzy(spark.createDataFrame(spans, "span_id long, surface string, type string"), index, least).collect()}
    known = {}
    for x in sorted(index.collect(), key=lambda x: x.ord):
        known.setdefault((x.surface_lc, x.type), (x.ord, x.canonical_id))
    want = {}
    for i, s, t in spans:
        scored = [(-round(indel_similarity(s.lower(), b), 9), o, c) for (b, kind), (o, c) in known.items() if kind == t]
        best = min(scored)
        if -best[0] >= least:
            want[i] = best[2]
    assert {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)} == {} and len(want) > 80


def test_no_letter_pair_is_a_hot_key(spark):
    """Names that all share their ending meet on what is rare in them."""
    index = spark.range(3000).select(F.format_string("%s institute", F.substring(F.md5(F.col("id").cast("string")), 1, 20)).alias("b"), F.lit("t").alias("type"))
    letters = index.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("b") + 1), lambda i: F.substring(F.concat(F.lit("^"), "b", F.lit("$")), i, F.lit(2)))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    keys = link._rarest_pairs(index, "b", "a", letters, 0.85).groupBy("type", "na", "nb", "g").count().agg(F.max("count")).first()[0]
    assert keys < 0.1 * 3000


def test_partial_matches_of_nested_and_crossing_spans(spark):
    r = random.Random(9)
    kind = "doc_id long, ord int, start int, end int, type string"

    def spans(n):
        out = []
        for doc in range(6):
            for i in range(n):
                a, size = r.randrange(0, 60), r.choice([1, 2, 3, 8, 20, 40])
                out.append((doc, i, a, a + size, r.choice("xy")))
        return out + [(7, 0, 5, 5, "x"), (8, 0, 0, 1000, "x"), (8, 1, 0, 500, "x"), (8, 2, 500, 1000, "x")]

    pred, gold = spans(25), spans(30)
    for least in (0.5, 0.3, 0.9):
        pairs = {}
        for d, p, a, b, t in pred:
            for e, g, c, f, u in gold:
                i = min(b, f) - max(a, c)
                if d == e and t == u and i > 0 and i / (b - a + f - c - i) >= least:
                    pairs[d, t, p, g] = round(i / (b - a + f - c - i), 6)
        p, g = spark.createDataFrame(pred, kind), spark.createDataFrame(gold, kind)
        assert {(x.doc_id, x.type, x.p_ord, x.g_ord): x.iou for x in evaluate.overlaps(p, g, least).collect()} == pairs
        want, taken = set(), set()
        for d, _, i, j in sorted(pairs, key=lambda k: (k[0], k[2], k[3])):
            if ("p", d, i) not in taken and ("g", d, j) not in taken:
                taken |= {("p", d, i), ("g", d, j)}
                want.add((d, i, j))
        got = {tuple(x) for x in evaluate.partial_matches(p, g, least).collect()}
        assert got == want and (least > 0.5 or any(i != min(k[3] for k in pairs if k[0] == d and k[2] == i) and j != min(k[3] for k in pairs if k[0] == d and k[2] == i) for d, i, j in want))


def test_pairs_of_one_crowded_document_stay_few(spark):
    n = 4000
    spans = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 8).cast("int").alias("end"), F.lit("t").alias("type"))
    x = evaluate.overlaps(spans, spans)
    assert x.count() == n and evaluate.partial_matches(spans, spans).count() == n


def test_embedding_links_equal_a_loop(spark):
    r = np.random.default_rng(4)
    vec = lambda n=8: [float(v) for v in r.standard_normal(n)]
    entries = [(f"c{i}", "tu"[i % 2], vec(), i) for i in range(120)]
    entries += [("same", "t", entries[4][2], 500), ("none", "t", None, 501), ("zero", "t", [0.0] * 8, 502), ("short", "t", [1.0, 2.0], 503), ("odd", None, vec(), 504)]
    spans = [(i, "tuv"[i % 3], vec()) for i in range(90)] + [(900, "t", entries[4][2]), (901, "t", None), (902, "t", [0.0] * 8), (903, "t", [2.0, 4.0]), (904, None, vec()), (905, "t", [None] * 8)]
    want = {}
    for i, t, v in spans:
        best = None
        for c, u, e, o in entries:
            if t == u and v and e and len(v) == len(e) and None not in v and any(v) and any(e):
                s = np.floor(float(np.dot(v, e)) / (np.linalg.norm(v) * np.linalg.norm(e)) * 1e6 + 0.5) / 1e6
                if s >= 0.3 and (best is None or (-s, o) < best[:2]):
                    best = (-s, o, c)
        if best:
            want[i] = (best[2], round(-best[0], 6))
    for block in (10_000, 17):
        got = {x.span_id: (x.canonical_id, round(x.confidence, 6)) for x in link.link_embedding(spark.createDataFrame(spans, "span_id long, type string, embedding array<double>"), spark.createDataFrame(entries, "canonical_id string, type string, embedding array<double>, ord int"), 0.3, block).collect()}
        want.pop(904, None)
        assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - v[1]) < 2e-6 for k, v in want.items())
    assert got[900][0] == "c4" and got[903][0] == "short"


@pytest.mark.parametrize("ids", ["long", "string"])
def test_bm25_by_matrices_equals_bm25_by_joins(spark, monkeypatch, ids):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "of"]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(62)], k=r.randrange(0, 40)))) for i in range(300)] + [(i, "same words here w1") for i in range(400, 430)] + [(None, "w1 w2 w3"), (900, None), (901, "")]
    queries = [(f"q{i}", " ".join(r.choices(words, k=r.randrange(1, 6)))) for i in range(25)] + [("none", "zzz"), ("empty", ""), ("null", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").select(F.col("doc_id").cast(ids), "text")
    q = spark.createDataFrame(queries, "query_id string, text string")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SCORED_AT_ONCE", 1000)
    got = sorted(tuple(x) for x in retrieval.bm25(q, d, 4).collect())
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    want = sorted(tuple(x) for x in retrieval.bm25(q, d, 4).collect())
    assert got == want and len({x[0] for x in got}) >= 20
    assert retrieval.bm25(q, d.limit(0), 4).collect() == [] and retrieval.bm25(q.limit(0), d, 4).collect() == []


def test_orders_of_entries_with_many_aliases_stay_apart(spark):
    entries = [("a", "first", [f"a{i}" for i in range(2500)], "t", 1), ("b", "a2400", None, "t", 2)]
    index = link.linking_index(spark.createDataFrame(entries, ENTRIES))
    got = link.link_exact(spark.createDataFrame([(1, "A2400", "t")], "span_id long, surface string, type string"), index).first()
    assert got.canonical_id == "a" and re.fullmatch("exact", got.match_type)
