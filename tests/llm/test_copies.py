"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import minhash, substring
from corpusforge.llm import _words as w
from corpusforge.llm.components import connected_components

WORDS = r"[^\x20\x09-\x0D]+"


def texts(seed=1):
    """Documents with exact and near copies, shared passages, short, empty and odd texts."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "ö", "X")]
    fresh = lambda n: [r.choice(words) + str(r.randrange(40)) for _ in range(n)]
    out = [" ".join(fresh(r.randrange(1, 180))) for _ in range(60)]
    passage = fresh(70)
    for _ in range(8):
        out.append(" ".join(fresh(20) + passage[r.randrange(15) :] + fresh(30)))
    base = fresh(150)
    for k in range(40):  # near copies of every similarity around the threshold
        x = list(base)
        for _ in range(k // 4):
            x[r.randrange(len(x))] = r.choice(words)
        out.append((" " if k % 2 else "\n\t").join(x))
    out += [out[3]] * 5 + [" ".join(fresh(12) * 40)] * 2
    out += ["", " \t\n", None, "one", "ONE", "one two three four", "One two\x0bthree  four", "a" * 50_000, "x " * 3000, "é" * 7]
    order = list(range(len(out)))
    r.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    ws = re.findall(WORDS, lowered(t or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in rows]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = texts()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(rows)


def test_star_does_not_lose_links_between_members(spark):
    """Two texts similar to each other, and to the bucket's smallest member less than enough."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(30):
        x = list(base)
        for p in range(k * 4, k * 4 + 4):
            x[(p * 7) % 300] = f"n{k}-{p}"
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(x[:-1]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(rows)


def test_pairs_of_long_texts_in_shared_buckets_come_once():
    """Minima of long texts are small, so their upper halves agree in bands whose buckets differ; each
    similar pair must come from just one of the buckets that it shares."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**7)}" for _ in range(25_000)]
    rows = [" ".join(base)]
    for _ in range(14):
        x = list(base)
        for p in r.sample(range(25_000), 650):
            x[p] = f"n{r.randrange(10**9)}"
        rows.append(" ".join(x))
    ids = pa.array(range(len(rows)), pa.int64())
    signed = pa.Table.from_batches(minhash._sign([pa.RecordBatch.from_arrays([ids, pa.array(rows)], names=["doc_id", "text"])])).combine_chunks()
    sets = [set(s.tolist()) for s in minhash.shingle_sets(pa.RecordBatch.from_arrays([ids, pa.array(rows)], names=["doc_id", "text"]))]
    keys = np.array(signed["bands"].to_pylist())
    buckets = {(band, k): np.flatnonzero(keys[:, band] == k) for band in range(minhash.BANDS) for k in keys[:, band]}
    got = []
    for (band, _), at in buckets.items():
        n, x = len(at), signed.take(pa.array(at))
        col = {"doc_id": x["doc_id"], "n_shingles": x["n_shingles"], "bands": x["bands"], "sig": x["sig"], "component": x["doc_id"], "stray": [True] * n, "shingles": [sorted(v - (1 << 64) if v >> 63 else v for v in sets[i]) for i in at]}
        col |= {c: pa.array([v] * n, pa.int32()) for c, v in (("band", band), ("lo", 0), ("hi", 0), ("blk", 0))}
        found = minhash._linked(pa.table(col).combine_chunks().to_batches()[0])
        got += [] if found is None else zip(found["b"].to_pylist(), found["a"].to_pylist(), strict=True)
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    alike = ((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near(i, j) and (keys[i] == keys[j]).any() and (np.frombuffer(signed["sig"][i].as_py(), np.uint16) == np.frombuffer(signed["sig"][j].as_py(), np.uint16)).sum() >= minhash.LEAST_AGREEING)
    assert len(got) > 10 and sorted(got) == sorted(alike)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A b  c d e f"), (8, None)], "doc_id long, text string")
    df = df.withColumns({"sig": F.lit(1), "bands": F.lit("x"), "h1": F.lit(2), "component_id": F.lit(3), "kept": F.lit(None)})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 2 + [(7, 5, False), (8, 8, True)], key=str)
    assert [r.doc_id for r in minhash.keep_first(df.where("doc_id > 5")).orderBy("doc_id").collect()] == [7, 8]
    assert minhash.keep_first(df).columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (7, 6), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        ws = re.findall(WORDS, t or "")
        gone = set()
        for p in range(len(ws) - 49):
            if first.setdefault(tuple(ws[p : p + 50]), i) < i:
                gone.update(range(p, p + 50))
        out[i] = (len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats_match_brute_force(spark, batches):
    rows = texts(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, batches).collect()}
    want = brute_repeats(rows)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10


def test_repeat_spans_name_the_removed_words(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage, "y"])), (3, " ".join(passage[:49]))]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got[2].kept_text == "x y" and [(s.first_word, s.end_word) for s in got[2].removed] == [(1, 61)]
    assert got[1].n_removed == got[3].n_removed == 0


def test_repeats_edges(spark):
    t = " ".join(f"q{i}" for i in range(55))
    df = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (4, t + " z"), (9, t + " more"), (10, None), (11, "")], "doc_id long, text string")
    df = df.withColumns({"places": F.lit(1), "version": F.lit("v"), "doc": F.lit(0), "anchor": F.lit(0)})
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df, 2).collect()), key=str)
    assert got == sorted([(None, 55, 55)] * 2 + [(4, 55, 0)] * 2 + [(4, 56, 0), (9, 56, 55), (10, 0, 0), (11, 0, 0)], key=str)
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_query_digest(spark):
    rows = [(1, " a  b\nc "), (2, None)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1).select("doc_id", F.sha2("kept_text", 256).alias("d")).collect()
    assert {r.doc_id: r.d for r in out} == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_word_kernels():
    raw = "ab  cd\x0bé x".encode() + b"yz a"
    at = np.array([0, 11, len(raw)])
    starts, ends, of = w.spans(np.frombuffer(raw, np.uint8), at, w.SPACES)
    assert [raw[a:b] for a, b in zip(starts, ends)] == [b"ab", b"cd", "é".encode(), b"x", b"yz", b"a"] and of.tolist() == [0, 4, 6]
    h = w.word_hashes(np.frombuffer(b"ab AB ab", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]), w.LOWER)
    assert h[0] == h[1] == h[2]
    x = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    assert (w.sliding_min(x, 26) == np.array([x[i : i + 26].min() for i in range(175)])).all()
    for k in (5, 25, 50):  # equal sequences have equal hashes wherever they stand
        y = np.concatenate([x, x[:60], x])
        g = w.grams(y, k)
        assert (g[: 200 - k] == g[260 : 460 - k]).all() and len(set(g[: 200 - k].tolist())) == 200 - k


def test_rows_of_one_id_with_several_texts(spark):
    x, y, z = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda rows: sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df(rows)).collect())
    stay = lambda rows: sorted(tuple(r) for r in minhash.keep_first(df(rows)).collect())
    rows = [(3, x), (5, x), (5, y), (7, y)]
    assert groups(rows) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False)]
    assert stay(rows) == [(3, x), (5, y)]
    rows = [(5, x), (5, y), (5, y), (6, y), (2, x), (9, z), (9, z)]
    assert groups(rows) == [(2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (6, 2, False), (9, 9, True), (9, 9, True)]
    assert stay(rows) == [(2, x), (5, y), (5, y), (9, z), (9, z)]
    odd = df(rows).withColumns({"_version": F.lit(1), "_row": F.lit("r"), "node": F.lit(2)})
    assert minhash.keep_first(odd).columns == odd.columns and minhash.keep_first(odd).where("_version = 1").count() == 5


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    """Thue-Morse words of 2,048 letters have equal polynomial hashes modulo 2**64 for any base."""
    p, q = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    got = minhash.near_duplicates(spark.createDataFrame([(1, p), (2, q), (3, p)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*same, p])), (2, " ".join([*same, q])), (3, " ".join(["z", *same, p]))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 50}
    a, b = (np.array(list(thue_morse(32, *t)), "S1").view(np.uint8) for t in ("ab", "ba"))
    h = [w.grams(w.word_hashes(x, np.arange(32), np.arange(1, 33)), 32) for x in (a, b)]
    assert (h[0] ^ h[1]) & np.uint64(0xFFFF)


def test_the_largest_id_is_not_a_null(spark):
    t = " ".join(f"q{i}" for i in range(55))
    df = spark.createDataFrame([(None, t), (2**63 - 1, "a"), (3, t)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in substring.remove_repeats(df, 1).collect()), key=str) == sorted([(None, 55), (2**63 - 1, 0), (3, 0)], key=str)
