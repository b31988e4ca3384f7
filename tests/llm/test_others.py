"""Archives, decontamination, sharding, mixing, exact search, and the pipeline."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import decontaminate, mixing, mtree, sharding, warc
from corpusforge.llm._common import shared_dir


def archived(spark, rows, **how):
    folder = shared_dir(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(df.withColumns({"digest": F.lit(1), "size": F.lit("s"), "first": F.lit(None)}), folder, **how)
    return folder, manifest, warc.read_archives(manifest, folder).collect()


def test_archives_round_trip(spark):
    r = random.Random(1)
    long = "é" * 60
    rows = [(i, f"http://x.org/{i}", "".join(r.choices("abc<>é ", k=r.randrange(400)))) for i in range(50)]
    rows += [(100, None, long), (90, "http://a b/\r\nX: y", long), (95, "u", long), (101, "u", None), (102, "u", ""), (103, "u", "short"), (104, "u", "short"), (None, "n", long), (105, "u", "z" * 3_000_000)]
    folder, manifest, got = archived(spark, rows, roll_bytes=2000)
    by = {x.page_id: x for x in got}
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == hashlib.sha256(raw).hexdigest()
        if by[i].record_type == "response":
            assert bytes(by[i].payload) == raw
    assert [(by[i].record_type, by[i].refers_to) for i in (90, 95, 100, None, 103, 104)] == [("response", None), ("revisit", 90), ("revisit", 90), ("revisit", 90), ("response", None), ("response", None)]
    files = manifest.collect()
    assert len(files) > 4
    for f in files:
        path = folder.removeprefix("file://") + "/" + f.path
        raw = open(path, "rb").read()
        assert hashlib.sha256(raw).hexdigest() == f.sha256 and len(raw) == f.bytes
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == f.records


def test_archives_are_the_same_bytes_again(spark):
    rows = [(i, f"u{i}", "text " * i) for i in range(80)]
    a, b = (sorted(map(tuple, archived(spark, rows, roll_bytes=3000)[1].collect())) for _ in range(2))
    assert a == b


def test_archives_empty(spark):
    assert archived(spark, [])[2] == []


def test_cut_member_is_an_error():
    import io

    data = warc.gzip_member(b"x" * 100)
    assert list(warc.members(io.BytesIO(data * 2), 7)) == [b"x" * 100] * 2
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data + data[:-9])))


RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(t):
    return RX.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, bench):
    pats = {}
    for i, t in bench:
        ws = norm(t)
        k = min(10, len(ws))
        for p in range(len(ws) - k + 1 if k else 0):
            pats.setdefault(tuple(ws[p : p + k]), set()).add(str(i))
    out = {}
    for i, t in docs:
        ws, hit, items = norm(t), set(), set()
        for k in {len(p) for p in pats}:
            for p in range(len(ws) - k + 1):
                if found := pats.get(tuple(ws[p : p + k])):
                    hit.update(range(p, p + k))
                    items |= found
        out[i] = (len(ws), len(hit), sorted(items))
    return out


@pytest.mark.parametrize("block_bytes", [300_000, 200])
def test_decontamination_matches_brute_force(spark, block_bytes):
    r = random.Random(4)
    words = [a + b for a in "abcdé" for b in "xyz1Ü"]
    bench = [(i, " ".join(r.choices(words, k=r.randrange(1, 25)))) for i in range(2, 30)] + [(100, "xx"), (101, ""), (102, None), (103, "..."), (104, "aé bé")]
    docs = []
    for i in range(60):
        ws = r.choices(words, k=r.randrange(0, 60))
        if i % 3 == 0:
            src = (bench[i % 28][1] or "").split()
            ws[5:5] = src[r.randrange(3) :]
        docs.append((i, r.choice([" ", "-", ", ", "\n"]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in ws)))
    docs += [(70, None), (71, ""), (72, "!!"), (73, "xx " * 20_000), (74, "prexx xxpost")]
    got = decontaminate.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = brute_hits(docs, bench)
    assert {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in got} == want and sum(v[1] > 0 for v in want.values()) > 10
    text = dict(docs)
    for x in got:
        for s in x.spans:
            assert norm(text[x.doc_id].encode()[s.first_byte : s.end_byte].decode()) == norm(text[x.doc_id])[s.first_word : s.end_word]


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string").withColumns({"items": F.lit(1), "item_id": F.lit(2), "n_hit": F.lit("x")})
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in decontaminate.find_benchmark(docs, none).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(7, "A,b"), (7, "a b"), (None, "c")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert sorted(x.n_hit for x in decontaminate.find_benchmark(docs, one).collect()) == [0, 2, 2]
    left = decontaminate.keep_clean(docs, one)
    assert left.columns == docs.columns and [x.text for x in left.collect()] == ["c"]
    assert decontaminate.find_benchmark(docs.limit(0), one).collect() == []


def check_shards(rows, got, shards):
    n = len(rows)
    counts = np.bincount([x.shard for x in got], minlength=shards)
    assert counts.sum() == n and counts.max() - counts.min() <= 1
    for s in range(shards):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(counts[s]))
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size, x.text_crc32) for x in got) == want


def test_shards_are_balanced_and_gapless(spark):
    rows = [(i, f"text {i % 50}" * (i % 7)) for i in range(1003)] + [(None, None)] * 3 + [(5, "é")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("s"), "arc": F.lit(1), "key": F.lit(1), "rank": F.lit(2)})
    a = sharding.assign(df.repartition(5)).collect()
    check_shards(rows, a, 8)
    b = sharding.assign(df.repartition(2)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert sharding.assign(df.limit(0)).collect() == []


def test_ring_moves_little_when_a_shard_comes():
    r = random.Random(2)
    counts = {r.randrange(sharding.ARCS): r.randrange(1, 4) for _ in range(20_000)}

    def places(shards):
        out = {}
        for arc, lo, hi, s, _ in sharding.plan(counts, shards):
            out |= {(arc, k): s for k in range(lo, hi)}
        return out

    a, b = places(8), places(9)
    assert a.keys() == b.keys() == {(arc, k) for arc, n in counts.items() for k in range(n)}
    moved = np.mean([a[k] != b[k] for k in a])
    assert moved < 0.35  # dealing all rows anew would move eight ninths
    assert max(np.bincount(list(b.values()))) - min(np.bincount(list(b.values()))) <= 1


def test_ring_walks_clockwise_past_full_shards():
    at, whose = sharding.ring(4)
    arc = at[10]
    legs = sharding.plan({arc: 40}, 4)
    assert legs[0][3] == whose[10] and len({x[3] for x in legs}) == 4 and sum(x[2] - x[1] for x in legs) == 40


def documents(spark, n=900):
    r = random.Random(6)
    rows = [(i, " ".join(["wort"] * r.randrange(1, 40)) + (" | x" if i % 10 == 0 else ""), r.choices(["en", "de", None], [6, 3, 1])[0], "src0" if i % 3 == 0 else f"src{i % 7}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_raking_meets_its_marginals(spark):
    _, df = documents(spark)
    cells = mixing._classed(df).groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    got = mixing.rake(cells).collect()
    total = sum(x.tokens for x in got)
    for d in mixing.DIMENSIONS:
        share, weight = {}, {}
        for x in got:
            share[x[d]] = share.get(x[d], 0) + x.tokens / total
            weight[x[d]] = weight.get(x[d], 0) + x.weight
        t = {k: v ** mixing.TEMPER[d] for k, v in share.items()}
        for k in t:
            assert math.isclose(weight[k], t[k] / sum(t.values()), rel_tol=2e-3)
    assert max(x.prob for x in got) == pytest.approx(1.0)


def test_mixing_samples_by_its_probabilities(spark):
    rows, df = documents(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    kept, expected = sum(x.sampled for x in got), sum(x.prob for x in got)
    assert abs(kept - expected) < 4 * math.sqrt(len(rows)) / 2
    again = {x.doc_id: x.sampled for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.sampled for x in got}
    left = mixing.keep_mixed(df.withColumns({"weight": F.lit(1), "_topic": F.lit("t"), "prob": F.lit("p")}))
    assert left.columns == [*df.columns, "weight", "_topic", "prob"] and {x.doc_id for x in left.collect()} == {x.doc_id for x in got if x.sampled}


def test_mixing_edges(spark):
    kind = "doc_id long, text string, lang string, source string"
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", "s"), (1, "a b", "en", "s"), (2, "x" * 100_000, None, "s")], kind)
    got = mixing.mix(odd).collect()
    assert len(got) == 4 and all(0 < x.prob <= 1 for x in got) and {x.source for x in got} == {"(none)", "s"}
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []


def brute_top(rows, every, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(good) if m != n and len(c) == len(q))[:k]
            out.update((i, n + 1, j, -v) for n, (v, j) in enumerate(s))
    return out


@pytest.mark.parametrize("page, shard_rows, query_block", [(128, 10_000, 4096), (4, 70, 3)])
def test_exact_search_matches_brute_force(spark, monkeypatch, page, shard_rows, query_block):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "SHARD_ROWS", shard_rows)
    r = np.random.default_rng(3)
    centres = r.standard_normal((5, 16))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.1 * r.standard_normal(16)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(50, rows[50][1])] * 2 + [(50, rows[3][1]), (100, rows[4][1]), (8, rows[9][1])]
    rows += [(2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16), (2150, [float("inf")] * 16), (None, [1.0] * 16), (2200, [0.5] * 3), (2250, [0.25] * 3), (2300, []), (2350, [1e6] * 16), (2400, [-1e6] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "shard": F.lit("s"), "score": F.lit(0)})
    got = Counter(tuple(x) for x in mtree.top_k(df, F.col("vec_id") % 50 == 0, query_block=query_block).collect())
    assert got == brute_top(rows, 50)


def test_exact_search_keeps_rows_of_one_id(spark):
    rows = [(50, [2.0, 1.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.5, 0.0])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert [tuple(x) for x in got.orderBy("rank").collect()] == [(50, 1, 1, 393216), (50, 2, 1, 262144), (50, 3, 2, 196608)]


def test_exact_search_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).collect() == []
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], kind), F.col("vec_id") % 50 == 0).collect() == []
    huge = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [1.0, 1.0])]
    got = mtree.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(x) for x in sorted(got, key=lambda x: x["rank"])] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 256 * 256 * (3 * 10**9 + 1))]


def test_tree_passes_over_pages():
    r = np.random.default_rng(1)
    x = np.floor(256 * (r.standard_normal((40, 8)).repeat(100, 0) + 0.01 * r.standard_normal((4000, 8))))
    tree = mtree.MTree(np.arange(4000), x)
    seen = []
    plain = mtree.MTree.search
    q = x[5]
    rows = tree.rows
    tree.rows = [None if v is None else _Counted(v, seen) for v in rows]
    assert plain(tree, q, 5, 5) == [(s, i) for s, i in sorted(((int(v), i) for i, v in enumerate(x @ q) if i != 5), key=lambda p: (-p[0], p[1]))[:5]]
    assert len(seen) < sum(v is not None for v in rows)


class _Counted(tuple):
    def __new__(cls, v, seen):
        out = super().__new__(cls, v)
        out.seen = seen
        return out

    def __iter__(self):
        self.seen.append(1)
        return super().__iter__()


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        path = shared_dir(spark, "pipeline-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, last)) == sorted(map(str, whole)) and len(last) == n
    check_shards([(x.doc_id, x.text) for x in docs.collect()], last, 8)


def test_two_benchmarks_of_equal_texts_keep_their_own_items(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    for item in ("A", "B", "A"):
        bench = spark.createDataFrame([(item, "one two three")], "item_id string, text string")
        assert [list(x["items"]) for x in decontaminate.find_benchmark(docs, bench).collect()] == [[item]]


def test_decontamination_with_a_piece_that_all_items_share(spark):
    r = random.Random(8)
    stem = "what is the right answer".split()
    bench = [(i, " ".join([*stem, *r.choices("abcdefgh", k=r.randrange(0, 14))])) for i in range(300)]
    docs = [(i, " ".join([*r.choices("abcdefgh", k=3), *(stem + (bench[i * 3][1].split()[5:] if i % 2 else r.choices("abcdefgh", k=9))), *r.choices("abcdefgh", k=3)])) for i in range(60)]
    got = decontaminate.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in got} == brute_hits(docs, bench)


def test_exact_search_orders_scores_beyond_64_bits(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [2e20, 0.0]), (3, [-1e20, 5.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0])]
    got = mtree.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [4, 2, 1, 3, 5] and got[0].score == 2**63 - 1 and got[4].score == -(2**63)
    keys = [-(10**30), -257, -256, -255, -1, 0, 1, 255, 256, 10**30]
    assert sorted(keys, key=mtree.order_key) == keys


def test_exact_search_counts_what_it_passes_over(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 700)
    r = np.random.default_rng(6)
    centres = 3 * r.standard_normal((20, 6))
    rows = [(i, (centres[i % 20] + 0.01 * r.standard_normal(6)).tolist()) for i in range(2000)]
    got = mtree.counted_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert Counter((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_top(rows, 50)
    assert all(0 < x.distances < 2000 for x in got) and sum(x.avoided for x in got) > 0


def test_archives_depend_on_rows_alone(spark):
    """Borders of shards, files and digests don't depend on a sample, the layout or the session."""
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("text "), F.pmod(F.hash("id"), F.lit(60))).alias("html"))
    pages = pages.union(spark.range(3000).select(F.lit(10**15), F.lit("hot"), F.concat(F.lit("x"), F.col("id"))))
    manifests = []
    for parts in (3, 8):
        folder = shared_dir(spark, "warc-test")
        manifest = warc.write_archives(pages.repartition(parts), folder, shard_bytes=600_000)
        manifests.append(sorted(map(tuple, manifest.collect())))
        got = warc.read_archives(manifest, folder)
        assert got.count() == 23_000 and got.select("record_id").distinct().count() == 23_000
    assert manifests[0] == manifests[1] and len({m[0][:12] for m in manifests[0]}) > 20
    per_shard = {}
    for path, n, *_ in manifests[0]:
        per_shard[path[:12]] = per_shard.get(path[:12], 0) + n
    assert max(per_shard.values()) < 1500 and len(manifests[0]) > len(per_shard)


def test_archive_urls_and_repeated_pages_come_back(spark):
    url = "http://x.org/ä b?q=ü%20\r\nX: y"
    rows = [(1, url, "z" * 200), (1, url, "z" * 200), (1, "other", "z" * 200), (-5, "ok", "z" * 200), (None, None, "z" * 200)]
    _, _, got = archived(spark, rows)
    assert sorted((x.url is None, x.url or "") for x in got) == sorted((u is None, u or "") for _, u, _ in rows)
    assert len({x.record_id for x in got}) == 5 and {x.refers_to for x in got if x.record_type == "revisit"} == {-5}


def test_mixing_meets_given_targets(spark):
    r = random.Random(12)
    rows = []
    for i in range(3000):  # sources nearly fix languages
        source = r.choice(["a", "a", "a", "b", "c"])
        lang = {"a": "en", "b": "fr", "c": "de"}[source] if r.random() < 0.9 else r.choice(["en", "fr", "de"])
        rows.append((i, "w " * r.randrange(1, 40) + r.choice(["", " | ", "!! "]), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.3, "b": 0.4, "c": 0.3}, "lang": {"en": 0.35, "fr": 0.35, "de": 0.3}}
    got = mixing.mix(df, targets=targets).collect()
    for d, want in targets.items():
        share = {}
        for x in got:
            share[x[d]] = share.get(x[d], 0) + x.n_tokens * x.prob
        assert {k: round(v / sum(share.values()), 4) for k, v in share.items()} == want
    cells = spark.createDataFrame([("a", "en", "t", 5), ("b", "fr", "t", 5)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="no weights meet"):
        mixing.rake(cells, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}})
    with pytest.raises(ValueError, match="no tokens"):
        mixing.rake(cells, targets={"source": {"a": 0.5, "z": 0.5}})
    with pytest.raises(ValueError, match="add up"):
        mixing.rake(cells, targets={"source": {"a": 0.5, "b": 0.6}})
    raked, residual = mixing.raked(cells, temper={"source": 0.5, "lang": 1.0, "topic": 1.0})
    assert residual < 1e-12 and abs(sum(x.weight for x in raked.collect()) - 1) < 1e-9
    other = mixing.mix(df, topic=lambda text: F.substring(text, 1, 1)).select("topic").distinct().collect()
    assert {x.topic for x in other} == {"w"}


def test_equal_rows_of_a_hot_arc_are_ranked_in_parts(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(None, "same")] * 400 + [(7, None)] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sharding.assign(df.repartition(5)).collect()
    b = sharding.assign(df.repartition(3), hot_arc=50).collect()
    check_shards(rows, a, 8)
    check_shards(rows, b, 8)
    assert sorted(map(str, a)) == sorted(map(str, b))


def brute_ring(rows, shards):
    """doc_id → shard by walking the ring row by row: each row's arc owner while it has room, then the leftovers clockwise."""
    at, whose = sharding.ring(shards)
    n, held, out, left = len(rows), [0] * shards, {}, []
    room = [n // shards + (s < n % shards) for s in range(shards)]
    for arc, rank, doc in sorted(rows):
        node = next((i for i, a in enumerate(at) if a >= arc), 0)
        if held[whose[node]] < room[whose[node]]:
            out[doc] = (whose[node], held[whose[node]])
            held[whose[node]] += 1
        else:
            left.append((doc, node))
    for doc, node in left:
        while True:
            node = (node + 1) % len(at)
            s = whose[node]
            if held[s] < room[s]:
                out[doc] = (s, held[s])
                held[s] += 1
                break
    return out


def test_shards_match_a_walk_row_by_row(spark, sf):
    got = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    signed = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64(F.col("doc_id"), F.lit(False), (F.octet_length("text") + 1).cast("long"), F.crc32(F.col("text").cast("binary"))).alias("key")).collect()
    want = brute_ring([((r.key & (1 << 64) - 1) >> 48, r.key, r.doc_id) for r in signed], 8)
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_slack_lets_fewer_rows_move():
    r = random.Random(3)
    counts = {r.randrange(sharding.ARCS): r.randrange(1, 4) for _ in range(20_000)}
    places = lambda n, slack: {(arc, k): s for arc, lo, hi, s, _ in sharding.plan(counts, n, slack=slack) for k in range(lo, hi)}
    total = sum(counts.values())
    for slack, most in ((0.0, 0.35), (0.3, 0.16)):
        a, b = places(8, slack), places(9, slack)
        assert sum(a[k] != b[k] for k in a) / total < most
        assert max(np.bincount(list(b.values()))) <= math.ceil(total * (1 + slack) / 9)


def plain_mix(rows):
    """doc_ids that raking and the hash draw keep, by plain loops over the cells."""
    layout = lambda t: "table" if " | " in t else "decorated" if re.search(r"[*#&$%]{3}", t) else "shouting" if "!! " in t else "prose"
    cell = {i: (source, lang, layout(t)) for i, t, lang, source in rows}
    tokens = {}
    for i, t, *_ in rows:
        tokens[cell[i]] = tokens.get(cell[i], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(tokens.values())
    weight = {c: n / total for c, n in tokens.items()}
    margin = lambda d: {v: sum(w for c, w in weight.items() if c[d] == v) for v in {c[d] for c in weight}}
    targets = []
    for d, power in enumerate((0.8, 0.8, 1.0)):
        m = {v: w**power for v, w in margin(d).items()}
        targets.append({v: w / sum(m.values()) for v, w in m.items()})
    for _ in range(32):
        for d in range(3):
            m = margin(d)
            weight = {c: w * targets[d][c[d]] / m[c[d]] if m[c[d]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / n for c, n in tokens.items() if n}
    draw = lambda i, t: int(hashlib.md5(f"mix:{i}:{t}".encode()).hexdigest()[:12], 16) / 2**48
    return {i for i, t, *_ in rows if draw(i, t) < ratio.get(cell[i], max(ratio.values())) / max(ratio.values())}


def test_pipeline_matches_a_plain_one(spark, tmp_path):
    """Each stage against loops over its input, on documents with toxic ones, copies and benchmark passages."""
    import corpus_pipeline
    from test_copies import brute_groups

    from corpusforge.llm import toxicity
    from corpusforge.llm._common import remainder

    r = random.Random(21)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "su", "tor") for b in ("da", "fen", "gul", "pra", "x", "zim")]
    bench = [(i, " ".join(r.choices(words, k=14))) for i in range(6)]
    rows, labels = [], []
    for i in range(420):
        ws = r.choices(words, k=r.randrange(15, 60))
        toxic = i % 5 == 1
        if toxic:
            for _ in range(6):
                ws[r.randrange(len(ws))] = r.choice(["vileword", "grimword", "foulword"])
        if i % 17 == 2:
            ws[4:4] = bench[i % 6][1].split()
        if i % 11 == 3:
            ws.insert(3, "|")
        rows.append((i, " ".join(ws), r.choice(["en", "en", "de"]), r.choice(["a", "a", "b", "c"])))
        labels.append((i, 1, int(toxic)))
    rows += [(500 + k, rows[k * 9][1] + (" more" if k % 2 else ""), "en", "a") for k in range(30)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks.where(remainder("doc_id", 5) != 0))
    score = lambda t: model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    left = [x for x in rows if score(x[1]) < 0.5]
    counts = [len(rows), len(left)]
    groups = brute_groups([x[:2] for x in left])
    left = [x for x in left if groups[x[0]][2]]
    counts.append(len(left))
    hits = brute_hits([x[:2] for x in left], bench)
    left = [x for x in left if hits[x[0]][1] == 0]
    counts.append(len(left))
    kept = plain_mix(left)
    left = [x for x in left if x[0] in kept]
    counts.append(len(left))
    assert all(a > b for a, b in zip(counts, counts[1:])) and counts[-1] > 50
    signed = spark.createDataFrame([x[:2] for x in left], "doc_id long, text string").select("doc_id", F.xxhash64(F.col("doc_id"), F.lit(False), (F.octet_length("text") + 1).cast("long"), F.crc32(F.col("text").cast("binary"))).alias("key")).collect()
    want = brute_ring([((x.key & (1 << 64) - 1) >> 48, x.key, x.doc_id) for x in signed], 8)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {x.doc_id: (x.shard, x.slot) for x in got} == want
