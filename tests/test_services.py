"""Services, limits, sinks with digests and RDF/XML."""

import hashlib
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import archives, hashed, rdfxml, readers, search
from corpusforge.streaming import limits, streams

SHAKY, JUDGE = "tests.fakes:shaky", "tests.fakes:judge"


def shared(tmp_path, name):
    return f"file://{tmp_path}/{name}"


# ---- services ------------------------------------------------------------------


def test_pages_of_a_service(spark, tmp_path):
    log = str(tmp_path / "log")
    queries = [{"name": "a", "query": "qa", "wanted": 2}, {"name": "b", "query": "qb", "wanted": 3}]
    x = search.pages(spark, queries, SHAKY, {"total": 14, "fail": 2, "log": log}, delay=0, backOff=0)
    assert x.rdd.getNumPartitions() == 6
    rows = [(r.name, r.rank, json.loads(r.doc)["bibcode"]) for r in x.collect()]
    # Pages of 6 and 9 documents: the last page of a has 2, the second of b has 5 and the third none.
    assert sorted(rows) == [(n, i, f"q{n}-{i}") for n in "ab" for i in range(14)]
    asked = [line.rsplit("|", 1)[0] for line in open(log)]
    assert sorted(set(asked)) == ["qa|0|6", "qa|12|6", "qa|6|6", "qb|0|9", "qb|18|9", "qb|9|9"] and len(asked) == 18


@pytest.mark.parametrize("status", [429, "timeout", "down"])
def test_a_service_that_stays_away_fails_the_scan(spark, status):
    x = search.pages(spark, [{"name": "a", "query": "q", "wanted": 1}], SHAKY, {"fail": 99, "status": status}, delay=0, backOff=0, retries=1, pages=1)
    with pytest.raises(Exception, match="the service answered"):
        x.collect()


def brute_sample(total, queries, known):
    seen, out = set(known), []
    for q in queries:
        n = 0
        for i in range(min(total, 9 * q["wanted"])):
            short = i % 3 == 0 or i % 7 == 0 or i % 5 == 0
            if n < q["wanted"] and not short and (b := f"{q['query']}-{i}") not in seen:
                seen.add(b)
                out.append((q["name"], i, b))
                n += 1
    return out


def test_sampling_skips_and_never_repeats(spark):
    queries = [{"name": "first", "query": "q", "wanted": 4}, {"name": "again", "query": "q", "wanted": 3}, {"name": "other", "query": "r", "wanted": 2}]
    known = spark.createDataFrame([("q-1",), ("r-4",)], "bibcode string")
    x = search.pages(spark, queries, SHAKY, {"total": 40, "fail": 0}, delay=0)
    got = [(r.name, r["rank"], r.bibcode) for r in search.sample(x, queries, known).collect()]
    assert sorted(got) == sorted(brute_sample(40, queries, {"q-1", "r-4"}))


def test_stored_answers_open_only_what_is_asked_for(spark, tmp_path):
    ranked = spark.range(950).select(F.lit("q").alias("query"), F.col("id").alias("rank"), F.lit(950).alias("found"), F.format_string('{"bibcode":"b%s"}', F.col("id")).alias("doc"))
    folder = shared(tmp_path, "answers")
    search.store_answers(ranked.repartition(5), folder, "s")
    ask = search.stored(folder)
    assert [d["bibcode"] for d in ask("q", 195, 10, "s").docs] == [f"b{i}" for i in range(195, 205)]
    assert ask("q", 945, 10, "s").found == 950 and len(ask("q", 945, 10, "s").docs) == 5
    assert ask("q", 0, 0, "s").found == 950 and ask("q", 0, 0, "s").docs == []
    assert ask("q", 5, 5, "other").docs == [] and ask("no", 0, 5, "s") == search.Reply(200, [], 0)


def test_replies_ask_once_for_equal_queries(spark, tmp_path):
    log = str(tmp_path / "log")
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, query string")
    got = {r.id: (r.status, r.found, r.ids) for r in search.replies(q, SHAKY, {"total": 3, "fail": 1, "log": log}, rows=2, back_off=0.0).collect()}
    assert got == {1: (200, 3, ["a-0", "a-1"]), 2: (200, 3, ["a-0", "a-1"]), 3: (400, 0, []), 4: (200, 3, ["b-0", "b-1"])}
    assert len(open(log).read().split()) == 4
    sets = search.result_sets(spark.createDataFrame([(1, "x"), (2, "syntax")], "id long, query string"), 2, JUDGE).collect()
    assert sorted(tuple(r) for r in sets) == [(1, 1, "x0"), (1, 2, "x1")]
    assert search.result_sets(q.limit(0), 2, JUDGE).collect() == []


def test_remote_check_by_status(spark):
    said = {
        "title:fine": (True, None, None), "title:none": (True, None, "Query returned 0 results"), "title:syntax": (False, "parse error: near '('", None), "title:mute": (False, "parse error: Unknown parse error", None),
        "title:key": (False, "Invalid API key", None), "title:busy": (False, "API rate limit exceeded", None), "title:gone": (False, "API error: HTTP 404", None), "title:slow": (False, "API timeout", None),
        "title:cut": (False, "API request error: reset", None), "title:(": (False, "Unbalanced parentheses", None),
    }
    q = spark.createDataFrame([(i, q) for i, q in enumerate(said)], "id long, query string")
    got = {r.query: (r.valid, r.error, r.warning) for r in search.remote_check(q, JUDGE, retries=1, back_off=0.0).collect()}
    assert got == said


def test_http_transport():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            ok = self.headers["Authorization"] == "Bearer secret"
            status = 401 if not ok else 400 if q["q"] == "bad" else 429 if q["q"] == "busy" else 200
            body = {"response": {"numFound": 3, "docs": [{"bibcode": q["start"]}] * int(q["rows"])}} if status == 200 else {"error": {"msg": "no"}}
            self.send_response(status)
            self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = search.http(f"http://127.0.0.1:{server.server_port}/q", token_env="TEST_SEARCH_KEY")
        assert ask("x", 0, 1, "s").status == 401
        os.environ["TEST_SEARCH_KEY"] = "secret"
        assert ask("x", 5, 2, "s") == search.Reply(200, [{"bibcode": "5"}] * 2, 3)
        assert ask("bad", 0, 0, "s") == search.Reply(400, message="no", wait=7.0) and ask("busy", 0, 0, "s").wait == 7.0
    finally:
        server.shutdown()
        server.server_close()
        os.environ.pop("TEST_SEARCH_KEY", None)
    assert search.asked(ask, "x", 0, 1, "s", retries=1, back_off=0.0).status == 0


# ---- limits --------------------------------------------------------------------


def brute_limits(batches, rate, burst):
    """A loop over the requests in the order in which a service would get them."""
    tokens, last, cache, out = {}, {}, {}, []
    for batch in batches:
        for account, id_, query, at in sorted(batch, key=lambda r: (r[3], r[1])):
            account, query = account or "", query or ""
            if (account, query) in cache:
                out.append((account, id_, *cache[account, query], True, 0.0))
                continue
            now = max(at, last.get(account, at))
            t = min(burst, tokens.get(account, burst) + (now - last.get(account, now)) * rate)
            if t < 1:
                now, t = now + (1 - t) / rate, 1
            tokens[account], last[account] = t - 1, now
            cache[account, query] = (False, 1) if "syntax" in query else (True, 2) if "none" in query else (True, 3)
            out.append((account, id_, *cache[account, query], False, round(now - at, 6)))
    return sorted(out)


def test_token_buckets_and_caches_survive_a_restart(spark, tmp_path):
    limits.state_store(spark)
    kind = "account string, id long, query string, at double"
    batches = [[(f"a{i % 2}", i, f"q{i % 9}", 0.1 * i) for i in range(30)] + [(None, 90, None, 0.0), (None, 91, "", 5.0)], [(f"a{i % 2}", 100 + i, f"{'none' if i % 3 else 'syntax'} {i // 2}", 2.0 + 0.05 * i) for i in range(20)], [("a0", 200 + i, f"new {i}", 1000.0) for i in range(5)]]
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for batch in batches:  # each run ends and another goes on where it was
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        x = limits.validated(spark.readStream.schema(kind).parquet(source), JUDGE, rate=2.0, burst=3)
        streams.run_to_table(x, out, mark)
    got = spark.read.parquet(out).collect()
    assert sorted((r.account, r.id, r.valid, r.tier, r.from_cache, round(r.waited, 6)) for r in got) == brute_limits(batches, 2.0, 3)
    assert {r.error for r in got if not r.valid} == {"parse error: near '('"} and any(r.waited > 0 for r in got)


# ---- sinks ---------------------------------------------------------------------


def test_lines_have_the_digest_of_their_file(spark, tmp_path):
    rows = [(i, f'é "{i}"\n' if i % 5 else None, ["a/b", "c", None][i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(4)
    for n, how in enumerate(({"by": "split"}, {"by": "split", "one_file": True}, {}, {"one_file": True})):
        folder = str(tmp_path / f"lines{n}")
        got = hashed.write_lines(df, "file://" + folder, "id", **how).collect()
        assert sorted(os.listdir(folder)) == sorted([hashed.MANIFEST, *(r.path for r in got)])
        lines = []
        for r in got:
            raw = open(os.path.join(folder, r.path), "rb").read()
            assert (hashlib.sha256(raw).hexdigest(), len(raw), raw.count(b"\n")) == (r.sha256, r.bytes, r.lines)
            lines += [(json.loads(x), r.part) for x in raw.decode().split("\n")[:-1]]
        assert sorted((x["id"], x["text"], x["split"]) for x, _ in lines) == rows and all(part == (x["split"] if "by" in how else None) for x, part in lines)
        assert len(got) == (3 if how == {"by": "split", "one_file": True} else 1 if how == {"one_file": True} else len(got))
        assert all(r.sound for r in hashed.verified(spark, "file://" + folder).collect())
    again = hashed.write_lines(df.repartition(7), shared(tmp_path, "again"), "id", "split", one_file=True)
    assert {r.sha256 for r in again.collect()} == {r.sha256 for r in hashed.manifest(spark, shared(tmp_path, "lines1")).collect()}
    with open(os.path.join(folder, got[0].path), "ab") as f:
        f.write(b"{}\n")
    assert [r.sound for r in hashed.verified(spark, "file://" + folder).collect()] == [False]


def test_a_failed_output_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "lines")
    spark.dataSource.register(hashed.HashedLines)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise("x").alias("line"), F.lit("p").alias("part"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("hashed_lines").mode("append").save("file://" + folder)
    assert os.listdir(folder) == []
    assert hashed.write_lines(spark.range(10), "file://" + folder, "id").agg(F.sum("lines")).first()[0] == 10
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception, match="has an output already"):
        hashed.write_lines(spark.range(10), "file://" + folder, "id")
    assert sorted(os.listdir(folder)) == before
    assert hashed.write_lines(spark.range(0), shared(tmp_path, "none"), "id").count() == 0


# ---- RDF/XML -------------------------------------------------------------------

TURTLE = """@prefix o: <http://o.org/x#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
o:Ice a rdfs:Class ; rdfs:label "ice & \\"snow\\""@en , "Eis"@de ; rdfs:subClassOf o:Water ; o:seen [ o:at "pole" ; o:by o:Fox ] .
o:Water rdfs:label "water" .
"""
NT = [
    '<http://o.org/x#Ice> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2000/01/rdf-schema#Class> .', '<http://o.org/x#Ice> <http://www.w3.org/2000/01/rdf-schema#label> "Eis"@de .',
    '<http://o.org/x#Ice> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://o.org/x#Water> .', '<http://o.org/x#Water> <http://www.w3.org/2000/01/rdf-schema#label> "water" .',
]
RDF = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE rdf:RDF [ <!ENTITY o "http://o.org/x" > ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:o="http://o.org/x#" xml:base="&o;">
  <!-- typed, nested and blank -->
  <rdfs:Class rdf:about="#Ice">
    <rdfs:label xml:lang="en">ice &amp; "snow"</rdfs:label><rdfs:label xml:lang="de">Eis</rdfs:label>
    <rdfs:subClassOf><rdf:Description rdf:ID="Water" rdfs:label="water"/></rdfs:subClassOf>
    <o:seen rdf:parseType="Resource"><o:at>pole</o:at><o:by rdf:resource="#Fox"/></o:seen>
  </rdfs:Class>
</rdf:RDF>"""
R, O = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://o.org/x#"


def parsed(body, base=""):
    head = f'<rdf:RDF xmlns:rdf="{R}" xmlns:o="{O}">'
    return sorted(t for rows in rdfxml.parse((head + body + "</rdf:RDF>").encode(), base) for t in rows)


def test_the_same_triples_from_three_syntaxes(spark, tmp_path):
    (tmp_path / "a.owl").write_text(RDF, encoding="utf-8")
    (tmp_path / "b.ttl").write_text(TURTLE, encoding="utf-8")
    (tmp_path / "c.nt").write_text("\n".join(NT), encoding="utf-8")
    rdf = sorted(tuple(r) for r in rdfxml.rdfxml(spark, str(tmp_path)).collect())
    assert rdf == sorted(tuple(r) for r in archives.turtle(spark, str(tmp_path)).collect()) and len(rdf) == 8
    named = sorted(tuple(r) for r in readers.ntriples(spark, str(tmp_path / "c.nt")).collect())
    assert set(named) < set(rdf)


def test_rdfxml_forms():
    o = lambda n: O + n
    assert parsed('<rdf:Description rdf:about="u:a"><o:p>x<!-- c -->y</o:p><o:q/></rdf:Description>') == [("u:a", o("p"), "xy"), ("u:a", o("q"), "")]
    assert parsed('<o:T rdf:nodeID="n" o:p="v" rdf:type="u:t"><o:q rdf:nodeID="m"/></o:T>') == sorted([("_:n", R + "type", o("T")), ("_:n", R + "type", "u:t"), ("_:n", o("p"), "v"), ("_:n", o("q"), "_:m")])
    assert parsed('<rdf:Description rdf:about="u:a"><o:p o:q="v"/></rdf:Description>') == sorted([("u:a", o("p"), "_:b1"), ("_:b1", o("q"), "v")])
    assert parsed('<rdf:Bag rdf:about="u:a"><rdf:li>x</rdf:li><rdf:li rdf:resource="u:b"/></rdf:Bag>') == sorted([("u:a", R + "type", R + "Bag"), ("u:a", R + "_1", "x"), ("u:a", R + "_2", "u:b")])
    got = parsed('<rdf:Description rdf:about="u:a"><o:p rdf:parseType="Collection"><rdf:Description rdf:about="u:b"/><o:T rdf:about="u:c"/></o:p><o:e rdf:parseType="Collection"/></rdf:Description>')
    assert got == sorted([("u:c", R + "type", o("T")), ("_:b1", R + "first", "u:c"), ("_:b1", R + "rest", R + "nil"), ("_:b2", R + "first", "u:b"), ("_:b2", R + "rest", "_:b1"), ("u:a", o("p"), "_:b2"), ("u:a", o("e"), R + "nil")])
    assert parsed('<rdf:Description rdf:about="u:a"><o:p rdf:parseType="Literal">a <b c="1">x &lt; y</b></o:p></rdf:Description>') == [("u:a", o("p"), 'a <b c="1">x &lt; y</b>')]
    deep = "".join(f'<rdf:Description rdf:about="u:{i}"><o:p>' for i in range(300)) + "z" + "</o:p></rdf:Description>" * 300
    assert len(parsed(deep)) == 300
    assert parsed('<rdf:Description rdf:about=""><o:p rdf:resource="../z"/></rdf:Description>', "http://h/a/b/c") == [("http://h/a/b/c", o("p"), "http://h/a/z")]
    assert parsed("") == []
    with pytest.raises(Exception, match="mismatched tag|no element"):
        list(rdfxml.parse(b"<a><b></a>"))
    with pytest.raises(Exception, match="no element"):
        list(rdfxml.parse(b""))


def test_rdfxml_goes_on_in_pieces(monkeypatch):
    monkeypatch.setattr(rdfxml, "CHUNK", 50)
    monkeypatch.setattr(rdfxml, "ROWS", 10)
    body = "".join(f'<rdf:Description rdf:about="u:é{i}"><o:p>{i}</o:p></rdf:Description>' for i in range(200))
    head = f'<rdf:RDF xmlns:rdf="{R}" xmlns:o="{O}">'
    pieces = list(rdfxml.parse((head + body + "</rdf:RDF>").encode()))
    assert len(pieces) > 15 and max(map(len, pieces)) < 20 and [t for p in pieces for t in p] == [(f"u:é{i}", O + "p", str(i)) for i in range(200)]


# ---- sketches ------------------------------------------------------------------


def test_sketches_merge_to_quantiles_of_a_stated_rank(spark, tmp_path):
    events = spark.range(60_000).select(F.timestamp_seconds(1_704_067_200 + F.col("id")).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0, F.lit(2.0)).alias("value"))
    events = events.withColumn("value", F.when(F.col("value") > 9000, None).when(F.col("value") < 1, float("nan")).otherwise(F.col("value")))
    sketches = streams.latency_sketches(events)
    assert sketches.count() == 2 * 17 and max(len(r.sketch) for r in sketches.collect()) < 20_000
    got = {r.event_type: r for r in streams.merged_quantiles(sketches, at=(0.1, 0.5, 0.99)).collect()}
    for kind in "ab":
        values = sorted(r.value for r in events.where((F.col("event_type") == kind) & F.col("value").isNotNull() & ~F.isnan("value")).collect())
        assert got[kind].n == len(values) and got[kind].windows == 17
        for p, q in zip((0.1, 0.5, 0.99), got[kind].quantiles, strict=True):
            assert abs(sum(v <= q for v in values) / len(values) - p) < 0.006
    halves = [streams.latency_sketches(events.where(c)) for c in ("ts < '2024-01-01 08:30:00'", "ts >= '2024-01-01 08:30:00'")]
    again = {r.event_type: r.n for r in streams.merged_quantiles(halves[0].unionByName(halves[1])).collect()}
    assert again == {k: r.n for k, r in got.items()}
