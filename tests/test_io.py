"""Readers, writers, the stage runner and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.plans.stages import Runner
from corpusforge.sources import config, readers, sinks
from corpusforge.streaming import streams


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"natural_language": "é", "ads_query": "q", "llm_score": 4}\n\n{"natural_language": "b"}\n')
    assert [(r.natural_language, r.llm_score) for r in readers.jsonl(spark, str(p), readers.PAIR).collect()] == [("é", 4), ("b", None)]
    p2 = tmp_path / "b.jsonl"
    p2.write_text('{"natural_language": "a"}\nnot json\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p2), readers.PAIR).collect()
    assert readers.jsonl(spark, str(p2), readers.PAIR, strict=False).count() == 1
    assert [r.line for r in readers.bad_lines(spark, str(p2), readers.PAIR).collect()] == ["not json"]
    assert readers.json_documents(spark, str(tmp_path / "none.json"), readers.PAIR).count() == 0


def test_log_chat_and_benchmark(spark, tmp_path):
    (tmp_path / "log.csv").write_text('query,n\n"author:""x, y""",3\nabs:z,1\n')
    assert [r.query for r in readers.query_log(spark, str(tmp_path / "log.csv")).collect()] == ['author:"x, y"', "abs:z"]
    chat = [{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "Query: dust\nDate: 2025-12-15"}, {"role": "assistant", "content": '{"query": "abs:dust"}'}]}, {"messages": [{"role": "user", "content": "plain"}, {"role": "assistant", "content": "abs:plain"}]}]
    (tmp_path / "chat.jsonl").write_text("\n".join(map(json.dumps, chat)))
    assert [tuple(r) for r in readers.chat_examples(spark, str(tmp_path / "chat.jsonl")).collect()] == [("dust", "abs:dust"), ("plain", "abs:plain")]
    (tmp_path / "bench.json").write_text(json.dumps({"c": {"s": [{"id": "1", "natural_language": "x"}], "t": [{"id": "2"}]}}))
    assert sorted((r.category, r.subcategory, r.id) for r in readers.benchmark_cases(spark, str(tmp_path / "bench.json")).collect()) == [("c", "s", "1"), ("c", "t", "2")]


def test_templates(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.yaml").write_text("- {id: one, intent: x, nl_templates: ['on {topic}'], ads_query_template: 'abs:{topic}', slots: {topic: {type: topic}}}\n- {id: two, intent: x, nl_templates: ['on {what}'], ads_query_template: 'abs:x'}\n")
    (d / "b.yaml").write_text("id: [")
    good, bad = readers.templates(spark, str(d))
    assert [r.id for r in good.collect()] == ["one"] and sorted(r.file for r in bad.collect()) == ["a.yaml", "b.yaml"]
    with pytest.raises(Exception):
        readers.templates(spark, str(d), strict=True)


def test_trees_and_triples(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps([{"label": "A b", "children": [{"label": "B", "children": [{"label": "C"}]}]}, {"label": "D"}]))
    assert sorted((r.key, r.parent, r.depth) for r in readers.variant_tree(spark, str(tmp_path / "tree.json"), "label").collect()) == sorted([("A b", None, 0), ("D", None, 0), ("A b/B", "A b", 1), ("A b/B/C", "A b/B", 2)])
    (tmp_path / "x.nt").write_text('# c\n<http://a/S> <http://p/label> "a \\"q\\""@en .\n<http://a/S> <http://p/subClassOf> <http://a/T> .\n\n')
    assert [(r.s, r.o) for r in readers.ntriples(spark, str(tmp_path / "x.nt")).collect()] == [("http://a/S", 'a \\"q\\"'), ("http://a/S", "http://a/T")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}", "train" if i % 5 else "val") for i in range(30)], "id int, text string, split string")
    a = sinks.write_jsonl(df, str(tmp_path / "a"), "id").first()
    b = sinks.fingerprint(df.repartition(7)).first()
    assert tuple(a) == tuple(b) and a.rows == 30
    assert sorted(map(tuple, readers.jsonl(spark, str(tmp_path / "a"), "id int, text string, split string").collect())) == sorted(map(tuple, df.collect()))
    sinks.write_split(df, str(tmp_path / "s"), "split")
    assert spark.read.json(str(tmp_path / "s" / "split=val")).count() == 6
    m = sinks.artifact_manifest(spark, str(tmp_path / "a"), "*.json")
    assert m.agg(F.sum("lines")).first()[0] == 30
    assert sinks.markdown_table(df.limit(1)).count("\n") == 2
    with pytest.raises(ValueError):
        sinks.markdown_table(df, 3)
    sinks.save_index(df, str(tmp_path / "i"), "id")
    assert sinks.load_index(spark, str(tmp_path / "i")).count() == 30
    assert sinks.inject("<script>/*DATA*/</script>", ["</script>"]) == '<script>["<\\/script>"]</script>'
    assert json.loads(sinks.json_report(df.agg(F.count("*").alias("n")))[0]) == {"n": 30}


def test_runs(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"id": f"r{i}", "timestamp": f"2026-01-0{i + 1}", "summary": {"total": 5}}))
    (tmp_path / "bad.json").write_text("{")
    assert [r.id for r in readers.runs(spark, str(tmp_path), 2).collect()] == ["r2", "r1"]


def test_stages_resume(spark, tmp_path):
    seen = []

    def made(name, needs=None, fail=False):
        def stage(s, have):
            seen.append(name)
            if fail:
                raise ValueError("no")
            return have[needs].withColumn(name, F.lit(1)) if needs else s.range(5)

        return name, stage

    folder = str(tmp_path / "run")
    with pytest.raises(ValueError):
        Runner(spark, folder, [made("a"), made("b", "a", fail=True), made("c", "b")]).run()
    assert Runner(spark, folder, []).marker("b")["status"] == "failed"
    out = Runner(spark, folder, [made("a"), made("b", "a"), made("c", "b")]).run()
    assert seen == ["a", "b", "b", "c"] and [m["rows"] for m in out] == [5, 5, 5]
    assert len(Runner(spark, folder, [made("a"), made("b", "a"), made("c", "b")]).run()) == 3 and seen == ["a", "b", "b", "c"]


def test_streams_equal_tables(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    got = []
    stream = streams.windows(streams.read_stream(spark, str(tmp_path / "in"), events.schema, 100))
    streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "update", lambda df, _: got.extend(map(tuple, df.collect())))
    assert sorted(got) == sorted(map(tuple, streams.windows(events).collect()))
    lint = streams.linted(streams.read_stream(spark, str(tmp_path / "in"), events.schema).select(F.concat(F.lit("abs:"), "event_type", F.lit(" AND")).alias("query")))
    streams.run_to_table(lint.select("query", "valid"), str(tmp_path / "lint"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "lint")).where("valid").count() == 0
    first = streams.first_seen(streams.read_stream(spark, str(tmp_path / "in"), events.schema), "event_id")
    streams.run_to_table(first, str(tmp_path / "first"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "first")).count() == events.count()


def test_sources_and_fetch(spark, tmp_path):
    from corpusforge.sources import config

    (tmp_path / "raw.txt").write_text("abc\n")
    (tmp_path / "s.yaml").write_text(f"sources:\n- {{id: one, type: http, url: 'file://{tmp_path}/raw.txt'}}\n")
    (source,) = config.load_sources(str(tmp_path / "s.yaml"))
    a = config.fetch(source, str(tmp_path / "out"))
    b = config.fetch(source, str(tmp_path / "out"), a)
    assert not a["cached"] and b["cached"] and a["sha256"] == b["sha256"]
    with pytest.raises(ValueError):
        config.fetch(config.Source("x", "http", source.url, checksum="0"), str(tmp_path / "out"))
    (tmp_path / "bad.yaml").write_text("sources:\n- {id: a}\n- {id: b, type: ftp, url: u}\n")
    with pytest.raises(ValueError, match="missing type, url; source b: unknown type"):
        config.load_sources(str(tmp_path / "bad.yaml"))


def test_registry_metrics_and_catalogs(spark, tmp_path):
    from corpusforge.operators import catalog
    from corpusforge.sources import config

    new = {"id": "https://ror.org/1", "status": "active", "names": [{"value": "X Lab", "types": ["ror_display"]}, {"value": "XL", "types": ["acronym"]}], "locations": [{"geonames_details": {"country_name": "Peru"}}]}
    old = {"id": "https://ror.org/2", "name": "Y Lab", "acronyms": ["YL"], "aliases": ["y lab", "Why"], "labels": [{"label": "Ypsilon", "iso639": "de"}], "country": {"country_name": "Chile"}}
    (tmp_path / "r.json").write_text(json.dumps([new, old, {"id": "https://ror.org/3", "status": "withdrawn", "name": "Z"}]))
    got = {r.id: r for r in catalog.organizations(config.registry_records(spark, str(tmp_path / "r.json"))).collect()}
    assert set(got) == {"ror:1", "ror:2"} and (got["ror:1"].label, got["ror:1"].country, got["ror:1"].aliases) == ("X Lab", "Peru", ["XL"])
    assert (got["ror:2"].label, got["ror:2"].country, got["ror:2"].aliases) == ("Y Lab", "Chile", ["Ypsilon", "YL", "Why"])
    (tmp_path / "m.txt").write_text('# HELP x\nx_total{a="b"} 3.5\ny 2 170000\nbroken line here\n')
    assert [tuple(r) for r in config.metrics(spark, str(tmp_path / "m.txt")).collect()] == [("x_total", 'a="b"', 3.5), ("y", "", 2.0)]
    (tmp_path / "t.jsonl").write_text('{"id": "a", "label": "A"}\n')
    (tmp_path / "e.jsonl").write_text('{"id": "b", "label": "B"}\n')
    x = config.catalog_entries(spark, {"topic": str(tmp_path / "t.jsonl"), "entity": str(tmp_path / "e.jsonl")}, "id string, label string")
    assert sorted((r.id, r.entry_type) for r in x.collect()) == [("a", "topic"), ("b", "entity")]
    config.append_example(x, str(tmp_path / "store"))
    config.append_example(x, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    runs = spark.createDataFrame([("a", (50, 49, 20)), ("b", (0, 0, 0))], "id string, summary struct<total:int,valid:int,exact:int>")
    assert [tuple(r) for r in config.run_summary(runs).orderBy("id").collect()] == [("a", 50, 98.0, 40.0, "pass"), ("b", 0, 0.0, 0.0, "fail")]


def test_archives_and_folders(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    tree = json.dumps([{"label": "A", "children": [{"label": "B"}]}])
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.json").write_text(tree)
    (tmp_path / "d" / "readme.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/x.json", tree)
        z.writestr("in/readme.txt", "no")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/x.json")
        info.size = len(tree)
        t.addfile(info, io.BytesIO(tree.encode()))
    for path in ("d", "x.zip", "x.tar.gz"):
        assert sorted((r.key, r.depth) for r in readers.variant_tree(spark, str(tmp_path / path), "label").collect()) == [("A", 0), ("A/B", 1)]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.json", json.dumps([{"id": "https://ror.org/1", "status": "active", "name": "N", "aliases": ["M"], "country": {"country_name": "X"}}]))
    got = config.registry_records(spark, str(tmp_path / "r.zip")).collect()
    assert [(r.id, [n["value"] for n in r.names], r.country) for r in got] == [("https://ror.org/1", ["N", "M"], "X")]


def test_turtle(spark, tmp_path):
    from corpusforge.sources import archives

    text = """@prefix ex: <http://example.org/x/> . @base <http://base/> .
PREFIX skos: <http://skos/>  # a comment . with ; signs
ex:Rock a ex:Class ; skos:prefLabel "rock \\"hard\\""@en , 'x' ;
  ex:note \"\"\"two
lines\"\"\"^^ex:text ; ex:part [ ex:name "p" ; ex:size 1.5 ] .
<Other> ex:near ex:Rock, _:n1 .
"""
    text = text.replace(", 'x'", "")
    (tmp_path / "o.ttl").write_text(text)
    got = sorted(map(tuple, archives.turtle(spark, str(tmp_path / "o.ttl")).collect()))
    x = "http://example.org/x/"
    assert got == sorted([(f"{x}Rock", archives._TYPE, f"{x}Class"), (f"{x}Rock", "http://skos/prefLabel", 'rock "hard"'), (f"{x}Rock", f"{x}note", "two\nlines"), (f"{x}Rock", f"{x}part", "_:b1"), ("_:b1", f"{x}name", "p"), ("_:b1", f"{x}size", "1.5"), ("http://base/Other", f"{x}near", f"{x}Rock"), ("http://base/Other", f"{x}near", "_:n1")])
    with pytest.raises(ValueError, match="prefix"):
        list(archives.parse_turtle("un:known a un:x ."))


def test_conditional_download_and_clone(tmp_path):
    import subprocess

    asked = []

    def transport(url, headers):
        asked.append(headers)
        return (304, {}, ()) if headers.get("If-None-Match") == '"1"' else (200, {"ETag": '"1"'}, [b"ab", b"c"])

    source = config.Source("v", "http", "http://x.org/v.json?x=1")
    a = config.fetch(source, str(tmp_path / "out"), transport=transport)
    b = config.fetch(source, str(tmp_path / "out"), a, transport)
    assert (a["cached"], b["cached"], asked) == (False, True, [{}, {"If-None-Match": '"1"'}]) and open(a["path"]).read() == "abc" and a["path"].endswith("v.json")
    with pytest.raises(ValueError, match="checksum"):
        config.fetch(config.Source("w", "http", source.url, checksum="0"), str(tmp_path / "out"), transport=transport)
    with pytest.raises(ValueError, match="status 500"):
        config.fetch(source, str(tmp_path / "new"), transport=lambda u, h: (500, {}, ()))
    repo = tmp_path / "repo"
    run = lambda *args: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@x.org", *args], check=True, capture_output=True, text=True).stdout.strip()
    repo.mkdir()
    run("init", "-q")
    commits = []
    for text in ("one", "two"):
        (repo / "f").write_text(text)
        run("add", "f")
        run("commit", "-qm", text)
        commits.append(run("rev-parse", "HEAD"))
    source = config.Source("g", "git", f"file://{repo}")
    got = [config.checkout(source, str(tmp_path / "clones"), r)["commit"] for r in (None, commits[0], None)]
    assert got == [commits[1], commits[0], commits[1]] and (tmp_path / "clones" / "g" / "f").read_text() == "two"


PLAN = [("one", lambda spark, have: spark.range(3)), ("two", lambda spark, have: have["one"].selectExpr("id + 1 AS id"))]


def test_command_line(spark, sf, tmp_path, capsys, monkeypatch):
    import os

    from corpusforge.__main__ import main

    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    assert main(["list-queries"]) == 0 and "bm25_topk" in capsys.readouterr().out.split()
    assert main(["query", "category_distribution", sf, "--out", str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 4
    assert main(["query", "nothing", sf]) == 2
    capsys.readouterr()
    assert main(["run", "test_io:PLAN", str(tmp_path / "r"), "--last", "one"]) == 0
    assert main(["list-stages", "test_io:PLAN", str(tmp_path / "r")]) == 0
    assert capsys.readouterr().out.split("\n")[-3:-1] == ["one completed", "two pending"]
    assert main(["run", "test_io:PLAN", str(tmp_path / "r")]) == 0
    assert [json.loads(line)["rows"] for line in capsys.readouterr().out.strip().split("\n")] == [3, 3]


def test_short_lists_only_are_dealt_around(spark, monkeypatch):
    from corpusforge.operators import generate

    left, right = spark.range(5).withColumnRenamed("id", "i"), spark.createDataFrame([("a", 1), ("b", 2)], "v string, k int")
    assert [r.v for r in generate.round_robin(left, right, "i", "k").orderBy("i").collect()] == ["a", "b", "a", "b", "a"]
    monkeypatch.setattr(generate, "BROADCAST_ROWS", 1)
    with pytest.raises(ValueError, match="short list"):
        generate.round_robin(left, right, "i", "k")
