"""Steps that many queries share cost each row once, and still give what plain loops give."""

import re

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import qlang, vocab
from corpusforge.operators import reports, validate
from corpusforge.plans import base, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_of_a_report_are_found_in_one_pass(spark, sf):
    assert plan(registry.QUERIES["report_examples"](spark, sf)).count("FileScan parquet") == 3


def test_examples_of_a_report_of_either_kind(spark):
    x = spark.range(100).repartition(5).withColumn("ok", F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1))
    got = sorted((r.id, r.good) for r in reports.examples_for_report(x, F.col("ok"), "id", 3).select("id", "good").collect())
    assert got == [(1, True), (2, False), (4, True), (5, False), (7, True), (8, False)]


def test_a_query_is_computed_once_however_often_lint_looks_at_it(spark):
    q = F.concat(F.lit("author:x "), F.md5(F.col("id").cast("string")))
    x = spark.range(9).where(F.size(qlang.lint(q)) + F.size(qlang.wrong_values(q, "doctype")) == 0)
    assert len(re.findall(r"md5\(", plan(x).split("\n\n")[0])) <= 2 and x.count() == 9


QUERIES = ['doctype:""', 'doctype:"a', 'DOCTYPE: "a b" x', 'doctype:""a"', 'doctype:"ab"c"', "doctype:(a OR \"b\" or c)", "doctype:( )", "doctype:x(doctype:y)", "doctype", "", "xdoctype:a", "doctype:doctype:a", 'doctype:" " doctype:a ', None]


@pytest.mark.parametrize("q", QUERIES)
def test_values_of_a_closed_field_are_those_of_a_loop(spark, q):
    want = None if q is None else []
    for quoted, group, bare in re.findall(r'\bdoctype:\s*(?:"([^"]+)"|(\([^)]+\))|([^\s()]+))', q or "", re.I | re.A):
        listed = [re.sub(r'^"+|"+$', "", v.strip(" ")) for v in re.split(r"\s+OR\s+", re.sub(r"^\(|\)$", "", group), flags=re.I)]
        want += [quoted] if quoted else [v for v in listed if v] if group else [bare]
    row = spark.createDataFrame([(q,)], "q string").select(qlang.enum_values(F.col("q"), "doctype").alias("v"), qlang.wrong_values(F.col("q"), "doctype").alias("w")).first()
    allowed = {v.lower() for v in vocab.ENUMS["doctype"]}
    assert row.v == want and row.w == (None if q is None else [v for v in want if v.lower() not in allowed])


def test_skip_rules_take_no_customers_number_for_a_date(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con, keys = duckdb.connect(), (1, 9999, 99999999, 100001)
    rows = {
        "orders": spark.createDataFrame([(i + 2, k) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("1997-05-05").cast("date")),
        "customer": spark.createDataFrame([(k, f"Customer#{k:09d}") for k in keys], "c_custkey long, c_name string"),
        "part": spark.createDataFrame([(k, "hot gizmo", "LARGE TIN", 4) for k in keys], "p_partkey long, p_name string, p_type string, p_size int"),
    }
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["skip_rules"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["skip_rules"](spark, str(tmp_path)).collect()) == want


def test_resolution_pairs_no_hint_with_every_title_that_shares_a_word(spark):
    hints = [(i, h) for i, h in enumerate(["red ring", "Ring red, ring", "ring", "big blue ring", "no such ring", "a b", None])]
    papers = [(i, t, i % 7) for i, t in enumerate(["red ring", "the red old ring", "ring", "blue ring big", "red", None, "ring of red"] * 40)] + [(3, "blue ring big", 3)]
    h = spark.createDataFrame(hints * 30, "id long, hint string")
    x = validate.resolve(h, spark.createDataFrame(papers, "bibcode long, title string, citation_count int"))
    words = lambda t: set(re.findall("[a-z0-9]{3,}", (t or "").lower()))
    want = {}
    for i, hint in hints:
        fit = [(c, b) for b, t, c in papers if words(hint) and words(hint) <= words(t)]
        if fit:
            want[i] = max(fit)[1]
    assert {r.id: r.bibcode for r in x.collect()} == want and 0 in want and 4 not in want
    assert "max_by" not in plan(x) and "array_except" in plan(x)


def test_calls_of_a_query_are_looked_up_once_for_all_phrases(spark):
    x = spark.createDataFrame([("popular papers like these", "similar(trending(x))"), (None, "similar(x)"), ("popular", "")], "nl string, q string")
    x = x.select(validate.trigger_phrases(F.col("nl"), qlang.calls(F.col("q"))).alias("t"))
    assert [[tuple(p) for p in r.t] for r in x.collect()] == [[("trending", "popular"), ("similar", "like")], [], []]
    assert plan(x).count("regexp_extract_all") == 1


@pytest.mark.parametrize("q", ['a:"b c" d:e f:', 'a:"" b:"x', 'a:"b"c d:""e"', 'citations(a:b) x:"y', 'a:\n"b', "", 'A:"B" \u2028c:d'])
def test_parts_that_a_semantic_match_compares(spark, q):
    low = q.lower()
    want = [n + ":" + a + b for n, a, b in re.findall(r'(\w+):(?:"([^"]+)"|([^ \t\n\x0b\f\r]+))', low, re.A)] + ["op:" + o for o in re.findall("(" + "|".join(vocab.CALLS) + r")[ \t\n]*\(", low)]
    want = list(dict.fromkeys(want))
    for n in range(len(want) + 1):
        # A text that has n of the parts, written so that each is one.
        have = " ".join(f"{p[3:]}(" if p.startswith("op:") else f'{p.split(":", 1)[0]}:"{p.split(":", 1)[1]}"' if " " in p else p for p in want[:n])
        kept = len(set(want) & set([m[0] + ":" + m[1] + m[2] for m in re.findall(r'(\w+):(?:"([^"]+)"|(\S+))', have, re.A)] + ["op:" + o for o in re.findall("(" + "|".join(vocab.CALLS) + r")\s*\(", have)]))
        got = spark.createDataFrame([(q, have)], "e string, a string").select(qlang.semantic_match(F.col("e"), F.col("a")).alias("m")).first().m
        assert got == (not want or 2 * kept >= len(want))


def test_annotation_holds_the_spans_of_few_texts(spark):
    import pyarrow as pa

    from corpusforge.operators import annotate

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a"] * 1000)], names=["doc_id", "text"])
    pieces = list(annotate._some_rows(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in pieces) <= 64 and [i for p in pieces for i in p.column(0).to_pylist()] == list(range(1000))


def test_a_batch_looks_for_each_query_in_the_state_once():
    import pandas as pd

    from corpusforge.streaming import limits

    class State(dict):
        looks = 0

        def exists(self):
            return False

        def update(self, value):
            self["bucket"] = value

        def containsKey(self, key):
            State.looks += 1
            return key in self

        def getValue(self, key):
            State.looks += 1
            return self[key]

        updateValue = dict.__setitem__

    v = limits._Validator("", {}, 1.0, 2, None, False)
    v.bucket, v.cache, asked = State(), State({("old",): (True, 1, None)}), []
    v._answer = lambda q: asked.append(q) or (True, 0, None)
    rows = pd.DataFrame({"id": range(90), "query": ["old", "new", "b"] * 30, "at": [float(i) for i in range(90)]})
    (out,) = v.handleInputRows(("a",), iter([rows]), None)
    assert asked == ["new", "b"] and State.looks == 4
    assert out["from_cache"].tolist() == [True, False, False] + [True] * 87 and out["tier"].tolist() == [3, 2, 2] * 30


def test_assembled_queries_have_more_tasks_and_not_longer_ones(spark, sf, monkeypatch):
    want = sorted(map(tuple, base.pairs(spark, sf).collect()))
    monkeypatch.setattr(base, "PAIRS_PER_TASK", 100)
    x = base.pairs(spark, sf)
    rows = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 8 and max(rows) < 200 and sorted(map(tuple, x.collect())) == want


def test_marks_of_a_text_are_looked_for_one_by_one_only_if_it_has_any(spark):
    x = spark.createDataFrame([("papers by: x",), ("Author:x abstracts: DATABASE:y",), ("[a TO b] ^x: abs",), (None,)], "t string").select(qlang.nl_issues(F.col("t")).alias("i"))
    assert "contains" in plan(x).lower().split("author", 1)[0]
    assert [r.i for r in x.collect()] == [[], ["contains 'author:'", "contains 'collection:'"], ["contains range syntax [X TO Y]", "contains ^ prefix (first author syntax)"], []]


def test_a_query_that_is_wrapped_in_a_call_is_assembled_once(spark):
    x = spark.range(3).select(qlang.wrap(F.md5(F.col("id").cast("string")), F.when(F.col("id") > 0, "similar")).alias("q"))
    assert plan(x).split("\n\n")[0].count("md5(") == 1 and [r.q[:8] == "similar(" for r in x.collect()] == [False, True, True]


@pytest.mark.parametrize("r", ["a TO b", "a to b", "a TO b TO c", " TO ", " TO  TO ", " TO TO ", "aTOb", "\u00df TO b"])
def test_a_range_has_one_to(spark, r):
    x = spark.createDataFrame([(f"pubdate:[{r}]",)], "q string").select(qlang.lint(F.col("q")).alias("e"))
    wrong = "Invalid pubdate range syntax" if " TO " not in r.upper() else "Invalid pubdate range:" if len(r.upper().split(" TO ")) != 2 else None
    assert [e[: len(wrong or "")] for e in x.first().e] == ([wrong] if wrong else []) and "split(" not in plan(x)


def test_only_synonyms_that_stand_in_a_text_are_replaced(monkeypatch):
    from corpusforge.functions import udfs

    class Never:
        def subn(self, *_):
            raise AssertionError

    known = {k: [(s, p if s in ("papers", "paper", "phd", "phd thesis", "thesis") else Never(), v) for s, p, v in udfs._synonyms(k)] for k in ("property", "doctype", "bibgroup", "collection")}
    monkeypatch.setattr(udfs, "_synonyms", known.get)
    got = udfs.intent("Papers by Smith about phd thesis rings since 1998", 2026)
    assert (got["doctype"], got["authors"], got["year_from"], got["free_text_terms"]) == (["article", "phdthesis"], ["Smith"], 1998, ["rings"])


@pytest.mark.parametrize("text, operator", [("KEY papers on x", "useful"), ("ſources cited by x", "references"), ("keypapers", None), ("works like it", "similar"), ("", None)])
def test_phrases_of_either_case_are_found_in_small_letters(text, operator):
    from corpusforge.functions import udfs

    assert udfs.take_operator(text)[0] == operator and udfs._says_any_phrase(text) == (operator is not None)


def test_bibcodes_are_sought_in_the_dealt_tasks(spark, sf):
    x = plan(registry.QUERIES["strict_fixes"](spark, sf)).split("\n\n")[0]
    above, below = x.split("hashpartitioning(o_orderkey", 1)
    assert "RLIKE" in above and "RLIKE" not in below and "(?!" not in above


def test_a_service_without_a_delay_is_asked_without_a_pause(monkeypatch):
    import pyarrow as pa

    from corpusforge.sources import search

    def never(_):
        raise AssertionError

    monkeypatch.setattr(search.time, "sleep", never)
    ask = search._each("corpusforge.sources.search:ruled", {"rules": [["a", 400, 0, "no"]]}, 0, "", 1, 0.0, 0.0)
    (out,) = ask(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", "b", None])], names=["id", "query"])]))
    assert out.column(2).to_pylist() == [400, 200, 400] and out.column(4).to_pylist() == ["no", "", "no query"]


def test_a_cache_of_several_versions_is_made_in_one_pass(spark, sf):
    assert plan(registry.QUERIES["cached_validation"](spark, sf)).split("\n\n")[0].count("FileScan parquet") == 6


@pytest.mark.parametrize("q", ["a((b(c", "x: (y) citations ((z)", "pos (a) title: (b)(c", "\u00e9: (x", "(a", "a(b(c): (d similar (("])
def test_parentheses_of_a_query_in_its_one_form(spark, q):
    want = re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", q))
    want = re.sub(r"(?a)(\w): \(", r"\1:(", re.sub(r"(\S)\((?!\()", r"\1 (", want))
    want = re.sub(rf"({qlang._CALLS}) \(", r"\1(", want)
    assert spark.createDataFrame([(q,)], "q string").select(qlang.canonicalize(F.col("q")).alias("c")).first().c == want
