"""Functions and operators on small literals."""

import itertools
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions import qlang, text, udfs, vocab
from corpusforge.operators import alias, annotate, catalog, curate, enrich, evaluate, fixers, generate, link, stats


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


LINT = [
    ("", ["Empty query"]), ("   ", ["Empty query"]), (None, ["Empty query"]),
    ('author:"x', ["Unbalanced quotes"]), ("(abs:x", ["Unbalanced parentheses"]), ("pubdate:[2000 TO 2001", ["Unbalanced brackets"]),
    ("foo:bar abs:x", ["Unknown field prefix: foo"]), ("^author:x", []), ("^foo:x", ["Unknown field prefix: ^foo"]), ("05h23m34.6s:x", []),
    ("pubdate:[2000]", ["Invalid pubdate range syntax: [2000] (missing 'TO')"]), ("pubdate:[1 TO 2 TO 3]", ["Invalid pubdate range: [1 TO 2 TO 3]"]),
    ("AND abs:x", ["Query cannot start with AND/OR"]), ("abs:x not ", ["Query cannot end with boolean operator"]), ("abs:x AND or abs:y", ["Consecutive boolean operators"]),
    ('author:"a, b" abs:x pubdate:[2000 TO *]', []),
]


def test_lint(spark):
    got = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(LINT)], "i int, q string").select("i", qlang.lint(F.col("q")).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in LINT]


@pytest.mark.parametrize("nl, found", [("papers by author:x", ["contains 'author:'"]), ("see [a TO b] here", ["contains range syntax [X TO Y]"]), ("abc", ["too short (< 5 chars)"]), ("x" * 301, ["too long (> 300 chars)"]), ('"' * 7, ["too many quotes"]), ("^hawking papers", ["contains ^ prefix (first author syntax)"]), ("database:x y", ["contains 'collection:'"]), ("plain words", [])])
def test_nl_issues(spark, nl, found):
    assert one(spark, nl, qlang.nl_issues) == found


@pytest.mark.parametrize("q, wrong", [("doctype:memo", ["memo"]), ("doctype:ARTICLE", []), ('doctype:"bad one"', ["bad one"]), ('doctype:(article OR "x" or memo)', ["x", "memo"]), ("mydoctype:memo", []), ("doctype: article", [])])
def test_wrong_values(spark, q, wrong):
    assert one(spark, q, lambda c: qlang.wrong_values(c, "doctype")) == wrong


def test_assembly(spark):
    x = spark.createDataFrame([(["Hawking, S"], ["dark matter", "halo"], ["rocks", "sea ice"], 2000, None, ["JOURNAL", "Eprint", "article"])], "a array<string>, t array<string>, o array<string>, y int, z int, d array<string>")
    body = qlang.join_clauses(qlang.author_clause(F.col("a")), qlang.abstract_clause(F.col("t")), qlang.any_clause(F.col("o")), qlang.year_clause(F.col("y"), F.col("z")), qlang.enum_clause("doctype", F.col("d")))
    assert x.select(qlang.wrap(body, F.lit("citations")).alias("q")).first().q == 'citations(author:"Hawking, S" abs:"dark matter" abs:halo abs:(rocks OR "sea ice") pubdate:[2000 TO *] doctype:(article OR eprint))'
    assert x.select(qlang.wrap(F.lit(" "), F.lit("citations")).alias("q")).first().q == ""


@pytest.mark.parametrize(
    "query, fixed",
    [
        ("doctype:journal property:refereed", "property:refereed"),
        ("doctype:(article OR journal) abs:exoplanets", "doctype:article abs:exoplanets"),
        ("citationsauthor:x", "citations(author:x)"),
        ("trendingabs:exoplanet", "trending(abs:exoplanet)"),
        ("abs:x AND doctype:memo", "abs:x"),
        ("doctype:memo AND abs:x OR bibgroup:none", "abs:x"),
        ("abs:x AND doctype:memo AND property:refereed", "abs:x AND property:refereed"),
        ("abs:(dark matter)", "abs:dark matter"),
        ("citations(abs:x)", "citations(abs:x)"),
        ("abs:x)", "abs:x"),
        ("()", ""),
        (None, ""),
    ],
)
def test_constrain(query, fixed):
    assert udfs.constrain(query) == fixed


@given(st.text(alphabet='abx:() "ANDORNOT[]', max_size=40))
@settings(max_examples=200, deadline=None)
def test_constrain_balances_and_settles(q):
    out = udfs.constrain(q)
    assert out.count("(") == out.count(")") and out == out.strip()


INTENTS = [
    ("papers citing Einstein 1905", "citations", [], (None, None)),
    ("sources cited by the survey", "references", [], (None, None)),
    ("black holes by Hawking since 2010", None, ["Hawking"], (2010, 2026)),
    ("galaxies before 1990", None, [], (None, 1989)),
    ("work in the 1990s on dust", None, [], (1990, 1999)),
    ("stars from 2015 to 2020", None, [], (2015, 2020)),
    ("past 5 years of comets", None, [], (2021, 2026)),
    ("comets in 1799", None, [], (None, None)),
    ("citing is a topic here", None, [], (None, None)),
]


@pytest.mark.parametrize("text_, op, authors, years", INTENTS)
def test_intents(text_, op, authors, years):
    i = udfs.intent(text_, 2026)
    assert (i["operator"], i["authors"], (i["year_from"], i["year_to"])) == (op, authors, years)


def test_intent_values_and_topics():
    i = udfs.intent("refereed hubble articles on rocks or volcanoes in astrophysics", 2026)
    assert (i["property"], i["bibgroup"], i["doctype"], i["collection"]) == (["refereed"], ["HST"], ["article"], ["astronomy"])
    assert "volcanoes" in i["or_terms"][1] and i["confidence"]["or_topics"] == 0.85
    assert udfs.intent('author:"x"', 2026)["confidence"] == {"ads_passthrough": 1.0}
    assert udfs.intent("", 2026)["free_text_terms"] == []
    assert udfs.intent("sloan survey", 2026)["property"] == []  # "oa" is no word of it


@pytest.mark.parametrize(
    "query, fixed",
    [
        ('abs:"dark matter"', 'abs:"dark matter"'),
        ('abs:"observations of faint dwarf galaxies nearby"', "abs:(dwarf AND galaxies AND nearby)"),
        ('title: "the age of it"', "title:age"),
        ('abs:"a of it"', "abs:a"),
    ],
)
def test_break_phrase(spark, query, fixed):
    assert spark.range(1).select(fixers.shorter_phrases(F.lit(query))).first()[0] == fixed


@pytest.mark.parametrize(
    "query, fixed",
    [
        ("abs:(the mass of the brightest cluster galaxies)", "abs:(mass AND brightest AND cluster)"),
        ("abs:(dark OR light of the sun)", "abs:(dark OR light of the sun)"),
        ("abs:(three plain words)", "abs:(three plain words)"),
        ("abs:(dark matter)", "abs:(dark matter)"),
    ],
)
def test_title_to_terms(spark, query, fixed):
    assert spark.range(1).select(fixers.title_conjunctions(F.lit(query))).first()[0] == fixed


def test_allowed_values_as_expressions_and_as_scan(spark):
    r = random.Random(1)
    pieces = ["doctype:article", "doctype:memo", "Doctype:(article OR memo)", 'property:("refereed" or x)', 'bibgroup:"HST"', 'bibgroup: "none"', "doctype:", "abs:(doctype:memo)", "(", ")", " OR ", "xdoctype:memo", 'property:( refereed  OR  "openaccess" )', "é\n", "doctype:()"]
    queries = [r.choice(["", " "]).join(r.choices(pieces, k=r.randrange(0, 8))) for _ in range(400)]
    for fields in ((), ("doctype",)):
        got = [x[0] for x in spark.createDataFrame(list(enumerate(queries)), "i int, q string").orderBy("i").select(fixers.allowed_only(F.col("q"), *fields)).collect()]
        assert got == [udfs.keep_allowed(q, *fields) for q in queries]


@pytest.mark.parametrize("q, skip", [("citations(abs:x)", True), ('full:"1234"', True), ("abs:x year:16", True), ("abs:x year:2016", False), ("a OR b OR c OR d OR e", True), ("a OR b OR c OR d", False), ("abs:my diary", True), ("*:*", True), ("abs:dust", False)])
def test_skip(spark, q, skip):
    assert one(spark, q, curate.skip_query) is skip


def test_semantic_match(spark):
    df = spark.createDataFrame([('citations(abs:x) author:"A b"', 'author:"a B" abs:y', False), ("abs:x year:1", "year:1", True), ("", "z", True)], "e string, a string, w boolean")
    assert df.where(qlang.semantic_match(F.col("e"), F.col("a")) != F.col("w")).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcé", max_size=30), st.text("abcé", max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert udfs.lcs_length(a, b) == lcs(a, b)


def test_fuzzy_links_match_brute_force(spark):
    r = random.Random(1)
    names = ["".join(r.choices("abcde ", k=r.randrange(3, 14))).strip() or "a" for _ in range(80)]
    entries = [(f"id{i}", n, [], "topic", i) for i, n in enumerate(names)]
    spans = [(i, n[: k % len(n)] + r.choice("abz") + n[k % len(n) :] if k % 3 else n.upper(), "topic" if k % 5 else "author") for i, (k, n) in enumerate(itertools.islice(enumerate(names * 2), 120))]
    index = link.linking_index(spark.createDataFrame(entries, "id string, label string, aliases array<string>, type string, ord int"))
    got = {x.span_id: x.canonical_id for x in link.link_fuzzy(spark.createDataFrame(spans, "span_id int, surface string, type string"), index).collect()}
    want, first = {}, {}
    for i, n in enumerate(names):
        first.setdefault(n.lower(), f"id{i}")
    for i, s, kind in spans:
        scored = [(round(udfs.indel_similarity(s.lower(), n), 9), -k, c) for k, (n, c) in enumerate(first.items())]
        best = max(scored)
        if kind == "topic" and best[0] >= 0.85:
            want[i] = best[2]
    assert got == want


def test_annotation(spark):
    entries = spark.createDataFrame([("t1", "dark matter", ["DM halo"], "topic", 1), ("t2", "dark matter halo", None, "topic", 2), ("t3", "matter", [], "topic", 3), ("t4", "DARK MATTER", [], "topic", 4), ("t5", "xy", [], "topic", 5), ("t6", "naïve", [], "topic", 6)], "id string, label string, aliases array<string>, type string, ord int")
    docs = spark.createDataFrame([(1, "Dark matter halo and dark matter; antimatter, matter."), (2, ""), (3, None), (4, "a naïve dm HALO, naïvely")], "doc_id long, text string")
    got = {r.doc_id: [(s.surface, s.start, s.end, s.canonical_id) for s in r.spans] for r in annotate.annotate(docs, annotate.keyword_index(entries)).collect()}
    assert got[1] == [("Dark matter halo", 0, 16, "t2"), ("dark matter", 21, 32, "t1"), ("matter", 46, 52, "t3")]
    assert got[2] == got[3] == []
    assert got[4] == [("naïve", 2, 7, "t6"), ("dm HALO", 8, 15, "t1")]


def test_spans_follow_the_cleaning():
    raw = "<p>The  <b>dark&amp;light</b>\tmatter</p> x"
    clean, spans = udfs.remap_spans(raw, [{"start": raw.index("dark"), "end": raw.index("</b>"), "type": "topic"}, {"start": 0, "end": 3, "type": "topic"}])
    assert clean == "The dark&light matter x"
    assert [(s["surface"], clean[s["start"] : s["end"]]) for s in spans] == [("dark&light", "dark&light")]


def test_offset_errors_and_tags(spark):
    x = spark.createDataFrame([("the dark star", [("dark", 4, 8, "entity"), ("star", 8, 12, "topic")])], "text string, spans array<struct<surface:string,start:int,end:int,type:string>>")
    r = x.select(annotate.offset_errors(F.col("text"), F.col("spans")).alias("e"), annotate.char_tags(F.col("text"), F.col("spans")).alias("t")).withColumn("k", annotate.token_tags(F.lit("the dark star"), F.col("t"))).first()
    assert [(e.surface, e.found) for e in r.e] == [("star", " sta")]
    assert r.t[3:9] == ["O", "B-institution", "I-institution", "I-institution", "I-institution", "B-topic"]
    assert [(k.token, k.start, k.tag) for k in r.k] == [("the", 0, "O"), ("dark", 4, "B-institution"), ("star", 9, "I-topic")]


def greedy(pred, gold, least):
    used, out = set(), set()
    for i, p in enumerate(pred):
        for j, g in enumerate(gold):
            inter = min(p[1], g[1]) - max(p[0], g[0])
            if j not in used and p[2] == g[2] and inter > 0 and inter / (p[1] - p[0] + g[1] - g[0] - inter) >= least:
                used.add(j)
                out.add((i, j))
                break
    return out


def test_partial_matches_are_greedy(spark):
    r = random.Random(2)
    make = lambda: [(a, a + r.randrange(1, 12), r.choice("xy")) for a in sorted(r.randrange(60) for _ in range(25))]
    for _ in range(5):
        pred, gold = make(), make()
        kind = "doc_id int, ord int, start int, end int, type string"
        frames = [spark.createDataFrame([(1, i, *s) for i, s in enumerate(v)], kind) for v in (pred, gold)]
        assert {(m.p_ord, m.g_ord) for m in evaluate.partial_matches(*frames).collect()} == greedy(pred, gold, 0.5)


def test_scores_without_gold(spark):
    p, r, f = stats.prf(F.lit(0), F.lit(3), F.lit(0))
    assert tuple(spark.range(1).select(p, r, f).first()) == (0.0, 0.0, 0.0)


def test_quantiles(spark):
    import statistics

    vals = [float(v) for v in random.Random(3).choices(range(500), k=333)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 5.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in stats.latency(df, "k", "v").collect()}
    s = sorted(vals)
    assert (got["a"].p50, got["a"].p90, got["a"].p99) == (s[int(333 * 0.5)], s[int(333 * 0.9)], s[int(333 * 0.99)]) and got["b"].p99 == 5.0
    x = {r.k: r for r in stats.latency_exclusive(df, "k", "v").collect()}
    q = statistics.quantiles(vals, n=100)
    assert abs(x["a"].p95 - q[94]) < 1e-3 and abs(x["a"].p99 - q[98]) < 1e-3 and x["b"].p50 == 5.0


@pytest.mark.parametrize("a, b, want", [([], [], (1.0, 1.0, 1.0)), (["x"], [], (0.0, 0.0, 0.0)), (["x", "y"], ["y", "z", "w"], (0.25, 0.333333, 0.5))])
def test_overlap(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert tuple(df.select(stats.overlap(F.col("a"), F.col("b")).alias("o")).first().o) == want


def test_curation(spark):
    rows = [
        ("papers on dust", "abs:dust", "fix"), ("dust", "2022A&A...658L..10L", "remove"), ("dust since 1999", "abs:dust pubdate:[2001 TO 2002] doctype:article", "review"),
        ("dust", 'abs:"a b c d" doctype:article', "review"), ("dust", "abs:dust doctype:article", "keep"), ("dust", "abs:(The dust of the stars) doctype:article", "fix"),
    ]
    df = spark.createDataFrame(rows, "n string, q string, want string")
    got = df.select("want", curate.action(curate.problems(F.col("n"), F.col("q"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_dedup_merge_split_quota(spark):
    df = spark.createDataFrame([(1, " A b", "q1"), (2, "a B ", "q2"), (3, "c", "Q1"), (4, "d", "q4"), (5, None, None)], "id int, natural_language string, ads_query string")
    assert sorted(r.id for r in curate.dedup_two_keys(df, "id").collect()) == [1, 4, 5]
    assert sorted(r.id for r in curate.new_only(df.where("id > 1"), df.where("id = 1"), "natural_language", "id").collect()) == [3, 4, 5]
    n = spark.range(107).withColumnRenamed("id", "k")
    s = [r.n for r in curate.split(n, "k").groupBy("split").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()]
    assert sorted(s) == [10, 12, 85]
    q = curate.quota_sample(n.withColumn("g", F.col("k") % 2), "g", [F.desc("k")], 3).collect()
    assert sorted(r.k for r in q) == [101, 102, 103, 104, 105, 106]


def test_mixed_radix_is_a_product(spark):
    got = [(r.a, r.b, r.c) for r in curate.mixed_radix(spark, {"a": 2, "b": 3, "c": 2}).orderBy("combo").collect()]
    assert got == [(a, b, c) for c in range(2) for b in range(3) for a in range(2)]


def test_aliases(spark):
    df = spark.createDataFrame([("Très Grand-Télescope", ["TGT", "tres grand-telescope", "Big Eye"])], "label string, aliases array<string>")
    got = df.select(alias.expand(F.col("label"), F.col("aliases")).alias("a")).first().a
    assert got == ["Très Grand Télescope", "Très-Grand-Télescope", "TG", "Tres Grand-Telescope", "Tres Grand Telescope", "Tres-Grand-Telescope", "TGT", "Big Eye", "Big-Eye", "BE"]
    assert udfs.strip_marks("Très Ångström") == "Tres Angstrom"


def test_html_and_urls(spark):
    assert one(spark, "<p>a<b>b</b> &lt;c&gt; \t d</p> \n", text.strip_html) == "ab <c> d"
    assert one(spark, "http://x/y#Z/", text.concept_id) == "Z"
    assert one(spark, "a%20b+c", text.url_decode) == "a b c" and one(spark, "%zz", text.url_decode) is None
    assert one(spark, "x, y", text.quote_if_needed) == '"x, y"' and one(spark, "xy", text.quote_if_needed) == "xy"
    assert one(spark, "citations ( abs:x )", qlang.canonicalize) == "citations(abs:x)"
    assert one(spark, 'author:"a b" abs:(x OR y) year:2000', lambda c: F.transform(qlang.field_values(c), lambda v: F.concat_ws("=", v["field"], v["value"]))) == ["author=a b", "abs=x OR y", "year=2000"]
    assert one(spark, "(a)AND(b) abs: (x)", qlang.canonicalize) == "(a)AND (b) abs:(x)"
    assert one(spark, "pubdate:[1 TO 2]", lambda c: F.transform(qlang.field_values(c), lambda v: v["value"])) == ["[1 TO 2]"]


def test_catalogs(spark):
    assert one(spark, ["B", " b ", "", "Label", "c"], lambda c: catalog.distinct_aliases(F.lit("label"), c), "array<string>") == ["B", "c"]
    assert [one(spark, v, enrich.vocabulary_of) for v in ("UAT:1", "ror:x", "zz:1", "")] == ["uat", "ror", "unknown", "unknown"]
    assert one(spark, ["uat", "sweet", "gcmd"], enrich.domains_of, "array<string>") == ["astronomy", "earthscience"]
    assert one(spark, [], enrich.domains_of, "array<string>") == ["unknown"]


def test_templates_and_picks(spark):
    df = spark.createDataFrame([(i, f"Topic {i}", "topic") for i in range(50)], "id string, label string, type string")
    s = generate.snippets(df, ["On {label}.", "{label} again"])
    assert s.select(annotate.offset_errors(F.col("text"), F.col("spans")).alias("e")).where("size(e) > 0").count() == 0
    inputs = spark.createDataFrame([(1, "a"), (2, "z")], "i int, template_id string")
    good, bad = generate.join_templates(inputs, spark.createDataFrame([("a", "x")], "template_id string, t string"))
    assert [r.i for r in good.collect()] == [1] and [r.i for r in bad.collect()] == [2]
    r = generate.round_robin(spark.range(5).withColumnRenamed("id", "k"), spark.createDataFrame([("p",), ("q",)], "v string"), "k", "v")
    assert [x.v for x in r.orderBy("k").collect()] == ["p", "q", "p", "q", "p"]


def test_vocabulary_has_all_values():
    assert [len(vocab.ENUMS[k]) for k in ("doctype", "property", "collection", "bibgroup", "esources", "data")] == [22, 21, 4, 55, 8, 24]
    assert len(vocab.FIELDS) == len(set(vocab.FIELDS)) and [len(v) for v in vocab.OPERATOR_PHRASES.values()] == [17, 16, 20, 18, 19, 19]


def dbf(rows, fields):
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(fields), size)
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    return head + b"".join((b"*" if gone else b" ") + b"".join(v.encode().ljust(w) for v, (_, w) in zip(vals, fields)) for gone, vals in rows)


def test_dbf(tmp_path, spark):
    from corpusforge.sources import readers

    (tmp_path / "x.dbf").write_bytes(dbf([(False, ["Tycho", "86.2"]), (True, ["gone", "1"]), (False, ["Ésa", ""])], [("clean_name", 12), ("diameter", 6)]))
    assert [r.fields for r in readers.dbf(spark, str(tmp_path / "x.dbf")).collect()] == [{"clean_name": "Tycho", "diameter": "86.2"}, {"clean_name": "Ésa", "diameter": ""}]


def test_review(spark):
    from corpusforge.operators import validate

    rows = [
        ("dust by Hawking", 'author:"Hawking, S." abs:dust doctype:article', "x", ["author_initials:critical"], "fix"),
        ("dust by Hawking S.", 'author:"Hawking, S." abs:dust doctype:article', "x", [], "keep"),
        ("papers on dust", "abs:dust", "unfielded", ["category:medium", "missing_doctype:medium"], "review"),
        ("dust", "2022A&A...658L..10L", "x", ["bibcode_lookup:critical"], "remove"),
        ("dust", "abs:dust AND doctype:memo AND", "x", ["syntax:high", "hallucination:high"], "fix"),
        ("by someone", "abs:(the Albert Einstein) doctype:article", "x", ["alignment:high"], "fix"),
    ]
    df = spark.createDataFrame(rows, "n string, q string, c string, want array<string>, action string").withColumn("i", validate.review(F.col("n"), F.col("q"), F.col("c")))
    for r in df.withColumn("a", validate.review_action(F.col("i"))).collect():
        assert ([f"{i.type}:{i.severity}" for i in r.i], r.a) == (r.want, r.action), r.q


def test_resolution(spark):
    from corpusforge.operators import validate

    rows = [("citations", None, "citing the paper about dark matter, from nature", True, "dark matter nature"), ("citations", "x", "the paper", False, None), ("useful", None, "this paper", False, None), ("similar", None, "Einstein's classic paper", True, "einstein's"), (None, None, "this paper", False, None), ("references", None, "the 1905 paper", False, "year:1905")]
    df = spark.createDataFrame(rows, "op string, t string, x string, need boolean, hint string")
    for r in df.withColumns({"n": validate.needs_resolution(F.col("op"), F.col("t"), F.col("x")), "h": validate.paper_hint(F.col("x"))}).collect():
        assert (r.n, r.h) == (r.need, r.hint), r.x
    assert [one(spark, e, validate.remote_error) for e in ("Parse error at 1", "429 rate limit", "read timeout", "401", "connection refused", "other")] == ["parse_error", "rate_limit", "timeout", "auth_error", "network_error", "api_error"]
    assert tuple(spark.range(1).select(validate.go_no_go(F.lit(0.9), F.lit(0.1), 0.8, 0.5), validate.go_no_go(F.lit(0.9), F.lit(None).cast("double"), 0.8, 0.5), validate.go_no_go(F.lit(0.9), F.lit(0.6), 0.8, 0.5), validate.go_no_go(F.lit(0.1), F.lit(0.6), 0.8, 0.5)).first()) == ("CONDITIONAL GO", "CONDITIONAL GO", "GO", "NO GO")


def test_cascade_goes_on_to_embeddings(spark):
    entries = spark.createDataFrame([("a", "dark matter", [], "topic", 0), ("b", "black holes", [], "topic", 1)], "id string, label string, aliases array<string>, type string, ord long")
    vectors = spark.createDataFrame([("a", "topic", [1.0, 0.0], 0), ("b", "topic", [0.0, 1.0], 1)], "canonical_id string, type string, embedding array<double>, ord long")
    spans = [(1, "Dark Matter", "topic", [0.0, 1.0]), (2, "dark mattr", "topic", [0.0, 1.0]), (3, "collapsed stars", "topic", [0.1, 0.9]), (4, "unrelated", "topic", [0.7, -0.7]), (5, "no vector", "topic", None), (6, "other", "author", [0.0, 1.0])]
    spans = spark.createDataFrame(spans, "span_id long, surface string, type string, embedding array<double>")
    index = link.linking_index(entries)
    got = {r.span_id: (r.canonical_id, r.match_type) for r in link.link_cascade(spans, index, vectors).collect()}
    none = (None, "unlinked")
    assert got == {1: ("a", "exact"), 2: ("a", "fuzzy"), 3: ("b", "embedding"), 4: none, 5: none, 6: none}
    assert {r.span_id for r in link.link_cascade(spans, index).where("match_type = 'unlinked'").collect()} == {3, 4, 5, 6}


def test_surfaces_that_begin_with_a_sign_are_found(spark):
    labels = ['"G. d\'Annunzio" University', "(1) Ceres", "....", "-->x", "plain", "_tmp_"]
    index = annotate.keyword_index(spark.createDataFrame([(f"e{i}", x, [], "topic", i) for i, x in enumerate(labels)], "id string, label string, aliases array<string>, type string, ord int"))
    texts = ['The "g. d\'annunzio" university (1) ceres and (1) Cerestes', "(1) Ceres", "end ..... a....b -->X", "1) Ceres, plain 𝒜 _TMP_ x_tmp_", None, "....", 'g. d\'annunzio" university']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    border = lambda t, a, b: not (a > 0 and t[a - 1].isalnum()) and not t[b : b + 1].isalnum()
    want = sorted((i, x.lower(), a) for i, t in enumerate(texts) if t for x in labels for a in range(len(t)) if t.lower().startswith(x.lower(), a) and border(t, a, a + len(x)))
    got = sorted((r.doc_id, r.surface_lc, r.start) for r in annotate.candidates(docs, index).collect())
    assert got == want and {x for _, x, _ in want} == {x.lower() for x in labels}


def test_all_record_types_have_rules(spark):
    from corpusforge.operators import validate

    assert len(validate.RECORDS) == 14  # thirteen types, and the slots within templates
    one = "array<struct<id:string,type:string,url:string,retrieved_at:string>>"
    rows = [("m", "2026-01-02T03:04:05", [("a", "git", "u", None)]), ("n", "yesterday", [("a", "git", "u", None), (" ", "ftp", "u", "soon")]), ("o", None, None)]
    df = spark.createDataFrame(rows, f"id string, generated_at string, sources {one}")
    got = {r.id: r.e for r in df.select("id", validate.record_errors(df, "source_manifest").alias("e")).collect()}
    assert got == {"m": [], "n": ["generated_at is no ISO time", "sources: id is required", "sources: type is none of git, http", "sources: retrieved_at is no ISO time"], "o": ["sources is required"]}
    df = spark.createDataFrame([("r", "2026-01-02T03:04:05Z", "", "done", ["a", " "], [("p", "", -1, None)], None)], "run_id string, created_at string, run_directory string, status string, stages_completed array<string>, artifacts array<struct<path:string,checksum_sha256:string,size_bytes:long,line_count:int>>, reproduce struct<pinned_revisions:map<string,string>>")
    assert df.select(validate.record_errors(df, "run_manifest")).first()[0] == ["status is none of completed, failed, in_progress, pending", "stages_completed has a blank item", "artifacts: checksum_sha256 is required", "artifacts: size_bytes is negative"]
    df = spark.createDataFrame([("t", "i", [], "q")], "id string, intent string, nl_templates array<string>, ads_query_template string")
    assert df.select(validate.record_errors(df, "template")).first()[0] == ["nl_templates is empty", "slots is required", "constraints is required"]
    df = spark.createDataFrame([(-1, 1.5)], "sources_count int, backend_pass_rate double")
    e = df.select(validate.record_errors(df, "report")).first()[0]
    assert e[0] == "sources_count is negative" and "backend_pass_rate is outside 0 to 1" in e and "topics_count is required" in e


def test_moved_spans_with_and_without_parity():
    text = "<p>a  <b>bc</b> &amp;  dé</p>"
    spans = [{"start": text.index("dé"), "end": text.index("dé") + 2, "type": "topic"}]
    assert udfs.remap_spans(text, spans) == ("a bc & dé", [{"start": 7, "end": 9, "type": "topic", "surface": "dé"}])
    assert udfs.remap_spans(text, spans, parity=True)[1][0]["start"] == 9  # two lost blanks further on


def test_trees_of_any_depth_and_cycles(spark):
    from corpusforge.operators import catalog

    chain = [(str(i), str(i - 1) if i else None, f"n {i}") for i in range(60)] + [("x", "nowhere", "lost"), ("y", "x", "lost too")]
    got = {r.id: (r.depth, r.path_id) for r in catalog.tree_paths(spark, spark.createDataFrame(chain, "id string, parent string, name string")).collect()}
    assert got == {str(i): (i, "/".join(f"n_{k}" for k in range(i + 1))) for i in range(60)}
    with pytest.raises(ValueError, match="cycle"):
        catalog.tree_paths(spark, spark.createDataFrame([("a", "b", "a"), ("b", "a", "b"), ("r", None, "r")], "id string, parent string, name string"))
