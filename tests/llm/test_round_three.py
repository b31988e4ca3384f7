"""URL rules, audits of filters and hard negatives against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import audit, licenses, negatives, urlrules

RULES = "host string, path string, verdict string"


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match("([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.S).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, v in rules:
        h, p = h or "", p or ""
        h = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h)
        if not (h == "" or host == h or host.endswith("." + h)):
            continue
        head, *rest = p.split("*")
        at, ok = len(head), path.startswith(head)
        for x in rest:
            k = path.find(x, at)
            ok, at = ok and k >= 0, k + len(x)
        if ok and (p or True):
            fits.append((len(h + p), len(h), v == "block", h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("held", [urlrules.HELD_RULES, 0])
def test_url_rules_match_a_loop_over_all_rules(spark, held):
    r = random.Random(4)
    labels = ["com", "net", "example", "www", "a-b", "x", "é", "shop", "co"]
    hosts = [".".join(r.choices(labels, k=r.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en", "/english", "/fr/x.html", "/a.b/c", "/A/b", "/été/1", "/q(1)/[x]", "/en/\nb"]
    urls = [r.choice(["http://", "HTTPS://", "://", "x"]) + r.choice([h, h.upper()]) + r.choice(paths) + r.choice(["", "?u=http://y.com/en/", "#en/"]) for h in hosts for _ in range(12)]
    urls += [None, "", "://", "http://", "http://?x", "http://h://x/", "http://www.example.com:80/en/", "http://u@example.com/en/"] + ["http://www.example.com/en/1"] * 50
    rules = [*urlrules.RULES, ("Example.com", "", "block"), ("", "/fr/", "block"), ("", "/a.b/", "allow"), ("x", "/q(1)/[", "block"), ("com", "/*/1", "block"), ("net", "*b", "allow"), ("com", "/en", "block"), ("a-b.com", "/en/", "allow"), ("é", "/été", "block"), ("com", "/A", "block"), ("co", None, "allow"), ("com", "/", "allow")]
    rows = [(i % 500 if i % 7 else None, u, "v") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumns({"host": F.lit(1), "token": F.lit("t")})
    got = urlrules.judge(pages, spark.createDataFrame(rules, RULES), held_rules=held).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    want = [(i, *brute_url(u, rules)) for i, u, _ in rows]
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(want, key=key)
    tried = {x.host + x.path: x.n_candidates for x in got}
    assert max(tried.values()) < len(rules) and tried["www.example.com/en/1"] < 10


def test_url_rules_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert sorted(tuple(x) for x in urlrules.judge(pages.where("page_id = 1"), none, "block").collect()) == [(1, "a.com", "/", None, "block", 0)] * 2
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(urlrules.RULES, RULES)).collect() == []
    assert [tuple(x) for x in urlrules.judge(pages.where("page_id is null"), spark.createDataFrame(urlrules.RULES, RULES)).collect()] == [(None, "", "", None, "allow", 0)]
    for bad in (("a", "x", "allow"), ("a", "/", "maybe"), ("a", "/", None)):
        with pytest.raises(Exception, match="not a rule"):
            urlrules.judge(pages, spark.createDataFrame([bad], RULES)).collect()


def test_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://shop.example.com/en/{i}") for i in range(20)] + [(99, "http://rare.example.com/de/")], "page_id long, url string")
    rules = urlrules.compiled(spark.createDataFrame([("example.com", "/en/", "block"), ("rare.example.com", "/en/x", "block"), ("com", "/*tail", "block"), ("", "/pre", "block")], RULES))
    urls = pages.select(urlrules.host_of(F.col("url")).alias("host"), urlrules.path_of(F.col("url")).alias("path"))
    got = {x.rule: x.token for few in (True, False) for x in urlrules.indexed(rules, urls, few).collect()}
    assert got == {"example.com/en/": "en", "rare.example.com/en/x": "rare", "com/*tail": "com", "/pre": ""}


def test_swaps_visit_all_orders_once():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for i in audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))
        assert sum(1 for _ in audit.swaps(n)) == math.factorial(n) - 1


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q if k == 0 else t) == 1} for k in (0, 1))
    docs = []
    for d, text, source in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        first = min((x for x, t, _ in rows if (t or "") == text and x is not None), default=None)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": first is not None and (d is None or d > first),
        }
        docs.append((source or "", {f for f, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = [], {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                fails = sum(f in x[1] for x in mine)
                out.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_audit_matches_all_orders_run_one_by_one(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words[: r.choice([30, 400])], k=r.choice([5, 199, 200, 450]))) + r.choice(["", " A$", " ÉÉ\tx", "|", " " + "X" * 60]) for _ in range(60)]
    texts += [None, "", " \t", "a" * 50 + "B", "\U0001f600" * 49 + "A", "same", "same"]
    rows = [(r.choice([i, i, i % 11, None]), r.choice(texts), r.choice(["s1", "s1", "s1", "s2", "", None])) for i in range(400)] + [(9, "hot", "s1")] * 200 + [(None, "hot", "s3")] * 200
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit("m"), "n": F.lit(1), "quality": F.lit(1), "part": F.lit(2)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("t"), "salt": F.lit(3)})
    got = sorted(tuple(x) for x in audit.audit(docs.repartition(7), known).collect())
    assert got == brute_audit(rows, labels)
    assert audit.audit(docs.limit(0), known).collect() == []
    assert len(audit.audit(docs, known.limit(0)).collect()) == 600 * 4


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {tuple(x)[1:] for x in audit.audit(docs, labels, {"S": "words < 1"}, "R").collect()}
    assert got == {("SR", 1, 2, 1, 0, 1, 0, 0, 2), ("SR", 2, 1, 1, 0, 1, 1, 0, 2), ("RS", 1, 2, 1, 0, 1, 1, 0, 2), ("RS", 2, 1, 1, 0, 1, 0, 0, 2)}
    for bad in ({"AB": "true"}, {"R": "true"}, dict.fromkeys("ABCDEFGH", "true")):
        with pytest.raises(ValueError):
            audit.audit(docs, labels, bad, "R")


def brute_negatives(rows, every=100, positives=5, count=10):
    import collections

    ok = [(i, y, tuple(math.floor(v * 256) if abs(v) < 2**53 else int(v) * 256 for v in x)) for i, y, x in rows if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = collections.Counter()
    for n, (a, y, x) in enumerate(ok):
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, v, strict=True)), i, z) for m, (i, z, v) in enumerate(ok) if m != n and len(v) == len(x)), key=lambda s: s[:2])
        for s, i, _ in [q for q in scored if q[2] == y][:positives]:
            inside = [(j, -t) for t, j, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:count]
            out.update((a, i, k, j, cut(-s), cut(t)) for k, (j, t) in enumerate(inside, 1))
    return out


KIND = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize(("digit", "block"), [(9, 2048), (2, 3), (1, 1)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, digit, block):
    import collections

    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "SCORES", 200)
    r = np.random.default_rng(digit)
    centre = r.standard_normal(6)
    few = 150 if digit > 1 else 60
    every = 20
    rows = [(i, int(r.integers(3)), [float(v) for v in centre + 0.8 * r.standard_normal(6)]) for i in range(few)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(60)] + [rows[20]] * 3 + [(40, 1, rows[3][2]), (40, 2, rows[4][2])] + [rows[7]] * 5
    rows += [(2000, 1, None), (2020, None, [1.0] * 6), (2040, 1, [None] * 6), (2060, 1, [float("nan")] * 6), (2080, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (2100, 1, [0.5] * 3), (2101, 1, [0.25] * 3), (2102, 2, [0.125] * 3), (2120, 1, []), (2121, 2, []), (2122, 1, [])]
    df = spark.createDataFrame(rows, KIND).withColumns({"w": F.lit(1), "copies": F.lit("c"), "score": F.lit(0)})
    got = negatives.mine(df, F.col("vec_id") % every == 0, anchor_block=block).collect()
    want = brute_negatives(rows, every)
    assert want and collections.Counter(tuple(x) for x in got) == want


def test_hard_negatives_of_ties_and_scores_beyond_64_bits(spark):
    import collections

    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])] + [(100_000 - i, 2, [0.5, float(i % 2)]) for i in range(3000)]
    got = negatives.mine(spark.createDataFrame(rows, KIND).repartition(6), F.col("vec_id") == 0).collect()
    assert sorted(x.negative_id for x in got) == list(range(97_001, 97_011)) and {x.negative_score for x in got} == {32768}
    rows = [(0, 1, [3e9, 1.0]), (1, 1, [3e9, 2.0]), (2, 2, [1e9, 0.0]), (3, 2, [1.5e9, 0.0]), (4, 2, [1.0, 0.0])]
    for scale in (1.0, 1e20):
        big = [(i, y, [v * scale for v in x]) for i, y, x in rows]
        got = negatives.mine(spark.createDataFrame(big, KIND), F.col("vec_id") == 0).collect()
        assert collections.Counter(tuple(x) for x in got) == brute_negatives(big) and len(got) == 2


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0])], KIND)
    assert negatives.mine(one, F.col("vec_id") % 100 == 0).collect() == []
    against = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5]), (3, 2, [0.5])], KIND)
    assert negatives.mine(against, F.col("vec_id") % 100 == 0).collect() == []
    zero = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [0.0]), (2, 2, [0.0]), (3, 2, [0.5])], KIND)
    assert [tuple(x) for x in negatives.mine(zero, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 0, 0)]


#: Lines as people write them, none of which the model is trained on, with the family that they name.
LINES = [
    ("MIT", "Released under the MIT License (see LICENSE.txt for details)."),
    ("MIT", "Copyright (c) 2020 Jane Doe. Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This code is distributed under the terms of the Apache License 2.0, see NOTICE"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL", "Licensed under the GNU GPL, version 2"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Except where noted, content on this site is licensed under CC BY 4.0."),
    ("CC-BY-NC", "This article is licensed under CC BY-NC 4.0"),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http"),
    (None, "Licensed under the Eclipse Public License 2.0"),
    (None, "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    (None, "Licensed under the GNU Affero General Public License version 3"),
    (None, "This project is not licensed under the MIT license"),
    (None, "This file isn't available under the GPL v3 license any more"),
    (None, "Parts of it can't be licensed under the Apache License, Version 2.0"),
    (None, "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    (None, "Licensed under the Mozilla Public License 1.1"),
    (None, "Licensed under the Apache License, Version 1.1"),
    (None, "Released under the PostgreSQL license"),
    (None, "Licensed under the Python Software Foundation License Version 2"),
    (None, "Licensed under the Example Corp Commercial License version 2.0"),
    (None, "The MIT campus is open to the public, and no license is needed."),
    (None, "Copyright 2021 The Authors. All rights reserved."),
]


def test_licence_lines_are_what_they_name_and_nothing_else(spark):
    lines = [*LINES, *((None, t) for t in licenses.OTHERS_HELD_OUT), *((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
    rows = [(i, f"Intro text.\n\n{t}\n\nMore text.") for i, (_, t) in enumerate(lines)]
    rows += [(10_000 + i, "\n".join(re.findall(r"(?:\S+\s*){1,7}", t))) for i, (_, t) in enumerate(LINES)]  # the same, wrapped
    rows += [(None, LINES[0][1])] * 5
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {x.doc_id: list(x.families) for x in got if x.doc_id is not None}
    wrong = [(t, by[i]) for i, (f, t) in enumerate(lines) if by[i] != ([f] if f else [])]
    wrong += [(t, by[10_000 + i]) for i, (f, t) in enumerate(LINES) if by[10_000 + i] != ([f] if f else [])]
    assert wrong == []
    assert [(x.n_candidates, x.n_confirmed, x.families) for x in got if x.doc_id is None] == [(0, 0, [])] * 5


def test_the_language_sample_is_bounded_whatever_the_ids_are(spark, monkeypatch):
    from corpusforge.llm import langid

    seen = []
    monkeypatch.setattr(langid.ConvNet, "train", lambda self, texts, y, epochs: seen.append(len(y)))
    monkeypatch.setattr(langid.ConvNet, "forget", lambda self: None)
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("id")):
        docs = spark.range(400).select(ids.alias("doc_id"), F.format_string("text number %s", "id").alias("text"), F.when(F.col("id") < 5, "x").otherwise("y").alias("lang"))
        for sample in (350, 20):
            model = langid.train(docs, sample=sample)
            assert model.langs == ["x", "y"] and 2 * 2 <= seen.pop() <= 2 * (sample + 5)
