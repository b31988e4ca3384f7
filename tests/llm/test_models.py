"""Language, toxicity and licence models: held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import langid, licenses, toxicity
from corpusforge.llm.convnet import ConvNet

VOCAB = {"aa": "the of and tion with ing rea ous", "bb": "der und schön ist ung lich keit", "cc": "los que ñez ción del asa ría"}


def doc(r, lang, n):
    parts = VOCAB[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randrange(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(3)
    rows = []
    for i in range(600):
        lang = r.choice(list(VOCAB))
        words = doc(r, lang, r.randrange(20, 120)).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), {"aa": "scoundrel", "bb": "lumpenhund", "cc": "malvado"}[lang] + r.choice(["", "!", "s"]))
        rows.append((i, " ".join(words), lang, int(bad)))
    return rows


def test_language_held_out_accuracy(spark, labelled):
    df = spark.createDataFrame([r[:3] for r in labelled], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 300"))
    got = {r.doc_id: r for r in langid.predict(df.where("doc_id >= 300"), model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in labelled if i >= 300]
    assert np.mean(right) >= 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark, labelled):
    train = spark.createDataFrame([r[:3] for r in labelled[:300]] + [(1000, None, "aa"), (1001, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 4"), (4, "Ñ"), (None, "der und der"), (6, "the of and " * 60_000)], "doc_id long, text string")
    odd = odd.withColumns({"lang": F.lit("zz"), "lang_pred": F.lit("no"), "score": F.lit(9), "letters": F.lit(1)})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in VOCAB and got[None][0] == "bb" and got[6][0] == "aa"
    assert langid.train(train.limit(0)) is None
    assert [r.lang_pred for r in langid.predict(odd.where("doc_id = 4"), None).collect()] == ["und"]
    assert langid.predict(odd.limit(0), model).collect() == []


def test_language_ignores_labels_of_the_predicted(spark, labelled):
    df = spark.createDataFrame([r[:3] for r in labelled], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 200"))
    a = langid.predict(df, model).orderBy("doc_id").collect()
    b = langid.predict(df.withColumn("lang", F.lit("aa")), model).orderBy("doc_id").collect()
    assert a == b


def test_windows_cover_whole_texts():
    data = np.arange(1, 251, dtype=np.uint8).repeat(3)
    x, of, length = langid.windows(data, np.array([0, 0, 300, 750]))
    assert of.tolist() == [1, 1, 2, 2] and length.tolist() == [256, 44, 256, 194]
    assert b"".join(row[:n].tobytes() for row, n in zip(x, length)) == data.tobytes()


def test_table_lookup_equals_convolution(labelled):
    net = ConvNet(256, 3, embed=5, widths=(2, 3, 4), filters=4, seed=9)
    model = langid.LanguageModel(["aa", "bb", "cc"], net)
    x = np.random.default_rng(0).integers(1, 255, (3, langid.WINDOW)).astype(np.uint8)
    single = net.embedding.copy()
    out = []
    for row in x:
        e = single[row]
        pooled = []
        for k, kern in zip(net.widths, net.kernels):
            pooled.append(max_over(e, kern, k))
        out.append(np.concatenate(pooled))
    z = np.maximum(np.array(out) + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(model.window_logs(x), want, atol=1e-3)


def max_over(e, kern, k):
    full = [sum(e[i + j] @ kern[j] for j in range(k)) for i in range(len(e) - k + 1)]
    tail = [sum(e[i + j] @ kern[j] for j in range(k) if i + j < len(e)) for i in range(len(e) - k + 1, len(e))]
    return np.max(full + tail, 0)


def test_toxicity_held_out(spark, labelled):
    docs = spark.createDataFrame([r[:3] for r in labelled], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in labelled if r[0] < 450], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in labelled if r[0] >= 450]
    assert np.mean([got[i].predicted == y for i, _, _, y in held]) >= 0.97
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_edges(spark, labelled):
    docs = spark.createDataFrame([r[:3] for r in labelled[:200]] + [(None, None, None), (900, "", "aa"), (901, "a " * 100_000, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in labelled[:200]] + [(3, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    extra = docs.withColumns({"score": F.lit("s"), "predicted": F.lit(None), "toxic": F.lit(1)})
    got = toxicity.score(extra, model).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(extra, labels)
    assert kept.columns == extra.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_of_a_text_depends_on_it_alone(spark, labelled, monkeypatch):
    docs = spark.createDataFrame([r[:3] for r in labelled[:300]], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[3]) for r in labelled[:300]], "doc_id long, toxic int"))
    texts = [r[1] for r in labelled[300:340]] + ["", " ".join(r[1] for r in labelled[:120]), "x"]

    def score(some):
        raw = [t.encode() for t in some]
        return model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    alone = np.array([score([t])[0] for t in texts])
    assert np.allclose(score(texts), alone, atol=1e-6) and np.allclose(score(texts[::-1])[::-1], alone, atol=1e-6)
    monkeypatch.setattr(toxicity, "STRETCH", 7)  # stretch by stretch, the maxima are the same
    assert np.allclose(score(texts), alone, atol=1e-5)


def test_licence_paragraphs_match_the_plain_model(spark):
    model = licenses.LicenceModel()
    lines = [
        "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "a license plate", "license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "licensed under the terms of our own license version 2.0", "Lizenz license " * 40, "¿license?",
    ]
    got = {r.paragraph: (r.family, round(r.probability, 9), r.confirmed) for r in licenses.classify_paragraphs(spark.createDataFrame([(x,) for x in lines], "paragraph string"), model).collect()}
    want = {x: (f, round(p, 9), c) for x in lines for f, p, c in [model.classify(x)]}
    assert got == want
    assert [want[x][0] for x in lines[:4]] == ["CC-BY-NC", "MIT", "Apache-2.0", "GPL"] and all(want[x][2] for x in lines[:4])
    assert all(want[x][0] == "unknown" for x in lines[4:7])


def test_licence_templates_are_recognised():
    model = licenses.LicenceModel()
    right = [model.classify(t)[0] == f and model.classify(t)[2] for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert np.mean(right) >= 0.95
    assert np.mean([model.classify(t)[0] == "unknown" for t in licenses.LOOK_ALIKES]) >= 0.9


def test_licence_scan_edges(spark):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny\nReleased under the MIT License."), (2, None), (3, ""), (None, "Released under the MIT License."), (4, "no notice"), (5, "license"), (5, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    df = df.withColumns({"families": F.lit(1), "paragraph": F.lit("p"), "gram": F.lit("g")})
    got = sorted(((r.doc_id, r.n_candidates, r.n_confirmed, r.n_unknown, tuple(r.families)) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, 2, 2, 0, ("MIT",)), (2, 0, 0, 0, ()), (3, 0, 0, 0, ()), (None, 0, 0, 0, ()), (4, 0, 0, 0, ()), (5, 2, 1, 1, ("CC-BY-NC",)), (5, 2, 1, 1, ("CC-BY-NC",))], key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def test_wrapped_licence_notices_are_confirmed(spark):
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    narrow = "Permission\nis hereby\ngranted free\nof charge\nto any\nperson obtaining\na copy\nof this\nsoftware and\nassociated documentation\nfiles"
    apart = mit.replace("\n", "\n\n")
    long_line = "word " * 300 + "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n" + "word " * 300
    prose = "\n".join(["the sea and the work of a day"] * 40)
    rows = [(1, gpl), (2, mit), (3, bsd), (4, mpl), (5, narrow), (6, apart), (7, long_line), (8, f"{prose}\n{gpl}\n{prose}"), (9, prose), (10, f"{mit}\n\n{bsd}")]
    got = {r.doc_id: (r.n_confirmed, r.families) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    families = {1: ["GPL"], 2: ["MIT"], 3: ["BSD"], 4: ["MPL-2.0"], 5: ["MIT"], 6: [], 7: ["MIT"], 8: ["GPL"], 9: [], 10: ["BSD", "MIT"]}
    assert {k: v[1] for k, v in got.items()} == families
    assert all((n > 0) == bool(f) for n, f in got.values())


def test_no_confirmable_paragraph_is_without_a_marking_word():
    """Whatever pairs of a template are left out, enough of them hold a marking word."""
    model = licenses.LicenceModel()
    words = set(licenses.marking_words([p for _, _, p in model.templates]))
    for _, _, p in model.templates:
        assert sum(not words & set(q.split()) for q in p) < licenses.least_pairs(p)


def brute_licences(model, text):
    """(candidates, confirmed, unknown, families) of one text by the plain model, window by window."""
    cache = {}

    def of(p):
        if p not in cache:
            have = licenses.pairs(p)
            can = any(len(t & have) >= licenses.least_pairs(t) for _, _, t in model.templates)
            named = re.search(licenses.TRIGGER, p) is not None
            cache[p] = (*(model.classify(p) if can or named else ("unknown", 0.0, False)), named)
        return cache[p]

    found = []
    lines = (text or "").split("\n")
    words = [licenses._WORD.findall(line.lower()) for line in lines]
    for i, line in enumerate(lines):
        family, _, sure, named = of(line)
        if named or sure:
            found.append((family, sure))
        run, rest, n = " ".join(words[i][-licenses.REACH :]), [], 0
        for more in words[i + 1 :] if words[i] else ():
            if not more or n >= licenses.REACH:
                break
            head, n = run, n + len(more)
            more = " ".join(more[: licenses.REACH])
            run, rest = f"{run} {more}", [*rest, more]
            family, _, sure, _ = of(run)
            if sure and all(not (of(x)[2] and of(x)[0] == family) for x in (head, " ".join(rest))):
                found.append((family, sure))
    return len(found), sum(s for _, s in found), sum(f == "unknown" for f, _ in found), tuple(sorted({f for f, s in found if s}))


@pytest.mark.parametrize("broadcast", [licenses.BROADCAST_PARAGRAPHS, 0])
def test_licence_scan_matches_brute_force(spark, sf, monkeypatch, broadcast):
    """The whole query over the whole table, and the same texts with their lines wrapped."""
    monkeypatch.setattr(licenses, "BROADCAST_PARAGRAPHS", broadcast)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    some = [t for _, t in rows if t and re.search(licenses.TRIGGER, t)][:25]
    rows += [(100_000 + i, re.sub(r"((?:\S+ ){6})", "\\1\n", t)) for i, t in enumerate(some)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    model = licenses.LicenceModel()
    want = {i: brute_licences(model, t) for i, t in rows}
    assert {r.doc_id: (r.n_candidates, r.n_confirmed, r.n_unknown, tuple(r.families)) for r in got} == want
    assert all(sum(w[1] > 0 for i, w in want.items() if (i < 100_000) == own) >= 2 for own in (True, False))
