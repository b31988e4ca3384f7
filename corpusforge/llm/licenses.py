"""Licence families of paragraphs: sparse n-gram regression, confirmed by templates.

A paragraph is a line of a text, or a run of lines without a blank one between them, as
notices are often wrapped: words of one notice count over line ends if they lie within
``REACH`` words, about twice the longest template. Its distinct word 1- to 3-grams are the features of a
softmax regression over licence families and an unknown class, trained in numpy on
perturbed templates and, as unknown, on look-alikes that name no licence, on notices of other licences, on
notices whose name is another word and on negations. A temperature and a
least probability, set on examples with other licences, names and negations than those, make a doubtful
paragraph unknown, as does a name of the predicted family that is not there, or a negation before
it; and a predicted family is confirmed only if the paragraph holds enough of one of that family's
templates. A line with a trigger word is always scored; other lines, and runs of lines, are
passed over before all their n-grams are made only if they hold too few word pairs of every
template to be confirmed. Scoring is DataFrame operations only, once for each distinct paragraph.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, store, table

# The usual notices of each family, in lower case.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "distributed under the terms of the apache license 2.0",
        "spdx license identifier apache 2.0",
    ],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "use of this source code is governed by a bsd style license",
        "spdx license identifier bsd 3 clause",
    ],
    "CC-BY": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "available under the creative commons attribution license",
    ],
    "CC-BY-NC": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "available under the creative commons attribution noncommercial license",
    ],
    "CC-BY-SA": [
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
        "text is available under the creative commons attribution sharealike license",
    ],
    "CC0": [
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "released under cc0 1.0 public domain dedication license",
        "this is free and unencumbered software released into the public domain no license",
    ],
    "GPL": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu gpl version 2",
        "released under the gpl v3 license",
        "spdx license identifier gpl 3.0 or later",
    ],
    "LGPL": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "licensed under the gnu lesser general public license version 2.1",
        "released under the lgpl v3 license",
    ],
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "spdx license identifier mit",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "licensed under the mozilla public license 2.0",
        "spdx license identifier mpl 2.0",
    ],
}
# Paragraphs of the same words that name no family.
LOOK_ALIKES = [
    "all rights reserved",
    "copyright the authors all rights reserved",
    "see the license file for details",
    "licensed to the customer under a commercial license agreement",
    "a license is required to drive a car in this country",
    "the license plate of the car was new",
    "no permission is needed to read the page",
    "this software is proprietary and may not be copied without permission",
    "the warranty is void without a license",
    "use of this site is subject to the terms of service",
    "redistribution of this text needs the permission of the publisher",
    "the public library is open and the work is free",
    "licensed under the terms of the agreement version 2.0",
    "copyright 2020 example company",
]
# Notices of licences that are none of the families; those of the second list are held out from training.
OTHERS = [
    "licensed under the eclipse public license 2.0",
    "made available under the terms of the eclipse public license version 2.0",
    "licensed under the gnu affero general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
    "released under the isc license",
    "licensed under the artistic license 2.0",
    "licensed under the european union public licence version 1.2",
    "distributed under the boost software license version 1.0",
    "licensed under cc by nd 4.0",
    "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    "licensed under the apache license version 1.1",
    "distributed under the terms of the zlib license",
    "spdx license identifier epl 2.0",
    "spdx license identifier agpl 3.0 or later",
]
OTHERS_HELD_OUT = [
    "licensed under the common development and distribution license version 1.0",
    "released under the microsoft public license",
    "licensed under the sil open font license version 1.1",
    "distributed under the terms of the academic free license version 3.0",
    "licensed under cc by nc nd 4.0",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license",
    "licensed under the mozilla public license 1.1",
    "made available under the universal permissive license",
    "spdx license identifier upl 1.0",
]
# What a notice says instead of being one; the second list is held out from training.
NEGATIONS = ["this project is not", "it is no longer", "the code was never", "files that are not"]
NEGATIONS_HELD_OUT = ["this package isn t", "parts are not yet", "the data cannot be"]
# How each family is named, as expressions over a paragraph's words with one blank between them.
NAMES = {
    "Apache-2.0": "apache (?:software )?(?:licen[cs]e )?(?:version |v )?v?2",
    "BSD": "bsd (?:[0-9] clause |style |type )?licen[cs]e|bsd [0-9] clause|[0-9] clause bsd|redistribution and use in source and binary forms",
    "CC-BY": "cc by(?! (?:nc|nd|sa))|creative commons attribution(?! (?:non ?commercial|no ?deriv|share ?alike))",
    "CC-BY-NC": "cc by nc(?! (?:nd|sa))|creative commons attribution non ?commercial(?! (?:no ?deriv|share ?alike))",
    "CC-BY-SA": "cc by sa|creative commons attribution share ?alike",
    "CC0": "cc0|cc zero|waived all copyright and related|free and unencumbered software released into the public domain",
    "GPL": "gnu general public licen[cs]e|gpl(?:v?[0-9])?",
    "LGPL": "gnu (?:lesser|library) general public licen[cs]e|lgpl(?:v?[0-9])?",
    "MIT": "mit (?:x11 )?licen[cs]e|licen[cs]e (?:identifier )?mit|under (?:the )?mit|permission is hereby granted free of charge",
    "MPL-2.0": "mozilla public licen[cs]e (?:version |v )?v?2|mpl (?:version |v )?v?2",
}
_WHOLE = "(?<![a-z0-9])(?:{})(?![a-z])"
#: A notice that is denied: a negation, perhaps some words between, what is done with a licence, and under it.
DENIED = _WHOLE.format(
    "(?:not|never|no longer|nor|isn t|aren t|wasn t|weren t|cannot|can t)(?: (?:be|been|being|yet|currently|now|longer|anymore|also|actually))*"
    "(?: (?:re)?(?:licen[cs]ed|released|distributed|available|covered|governed|offered|provided|published|shared|subject))? (?:under|by|to)"
)
TRIGGER = r"(?i)licen[cs]|copyright|copyleft|permission|redistribut|creative commons|public domain|waived"
UNKNOWN = "unknown"
#: Share of a template's word pairs that a paragraph must hold.
CONFIRM = 0.6
#: Words within which a notice that is wrapped over lines is looked for.
REACH = 64
#: Perturbed copies of each template for training, and as many again for calibration.
COPIES = 30
EPOCHS = 200
#: So many paragraphs are broadcast at most when their families go back to documents.
BROADCAST_PARAGRAPHS = 20_000
#: Parts that the documents of one paragraph are cut into beyond that.
PARTS = 16

_WORD = re.compile(r"[a-z0-9]+")


def grams(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def pairs(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}


def plain(text: str) -> str:
    """The words of a text with one blank between them."""
    return " ".join(_WORD.findall(text.lower()))


def named(text: str, family: str) -> bool:
    """Whether a text has the name of a family and doesn't deny it."""
    words = plain(text)
    return re.search(_WHOLE.format(NAMES[family]), words) is not None and re.search(DENIED, words) is None


def least_pairs(template: set[str]) -> int:
    """So many of a template's pairs make a paragraph hold enough of it."""
    return next(k for k in range(len(template) + 1) if k / len(template) >= CONFIRM)


def marking_words(templates: list[set[str]]) -> list[str]:
    """Words of which any paragraph that can be confirmed has one: in each template, the pairs
    without them are too few. Words that stand in few templates' pairs come last."""
    out: list[str] = []
    while short := [t for pp in templates if len(t := {q for q in pp if not set(q.split()) & set(out)}) >= least_pairs(pp)]:
        count: dict[str, int] = {}
        for q in (q for t in short for q in t):
            for w in set(q.split()) - _COMMON:
                count[w] = count.get(w, 0) + 1
        if not count:
            count = {w: 1 for t in short for q in t for w in q.split()}
        out.append(max(sorted(count), key=count.__getitem__))
    return out


#: Common words mark a paragraph only if a template has no others.
_COMMON = {"the", "of", "in", "and", "to", "is", "a", "by", "this", "you", "it", "or", "as", "for", "any", "with", "that", "are", "not", "may", "at", "no", "be", "under", "on", "version", "work", "terms", *"0123456789"}


class LicenceModel:
    """``weights[gram]``: a number for each class; probabilities are softmax(scale * sum)."""

    def __init__(self, seed: int = 5):
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        self.templates = [(f, t, pairs(t)) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
        r = np.random.default_rng(seed)
        unknown = [*LOOK_ALIKES, *OTHERS, *(f"{n} {t}" for n in NEGATIONS for t in ("licensed under", "released under", "distributed under", "available under"))]
        vocabulary = sorted(set().union(*(grams(t) for _, t, _ in self.templates), *(grams(t) for t in unknown)))
        number = {g: i for i, g in enumerate(vocabulary)}
        fillers = sorted({w for t in LOOK_ALIKES for w in _WORD.findall(t)})
        naming = set(_WORD.findall(" ".join(NAMES.values()))) & {"apache", "bsd", "cc0", "gnu", "gpl", "lgpl", "lesser", "mit", "mozilla", "mpl", "creative", "commons", "cc"}

        def example(text: str, drop: float = 0.08) -> str:
            words = [w for w in _WORD.findall(text) if r.random() >= drop]
            extra = [str(w) for w in r.choice(fillers, r.integers(0, 5))]
            return " ".join([*extra[:2], *words, *extra[2:]])

        def examples(others: list[str], negations: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
            texts, y, none = [], [], len(self.classes) - 1
            for c, t in [(self.classes.index(f), t) for f, t, _ in self.templates] + [(none, t) for t in [*LOOK_ALIKES, *others]]:
                # Another licence without one of its words can be one of the families.
                texts += [example(t, 0.0 if t in others else 0.08) for _ in range(COPIES)]
                y += [c] * COPIES
            for _ in range(10 * COPIES):  # templates' words out of order name nothing
                _, t, _ = self.templates[r.integers(len(self.templates))]
                texts.append(" ".join(r.permutation(_WORD.findall(t))[:6]))
                y.append(none)
            for _, t, _ in self.templates:
                words = _WORD.findall(t)
                if naming & set(words):  # a notice of something else
                    texts += [example(" ".join("?" if w in naming else w for w in words)) for _ in range(COPIES)]
                    y += [none] * COPIES
                if words[0] in ("licensed", "released", "distributed", "available"):
                    texts += [f"{r.choice(negations)} {t}" for _ in range(COPIES // 2)]
                    y += [none] * (COPIES // 2)
            x = np.zeros((len(texts), len(vocabulary)), np.float32)
            for i, t in enumerate(texts):
                x[i, [number[g] for g in grams(t) if g in number]] = 1
            return texts, x, np.array(y)

        _, x, y = examples(OTHERS, NEGATIONS)
        w, b = np.zeros((len(vocabulary), len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        for k in range(EPOCHS):
            p = self._softmax(x @ w + b)
            p[np.arange(len(y)), y] -= 1
            rate = np.float32(8.0 / (1 + k / 100))
            w -= rate * (x.T @ p / np.float32(len(y)) + np.float32(2e-5) * w)
            b -= rate * p.mean(0)
        texts, x, y = examples(OTHERS_HELD_OUT, NEGATIONS_HELD_OUT)
        z = x @ w + b
        # Calibration, on unknown examples of other kinds: the scale of least loss, then the
        # least probability that, with the rule of names, keeps 99 in 100 of them unknown.
        scales = np.linspace(0.3, 3, 28)
        loss = [-np.log(np.maximum(self._softmax(s * z)[np.arange(len(y)), y], 1e-12)).mean() for s in scales]
        self.scale = float(scales[int(np.argmin(loss))])
        p = self._softmax(self.scale * z)
        own, none = p[:, :-1].argmax(1), y == len(self.classes) - 1
        wrong = [p[i, own[i]] if named(texts[i], self.classes[own[i]]) else 0.0 for i in np.flatnonzero(none)]
        self.least = float(min(0.9, max(0.5, np.quantile(wrong, 0.99))))
        self.weights = {g: [round(float(v), 6) for v in w[i]] for g, i in number.items()}
        self.bias = [round(float(v), 6) for v in b]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """``gram, w, t``: weights by class and the templates that have the gram as a pair.
        A fixed table of the templates' grams, made in the JVM."""
        rows = json.dumps([{"gram": g, "w": w, "t": [i for i, (_, _, p) in enumerate(self.templates) if g in p]} for g, w in self.weights.items()])
        return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<gram:string,w:array<double>,t:array<int>>>")))

    def classify(self, text: str) -> tuple[str, float, bool]:
        """(family, probability, confirmed) of one paragraph, as the DataFrame has it."""
        have = grams(text)
        z = np.array(self.bias)
        for g in have:
            z = z + np.array(self.weights.get(g, [0.0] * len(z)))
        p = self._softmax(self.scale * z[None])[0]
        k = int(p[:-1].argmax())
        share = max((len(t & have) / len(t) for f, _, t in self.templates if f == self.classes[k]), default=0)
        sure = named(text, self.classes[k]) and p[k] >= self.least
        return (self.classes[k] if sure else UNKNOWN), float(p[k]), bool(sure and share >= CONFIRM)


@functools.cache
def trained() -> LicenceModel:
    """The model of the templates, trained once in a process."""
    return LicenceModel()


def classify_paragraphs(lines: DataFrame, model: LicenceModel) -> DataFrame:
    """``paragraph, family, probability, confirmed`` for distinct non-null ``paragraph``s."""
    words = F.expr("regexp_extract_all(lower(paragraph), '[a-z0-9]+', 0)")
    x = lines.select("paragraph", words.alias("v"))
    two = F.expr("transform(sequence(0, greatest(size(v) - 2, 0)), i -> concat_ws(' ', slice(v, i + 1, 2)))")
    three = F.expr("transform(sequence(0, greatest(size(v) - 3, 0)), i -> concat_ws(' ', slice(v, i + 1, 3)))")
    x = x.select("paragraph", F.explode_outer(F.array_distinct(F.concat("v", two, three))).alias("gram"))
    x = x.join(F.broadcast(model.vocabulary(lines.sparkSession)), "gram", "left")
    n, k = len(model.classes), len(model.templates)
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(n)]
    hits = [F.count(F.when(F.array_contains("t", i), 1)).alias(f"h{i}") for i in range(k)]
    x = x.groupBy("paragraph").agg(*sums, *hits)
    z = [F.exp(model.scale * (F.col(f"z{i}") + model.bias[i])) for i in range(n)]
    total = sum(z[1:], z[0])
    best = F.array_max(F.array(*[F.struct((z[i] / total).alias("p"), F.lit(-i).alias("i")) for i in range(n - 1)]))
    share = {f: F.greatest(*v) if len(v) > 1 else v[0] for f in model.classes[:-1] if (v := [F.col(f"h{i}") / F.lit(float(len(p))) for i, (g, _, p) in enumerate(model.templates) if g == f])}
    x = x.withColumn("best", best).withColumn("own", F.element_at(F.array(*[F.lit(f) for f in model.classes[:-1]]), (1 - F.col("best.i")).cast("int")))
    match = F.coalesce(*[F.when(F.col("own") == f, s) for f, s in share.items()])
    plainly = F.array_join(F.expr("regexp_extract_all(lower(paragraph), '[a-z0-9]+', 0)"), " ")
    named = F.coalesce(*[F.when(F.col("own") == f, plainly.rlike(_WHOLE.format(NAMES[f]))) for f in share])
    sure = (F.col("best.p") >= model.least) & named & ~plainly.rlike(DENIED)
    return x.select("paragraph", F.when(sure, F.col("own")).otherwise(UNKNOWN).alias("family"), F.col("best.p").alias("probability"), (sure & (match >= CONFIRM)).alias("confirmed"))


def _confirmable(paragraph: Column, model: LicenceModel) -> Column:
    """Whether a paragraph holds enough pairs of any template."""
    marks = "|".join(marking_words([p for _, _, p in model.templates]))
    every = F.array(*[F.lit(q) for q in sorted(set().union(*(p for _, _, p in model.templates)))])
    words = F.regexp_extract_all(F.lower(paragraph), F.lit("[a-z0-9]+"), F.lit(0))

    def two(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(v, i + 1, F.lit(2))))

    rows = json.dumps([{"p": sorted(p), "k": least_pairs(p)} for _, _, p in model.templates])
    templates = F.from_json(F.lit(rows), "array<struct<p:array<string>,k:int>>")
    # The words are a variable, else they would be taken anew for each pair of a text.
    enough = F.exists(F.array(words), lambda v: F.exists(F.array(F.array_intersect(two(v), every)), lambda have: F.exists(templates, lambda t: F.size(F.array_intersect(have, t["p"])) >= t["k"])))
    return F.when(F.lower(paragraph).rlike(f"(?<![a-z0-9])(?:{marks})(?![a-z0-9])"), enough).otherwise(False)


def _runs(lines: Column) -> Column:
    """``paragraph, head, tail, before`` of every run of two lines or more within reach: its words,
    without those of its last line, and without those of its first; and the line before it."""
    word = F.lit("[a-z0-9]+")
    v = F.transform(lines, lambda t: F.regexp_extract_all(F.lower(t), word, F.lit(0)))
    v = F.transform(v, lambda w: F.struct(F.size(w).alias("n"), F.concat_ws(" ", F.slice(w, F.lit(1), F.lit(REACH))).alias("first"), F.concat_ws(" ", F.slice(w, F.greatest(F.size(w) - (REACH - 1), F.lit(1)), F.lit(REACH))).alias("last")))
    none = F.expr("cast(array() as array<struct<paragraph:string,head:string,tail:string,before:string>>)")

    def step(a: Column, x: Column) -> Column:
        goes_on = a["open"] & (x["n"] > 0) & (a["n"] < REACH)
        text, tail = F.concat_ws(" ", a["text"], x["first"]), F.concat_ws(" ", a["tail"], x["first"])
        run = F.struct(text.alias("paragraph"), a["text"].alias("head"), tail.alias("tail"), a["before"].alias("before"))
        return F.when(goes_on, F.struct(F.lit(True).alias("open"), (a["n"] + x["n"]).alias("n"), text.alias("text"), tail.alias("tail"), a["before"].alias("before"), F.concat(a["out"], F.array(run)).alias("out"))).otherwise(F.struct(F.lit(False).alias("open"), a["n"].alias("n"), a["text"].alias("text"), a["tail"].alias("tail"), a["before"].alias("before"), a["out"].alias("out")))

    def of(v: Column) -> Column:
        start = lambda x, i: F.struct((x["n"] > 0).alias("open"), F.lit(0).alias("n"), x["last"].alias("text"), F.lit(None).cast("string").alias("tail"), F.get(v, i - 1)["last"].alias("before"), none.alias("out"))
        return F.flatten(F.transform(v, lambda x, i: F.aggregate(F.slice(v, i + 2, F.lit(REACH)), start(x, i), step, lambda a: a["out"])))

    return F.flatten(F.transform(F.array(v), of))


def _denied_before(paragraph: Column, before: Column) -> Column:
    """Whether the line before ends with a denial, or with one that goes on in the paragraph."""
    words = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    last, first = F.regexp_extract(words(before), r"(?:[a-z0-9]+ ){0,9}[a-z0-9]+$", 0), F.regexp_extract(words(paragraph), "^(?:[a-z0-9]+ ){0,5}", 0)
    goes_on = F.concat(last, F.lit(" "), first).rlike(DENIED) & ~last.rlike(DENIED) & ~first.rlike(DENIED)
    return F.coalesce(last.rlike(f"{DENIED}(?: the| a| an| terms| of)*$") | goes_on, F.lit(False))


def _beside(lines: DataFrame, known: DataFrame, key: str, how: str, few: bool) -> DataFrame:
    """``lines`` joined with the distinct paragraphs of ``known``. Beyond a broadcast each of those goes to every
    part of its key, as a third of all documents may hold one and the same notice."""
    if few:
        return lines.join(F.broadcast(known), key, how)
    parts = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    lines = lines.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    return lines.join(parts, [key, "_part"], how).drop("_part")


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """``doc_id, n_candidates, n_confirmed, n_unknown, families, probability`` for every row of ``docs (doc_id, text)``.

    Candidates are the lines with a trigger word and all other paragraphs that are confirmed; a
    run of lines counts if it is confirmed for a family for which it is not without its first
    or without its last line. ``families`` are the confirmed ones,
    distinct and sorted, ``probability`` is the highest of a confirmed paragraph (null if there is
    none). Null and empty texts have no paragraph; rows that share a doc_id share their
    findings; a null doc_id has none. Ties between families go to the first by name. An empty
    table stays empty; further columns are not read."""
    model = model or trained()
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    some = docs.where(F.col("doc_id").isNotNull() & (F.col("text").rlike(TRIGGER) | _confirmable(F.col("text"), model))).select("doc_id", F.split("text", "\n").alias("lines"))
    lines = some.select("doc_id", F.explode(F.transform("lines", lambda t, i: F.struct(t.alias("paragraph"), F.get("lines", i - 1).alias("before")))).alias("r")).select("doc_id", "r.*")
    lines = lines.select("doc_id", "paragraph", *[F.lit(None).cast("string").alias(c) for c in ("head", "tail")], "before", F.col("paragraph").rlike(TRIGGER).alias("named"))
    lines = lines.where(F.col("named") | _confirmable(F.col("paragraph"), model))
    runs = some.select("doc_id", F.explode(_runs(F.col("lines"))).alias("r")).select("doc_id", "r.*", F.lit(False).alias("named")).where(_confirmable(F.col("paragraph"), model))
    lines = lines.unionByName(runs).withColumn("denied", _denied_before(F.col("paragraph"), F.col("before"))).drop("before")
    lines = store(lines.groupBy("doc_id", "paragraph", "head", "tail", "named", "denied").agg(F.count(F.lit(1)).alias("times")), "paragraphs")
    scored = lines.select(F.explode(F.array_distinct(F.array_compact(F.array("paragraph", "head", "tail")))).alias("paragraph")).distinct()
    known = store(classify_paragraphs(scored, model), "families")
    few = known.count() <= BROADCAST_PARAGRAPHS
    found = _beside(lines, known, "paragraph", "inner", few)
    # What the line before denies names nothing.
    found = found.withColumns({"confirmed": F.col("confirmed") & ~F.col("denied"), "family": F.when(F.col("denied"), UNKNOWN).otherwise(F.col("family"))}).drop("denied")
    for c in ("head", "tail"):
        sure = known.where("confirmed").select(F.col("paragraph").alias(c), F.col("family").alias(f"{c}_family"))
        found = _beside(found, sure, c, "left", few)
    whole = F.col("confirmed") & ~F.col("family").eqNullSafe(F.col("head_family")) & ~F.col("family").eqNullSafe(F.col("tail_family"))
    found = found.where(F.col("named") | whole)
    by_doc = found.groupBy("doc_id").agg(
        F.sum("times").alias("n_candidates"),
        F.sum(F.when(F.col("confirmed"), F.col("times")).otherwise(0)).alias("n_confirmed"),
        F.sum(F.when(F.col("family") == UNKNOWN, F.col("times")).otherwise(0)).alias("n_unknown"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.max(F.when(F.col("confirmed"), F.round("probability", 6))).alias("probability"),
    )
    by_doc = store(by_doc, "licences")
    ids = docs.select("doc_id")
    # Rows without an id have no findings: they are not sent to one task to learn that.
    out = ids.where("doc_id is not null").join(by_doc, "doc_id", "left")
    out = out.unionByName(ids.where("doc_id is null"), allowMissingColumns=True)
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_candidates", "n_confirmed", "n_unknown")}
    return out.withColumns(zero | {"families": F.coalesce("families", F.expr("cast(array() as array<string>)"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("families", F.concat_ws(",", "families"))
