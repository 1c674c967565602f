"""The licence scan against the same rules in Python."""

import random
import re
from itertools import pairwise

import pytest

from paperloom.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def slow_spans(text):
    found = []
    for order, (label, words, rank, p) in enumerate(licenses.rules()):
        if all(w in text.lower() for w in words):  # wider than whole words, so a match that those miss would show
            found += [(m.start(), m.end(), rank, order, label) for m in re.compile(p, re.A).finditer(text)]
    better = lambda a, b: (-a[2], -(a[1] - a[0]), a[3]) < (-b[2], -(b[1] - b[0]), b[3])
    return sorted((s, e, p, label) for s, e, p, o, label in found if not any(a[0] <= s and e <= a[1] and a[2] >= p and better(a, (s, e, p, o)) for a in found))


def check(rows, texts):
    texts = {d: t or "" for d, t in texts}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t[:200]
        spans = slow_spans(t)
        if "spans" in r:
            assert sorted(map(tuple, r.spans)) == spans
        labels = {x for x in r.base_labels.split(",") if x} | {s[3] for s in spans}
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


TEXTS = [
    "", None, "MIT License", "x GNU-General\tPublic\n\nLicense, version 3.", "Apache License apache license, Apache  License", "cc by cc by-nc 4.0 CC BY", "mit licenses emit license", "émit license mit licenseé MIT LICENSE",
    "Licensed under the Apache License, Version 2.0. All rights reserved. SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU general public", "licensed under the GNU General Public License, version 3.",
    "word 😀 Apache License 😀 tail CC BY-SA 3.0", "license: mit", "MIT License. " * 400, "Kelvin K mit license", "a" * 50000 + " mit license", "Released under the terms of the Mozilla Public License 2.0, in the public domain",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (4, TEXTS[4], "c", 5)], "doc_id long, text string, labels string, n_words int")


def test_odd_rows(docs):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    check(rows, enumerate(TEXTS))
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.selectExpr("cast(null as bigint) doc_id", "text")).filter("doc_id is null").count() == len(rows)


def test_no_match_is_lost_to_the_keywords(spark):
    texts = [
        "Licensed under CC BY NC SA 4.0", "Licence CC BY NC", "licensed under cc-by\nnd 3.0", "CC by  SA license", "license CC\nBY_NC ND", "Creative Commons Attribution Non-Commercial 4.0 License", "Expat License",
        "under the terms of the GNU General Public License as published by the Free\n# Software Foundation", "in the public\ndomain", "All\nrights reserved", "Permission to\nuse, copy, modify, and/or distribute this software for any purpose",
        "Permission\nis hereby granted, free of charge, to any person obtaining a copy", "SIL Open\nFont License 1.1 licensed", "www apache org licenses LICENSE 2 0",
    ]
    assert all(re.fullmatch("[a-z0-9]+", w) for _, words, _, _ in licenses.rules() for w in words)
    every = [(label, rank, re.compile(p, re.A)) for label, _, rank, p in licenses.rules()]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        found = [(m.start(), m.end(), rank, label) for label, rank, p in every for m in p.finditer(texts[r.doc_id])]
        best = {f for f in found if not any(g[0] <= f[0] and f[1] <= g[1] and (g[2], g[1] - g[0]) > (f[2], f[1] - f[0]) and g[2] >= f[2] for g in found)}
        assert best and set(map(tuple, r.spans)) <= best and {(s, e, p) for s, e, p, _ in best} == {(m.s, m.e, m.p) for m in r.spans}, texts[r.doc_id]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op7_licenses(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert sum(r.n_base > 0 for r in rows) > 0


def written(tree, draw):
    """A text that a parsed regular expression matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "y"
        elif name == "IN":
            kinds = [x for x in arg if str(x[0]) in ("LITERAL", "RANGE")]
            out += " " if str(arg[0][0]) == "NEGATE" or any(str(k) == "RANGE" and v[0] <= 32 <= v[1] for k, v in kinds) else (lambda k, v: chr(v if str(k) == "LITERAL" else draw.randint(*v)))(*draw.choice(kinds))
        elif name == "BRANCH":
            out += written(draw.choice(arg[1]), draw)
        elif name == "SUBPATTERN":
            out += written(arg[3], draw)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(written(arg[2], draw) for _ in range(draw.randint(arg[0], min(arg[0] + 1, int(arg[1])))))
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_rules_are_many_ordered_and_each_match_holds_its_keywords(spark):
    signatures = licenses.SIGNATURES.strip().splitlines()
    r = licenses.rules()
    assert len(signatures) > 200 and len({x[3] for x in r}) == len(r) > 600
    ranks = [x[2] for x in r[len(signatures) :]]
    assert all(a >= b for a, b in pairwise(ranks))
    draw, texts = random.Random(1), []
    for _, words, _, p in r:
        for _ in range(6):
            t = written(re._parser.parse(p, re.A), draw)
            held = set(WORD.findall(t.translate(LOWER)))
            assert re.search(p, t, re.A) and all(held & set(licenses.WORDS_OF.get(w, [w])) for w in words), (words, t)
        texts.append(t)
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(m.labels for m in rows)
    check(rows, enumerate(texts))


def test_no_python_in_the_plan(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
