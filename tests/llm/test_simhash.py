"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from paperloom.llm import queries, simhash
from paperloom.llm.graph import connected_components


def slow_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps, budget=4):
    v = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= budget
    label = list(range(len(ids)))
    seen, out = set(), {}
    for i in label:
        if i in seen:
            continue
        todo, part = [i], []
        seen.add(i)
        while todo:
            x = todo.pop()
            part.append(x)
            for y in np.flatnonzero(near[x]):
                if int(y) not in seen:
                    seen.add(int(y))
                    todo.append(int(y))
        named = [ids[x] for x in part if ids[x] is not None]
        for x in part:
            out[x] = min(named, default=None)
    return [out[i] for i in label]


def check(rows, texts):
    ids, fps = [d for d, _ in texts], [slow_fingerprint(t) for _, t in texts]
    want = sorted(map(str, zip(ids, [f"{f:016x}" for f in fps], components(ids, fps), strict=True)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op10_simhash(spark, sf).collect(), docs)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c"), (7, "a b c d e"), (None, "alone here"), (None, "one"), (4, "one"), (9, "É x é"), (10, "w " * 40000), (11, "a\x0bb\x0cc")]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in texts], "doc_id long, text string, fp string, a int")
    check(simhash.near_duplicates(docs).collect(), texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 9, 10]  # 11 reads as 6, 2 and 3 have no words either, one null row is "one" again
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.similar_copies(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    texts = [(1, "a b c d e f"), (1, "quite another text that is alone"), (2, "one more text of its own"), (2, "one more text of its own"), (None, "no id here but a text"), (None, "no id there but some words"), (None, "no id here but a text"), (3, "A B C D E F")]
    docs = spark.createDataFrame([(d, t, i, i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, tid int, lead int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted({(d or 0, t) for d, t in texts[:-1]})
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, simhash.keep_one(docs.repartition(3)).collect()), key=str)
    near = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.similar_copies(docs).collect())
    assert near == [(0, 0)] * 3 + [(1, 1)] * 2 + [(2, 2)] * 2 + [(3, 1)]


def jaccard_components(rows, similarity=0.8, shingle=5):
    """Components over all pairs of word shingle sets of at least this Jaccard similarity, as {doc_id: smallest}; texts without
    words are one."""
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in words]
    comp = [i for i, _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and min(len(a), len(sets[j])) >= similarity * max(len(a), len(sets[j])) - 1e-9 and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return dict(zip([i for i, _ in rows], comp, strict=True))


@pytest.mark.parametrize("bounds", [{}, {"part": 7, "cap": 16, "target": 16}, {"heavy": 300, "cap": 5, "target": 4}])
def test_links_are_those_of_the_jaccard_similarity(spark, bounds):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 100000, n)]
    rows = []
    for cut, kept in ((1, 9), (3, 19), (20, 100), (25, 100), (30, 100), (40, 100), (21, 104)):  # a text of ``kept`` words and its first ones
        for _ in range(25):
            w = word(kept)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: kept - cut]))]
    chain = word(400)  # neighbours at 0.88 or so, ends unlike
    rows += [(10000 + i, " ".join(chain[i * 8 : i * 8 + 130])) for i in range(30)]
    hub = word(60)  # a large group of near copies
    rows += [(20000 + i, " ".join([*hub, f"x{i}"])) for i in range(200)]
    want = jaccard_components(rows)
    assert len(set(want.values())) > 100 and {want[2 * i + 1] == 2 * i for i in range(25)} == {True}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_copies(docs, **bounds).collect()} == want
    if not bounds:
        assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_kept_documents_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    want = jaccard_components([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


@pytest.mark.parametrize("n,cap,target", [(3000, 8192, 4096), (3000, 64, 4096), (2000, 256, 2)])
def test_links_span_all_near_pairs(spark, n, cap, target):
    rng = np.random.default_rng(n + cap)
    base = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    v = np.repeat(base, 10)
    for _ in range(3):
        v ^= np.where(rng.random(len(v)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64), np.uint64(0))
    dense = (np.uint64(12345) ^ (rng.integers(0, 1 << 9, 300).astype(np.uint64) << np.uint64(20)))
    v = np.unique(np.concatenate([v, dense]))
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(fps, 4, len(v), cap, target)).collect()}
    s = v.view(np.int64).tolist()
    want = components(s, v.tolist())
    assert [got.get(x, x) for x in s] == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1400)] + [(7, 7), (1399, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(100, 161), 5, *range(1000, 1400)} and set(got.values()) == {5}
