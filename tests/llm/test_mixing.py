"""Mixing to target weights: totals, ceilings, and agreement of the join with a plain walk over slots."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import mixing, queries


def check(rows, texts):
    """rows of mix(); texts: (doc_id, text, source)."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted(str((r.doc_id, r.source, r.size)) for r in rows) == sorted(str((d, s, size(t))) for d, t, s in texts)
    by = Counter()
    for _, t, s in texts:
        by[s] += size(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    left, free, want = float(sum(by.values())), [s for s in names if by[s]], dict.fromkeys(names, 0.0)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * by[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * by[s]
            left -= want[s]
        free = [s for s in free if s not in over]
    taken = Counter()
    for r in rows:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    return taken


def test_whole_table_and_rerun(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op2_mix(spark, sf).collect()
    check(rows, texts)
    assert sorted(rows) == sorted(queries.op2_mix(spark, sf).collect())


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "w " * 999, "y"), (5, "one", None), (None, "q r", None), (5, "one", None), (6, "z z z", "\U0001f600"), (7, "k", "￿"), (8, None, "empty")]
    return texts, spark.createDataFrame([(*t, "c", 3) for t in texts], "doc_id long, text string, source string, k string, n_chars long")


def test_odd_rows(spark, odd):
    texts, docs = odd
    check(mixing.mix(docs, block=4, shard_slots=16).collect(), texts)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("text is null")).selectExpr("sum(taken)").head()[0] == 0


def test_documents_hold_the_words_taken(spark, odd, sf):
    for docs, block in ((odd[1], 4), (spark.read.parquet(f"{sf}/documents.parquet"), 64)):
        taken, got = defaultdict(int), defaultdict(int)
        for r in mixing.mix(docs, block=block, shard_slots=64).collect():
            taken[r.doc_id] += r.taken
        out = mixing.mixed_documents(docs, block=block, shard_slots=64)
        assert out.columns == docs.columns
        for r in out.collect():
            n = len(re.findall("[^\x20\x09-\x0d]+", r.text))
            assert n and r.n_chars == len(r.text)
            got[r.doc_id] += n
        assert {d: n for d, n in taken.items() if n} == dict(got)
    assert mixing.mixed_documents(odd[1].limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    y = mixing.permute(x, n, 12345)
    assert sorted(y.tolist()) == x.tolist() and (mixing.permute(y, n, 12345, back=True) == x).all()


def test_shard_counts_are_multinomial_given_totals():
    totals = np.array([5000, 3000, 0, 17])
    every = list(mixing.split_counts(totals, 9, 1000, 0, 9, 7))
    assert sum(c for _, c, _ in every).tolist() == totals.tolist()
    assert all(c.sum() == (1000 if s < 8 else 17) for s, c, _ in every)
    some = next(mixing.split_counts(totals, 9, 1000, 4, 5, 7))
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(some, every[4], strict=True))
    draws = np.array([next(mixing.split_counts(totals, 9, 1000, 4, 5, s))[1] for s in range(300)])
    assert abs(draws[:, 0].mean() - 1000 * 5000 / 8017) < 5 and 10 < draws[:, 0].std() < 20


def test_counts_beyond_the_librarys_range_follow_the_same_law():
    draw = np.random.default_rng(2)
    mine = np.array([mixing._hypergeometric(draw, 3 * 10**9, 10**9, 2 * 10**9) for _ in range(400)], dtype=np.float64)
    mean, sd = 1.5e9, (2e9 * 0.75 * 0.25 * (2e9 / 4e9)) ** 0.5
    assert abs(mine.mean() - mean) < 4 * sd / 20 and 0.85 < mine.std() / sd < 1.15
    assert mixing._hypergeometric(draw, 2 * 10**9, 3, 2 * 10**9 + 1) in range(2 * 10**9 - 2, 2 * 10**9 + 1)
    assert mixing._hypergeometric(draw, 2, 2 * 10**9, 5) in range(3) and mixing._hypergeometric(draw, 7, 0, 5) == 5


def test_whole_passes_keep_the_text_and_repeats_are_counted(spark):
    texts = [(1, "a  b\tc", "x"), (1, "a  b\tc", "x"), (None, "d e", "x"), (None, "d e", "x"), (2, "w " * 500, "y"), (3, "u v", "z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(docs, block=2, shard_slots=8).collect():
        taken[r.doc_id] += r.taken
    out, got = mixing.mixed_documents(docs, block=2, shard_slots=8).collect(), Counter()
    for r in out:
        got[r.doc_id] += len(r.text.split())
        assert len(r.text.split()) < 3 or r.doc_id != 1 or r.text == "a  b\tc"
    assert got == +taken and got[1] > 6
