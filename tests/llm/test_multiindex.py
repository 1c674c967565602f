"""The inverted multi-index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import multiindex, queries


def brute(rows, k, asked):
    """rows: (vec_id, vector), usable ones only -> {query id: [(score, vec_id)]}."""
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = [i for i, _ in rows]
    out = {}
    for n, i in enumerate(ids):
        if asked(i):
            d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
            out[i] = sorted({(float(d[m]), ids[m]) for m in range(len(ids)) if ids[m] != i})[:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len({v for _, v, _ in mine}) == len(mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        exact = dict((v, s) for s, v in best)
        for _, v, s in mine:
            assert v not in exact or abs(exact[v] - s) <= 1e-12 * max(1.0, s)
        hits += len(set(exact) & {v for _, v, _ in mine})
        total += len(best)
    assert set(got) <= set(want)
    return hits / max(1, total)


def test_recall_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op4_neighbours(spark, sf).collect()
    want = brute(rows, 10, lambda i: i % 100 == 0)
    assert len(got) == 10 * len(want) and recall(got, want) >= 0.9


def test_recall_with_larger_codebooks(spark):
    rng = np.random.default_rng(2)
    mid = rng.normal(size=(40, 16))
    x = (mid[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[3000:4500] = x[0]  # a group of copies
    rows = [(i, x[i].tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multiindex.nearest(df, F.col("vec_id") % 50 == 0, k=7).collect()
    want = brute(rows, 7, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 3000] == [0, *range(3001, 3007)]


def test_recall_with_a_third_of_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 64)).astype(np.float32)
    copied = rng.random(20000) < 1 / 3
    x[copied] = x[np.flatnonzero(copied)[0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    asked = [i for i in range(0, 20000, 80) if not copied[i]]
    got = {}
    for r in multiindex.nearest(df, F.col("vec_id") % 80 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y, hits = x.astype(np.float64), 0
    for i in asked:
        d = ((y - y[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(got[i] & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hits / (10 * len(asked)) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 5.0]), (3, [1.0, 0.5, 0.0]), (100, [1.0, 0.0, 0.1])]
    odd = [(4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [1.0]), (None, [1.0, 0.0, 0.0]), (200, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + odd], "vec_id long, embedding array<float>, rank int, score string")
    got = multiindex.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect()
    one = [(r.rank, r.vec_id) for r in got if r.query_id == 0]
    assert sorted(one) == sorted([(1, 1), (2, 100), (3, 3), (4, 2), (5, 1), (6, 100), (7, 3), (8, 2)][:4] * 2)
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(1, 0), (2, 1), (3, 3), (4, 2)]
    assert {r.query_id for r in got} == {0, 100}
    assert multiindex.nearest(df.limit(0), F.lit(True)).count() == 0
    assert multiindex.nearest(df.filter("vec_id = 3"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n,m", [(1, 1), (5, 3), (30, 40)])
def test_cells_are_visited_in_order_of_distance(n, m):
    rng = np.random.default_rng(n)
    a, b = rng.random(n), rng.random(m)
    total = (a[:, None] + b[None]).ravel()
    cells = multiindex.visit(a, b, np.ones(n * m, dtype=np.int64), n * m)
    assert sorted(cells) == list(range(n * m)) and (np.diff(total[cells]) >= 0).all()
