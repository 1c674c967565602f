"""Embedding operators against brute force in double precision."""

import numpy as np
import pytest

from paperloom.llm import embeddups, queries

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component_id string"


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def slow_links(rows, least):
    """rows: (vec_id, vector, label) -> list of (vec_id, n_links, component_id, kept)."""
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and None not in (a[0], b[0], a[2], b[2]) and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                x, y = (np.array(v, dtype=np.float64) for v in (a[1], b[1]))
                near[i, j] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) if near[i].any() else comp[i] for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted(str((r[0], int(near[i].sum()), comp[i], r[0] == comp[i])) for i, r in enumerate(rows))


def got(df):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op6_embedding_dups(spark, sf)) == slow_links(rows, 0.93)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 9)).astype(np.float32)
    rows = [(i * 10 + k, (base[i] + rng.normal(scale=0.12, size=9).astype(np.float32)).tolist(), int(i % 2)) for i in range(12) for k in range(8)]
    rows += [(900 + k, base[0].tolist(), 0) for k in range(5)] + [(905, base[0].tolist(), 0), (905, base[0].tolist(), 0), (906, (base[0] * 1000).tolist(), 0), (907, (-base[0]).tolist(), 0)]
    rows += [(910, None, 0), (911, [0.0] * 9, 0), (912, [float("nan")] * 9, 0), (913, [1.0, None] + [0.0] * 7, 0), (914, [float("inf")] + [1.0] * 8, 0), (915, base[0].tolist(), None), (916, [1.0], 0), (917, [2.0], 0), (918, [], 0), (None, base[0].tolist(), 0), (919, (base[0] * 1e-20).tolist(), 1)]
    return rows


@pytest.mark.parametrize("cap,blocks,axes", [(4096, 4, 2), (5, 4, 2), (7, 3, 1), (4096, 9, 1), (16, 1, 3)])
def test_odd_rows(spark, odd, cap, blocks, axes):
    df = spark.createDataFrame([(*r, 3, "clash") for r in odd], SCHEMA)
    assert got(embeddups.near_duplicates(df, 0.9, blocks, axes, cap)) == slow_links(odd, 0.9)


def test_doubles_and_nothing(spark, odd):
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>, label string")
    assert got(embeddups.near_duplicates(df, 0.9)) == slow_links(odd, 0.9)
    assert embeddups.near_duplicates(df.limit(0)).count() == 0


def test_sql_agrees(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = c.execute(queries.ORACLE_SQL["op6_embedding_dups"]).fetchall()
    assert sorted(rows) == sorted(map(tuple, queries.op6_embedding_dups(spark, sf).collect()))
