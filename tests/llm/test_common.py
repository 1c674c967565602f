"""Prefix sums, bounded groups and scratch tables."""

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import blocks, common
from paperloom.llm.graph import connected_components


def test_running_totals(spark):
    rows = [(i * 3, i % 7) for i in range(500)]
    got = {r.k: r.before for r in common.running_totals(spark.createDataFrame(rows, "k long, v long"), "k", "v", "before").collect()}
    total = 0
    for k, v in rows:
        assert got[k] == total
        total += v
    assert common.running_totals(spark.createDataFrame([], "k long, v long"), "k", "v", "before").count() == 0


def test_grouped_offsets_tile_each_key(spark):
    rng = np.random.default_rng(0)
    rows = [(None if k == 5 else str(k), int(i), int(n)) for i, (k, n) in enumerate(zip(rng.integers(0, 6, 800), rng.integers(0, 9, 800), strict=True))]
    df = spark.createDataFrame(rows, "key string, id long, n long")
    by = defaultdict(list)
    for r in common.grouped_offsets(df, ["key"], ["id"], F.col("n"), "at", 9).collect():
        by[r.key].append((r.at, r.n))
    assert sum(map(len, by.values())) == 800
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n


def test_bounded_groups_meet_every_pair_once_across(spark):
    rows = common.settle(spark.createDataFrame([("hot" if i < 60 else f"k{i % 9}", i) for i in range(100)] + [("one", 999)], "key string, id long"))
    seen = defaultdict(int)
    for g in blocks.bounded_groups(rows, ["key"], ["id"], "id", 10).collect():
        m = g.members
        assert len(m) <= 40 and g.key != "one"
        for a in m:
            for b in m:
                if a.id < b.id and (not g.across or a.chunk != b.chunk):
                    seen[(a.id, b.id)] += 1
    key = {r.id: r.key for r in rows.collect()}
    assert seen == {(a, b): 1 for a in key for b in key if a < b and key[a] == key[b]}


@pytest.mark.parametrize("cap,limit", [(1000, 1000), (10, 1000), (1000, 12), (7, 5)])
def test_linked_groups_join_what_all_pairs_join(spark, cap, limit):
    rng = np.random.default_rng(3)
    place = np.concatenate([np.arange(150), 1000 + 5 * np.arange(60), rng.integers(3000, 3100, 90)])  # a chain, loners, clumps; ids are shuffled
    ids = rng.permutation(len(place)) * 10
    rows = [("hot" if i < 220 else f"k{i % 4}", int(d), int(p)) for i, (d, p) in enumerate(zip(ids, place, strict=True))] + [("one", 99999, 0)]

    def link(batches):
        for b in batches:
            for g, across in blocks.members(b):
                x, n, met = g["at"], g["id"], []
                for i in range(len(x)):
                    for j in range(i):
                        if abs(int(x[i]) - int(x[j])) <= 1 and (not across or g["side"][i] != g["side"][j] and g["comp"][i] != g["comp"][j]):
                            met.append((int(n[i]), int(n[j])))
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], pa.int64()) for k in (0, 1)], names=["a", "b"])

    df = common.settle(spark.createDataFrame(rows, "key string, id long, at long"))
    links = blocks.linked_groups(df, ["key"], ["id", "at"], "id", cap, link, F.lit(1), limit)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {d: d for _, d, _ in rows}
    for _ in rows:
        for k, d, x in rows:
            want[d] = min(want[e] for m, e, y in rows if m == k and abs(x - y) <= 1)
        if all(got.get(d, d) == c for d, c in want.items()):
            break
    assert {d: got.get(d, d) for d in want} == want


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TOP", 3)
    rows = common.settle(spark.createDataFrame([(f"k{i % 8}", i) for i in range(400)], "key string, id long"))
    small, large, n = blocks._sized(rows, ["key"], 20, None, 1)
    assert n == 8 and small.count() == 0 and sorted(r.id for r in large.collect()) == list(range(400)) and {r._m for r in large.collect()} == {3}


def test_hash_sample_is_bounded_and_the_same_each_time(spark):
    df = spark.range(50000).repartition(7)
    got = [r.id for r in common.hash_sample(df, ["id"], 500)]
    assert len(set(got)) == 500 and got == [r.id for r in common.hash_sample(df.coalesce(2), ["id"], 500)] and max(got) > 40000 and min(got) < 10000
    assert len(common.hash_sample(df.limit(3), ["id"], 500)) == 3 and common.hash_sample(df.limit(0), ["id"], 5) == []


def test_a_hub_and_many_small_components(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(10000 + 2 * i, 10001 + 2 * i) for i in range(2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(3000), 0) | {10000 + 2 * i + j: 10000 + 2 * i for i in range(2000) for j in (0, 1)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_that_is_read_stays(spark):
    old, new = common.settle(spark.range(5)), common.settle(spark.range(6))
    assert common.clear_scratch(spark, keep=new) > 0 and new.count() == 6
    assert not os.path.isdir(old.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])


def test_scratch_is_cleared(spark):
    df = common.settle(spark.range(5).toDF("x"))
    path = common._MADE[-1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    assert common.clear_scratch(spark) > 0 and not os.path.exists(path.removeprefix("file://"))
