"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) joined to ``least`` (u, m, n) on u.  Nodes with over a thousandth of the edges, at most a thousand by that
    count, are broadcast, so the edges of a hub are not gathered in one task."""
    hubs = least.filter(F.col("n") > max(total // 1000, 200)).select("u", "m")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = least.select("u", "m").hint("merge")  # as large as the edges, so never broadcast
    return marked.filter("m is not null").unionByName(marked.filter("m is null").drop("m").join(rest, "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (a long, b long): node, component (the smallest node reachable).

    Alternates large-star and small-star steps: each node links its larger, then its smaller neighbours to the least
    neighbour it knows, until every edge points at its component's least node.  Least neighbours are pre-aggregated
    before the shuffle and a hub's is broadcast, so a hub costs no task more than its share; the edges are written once
    per round."""
    e = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), shuffled=True)
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("mark")
    seen = e.agg(mark).head()[0]
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.filter("v > u"), least, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("merge")  # a node has few smaller neighbours by now
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = settle(small, shuffled=True)
        now = e.agg(mark).head()[0]
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


class Forest:
    """Union-find over 0..n-1 that takes edges in bulk and keeps those that joined two trees."""

    def __init__(self, n: int):
        import numpy as np

        self.parent, self.edges = np.arange(n), []

    def add(self, a, b) -> None:
        import numpy as np

        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                break
            self.parent = up
        ra, rb = self.parent[a], self.parent[b]
        keep = ra != rb
        if not keep.any():
            return
        pair = np.stack([np.minimum(ra, rb)[keep], np.maximum(ra, rb)[keep]], axis=1)
        _, first = np.unique(pair, axis=0, return_index=True)
        p = self.parent
        ia, ib = a[keep][first], b[keep][first]
        for x, y in zip(ia.tolist(), ib.tolist(), strict=True):
            r, s = x, y
            while p[r] != r:
                r = p[r]
            while p[s] != s:
                s = p[s]
            if r != s:
                p[max(r, s)] = min(r, s)
                self.edges.append((x, y))
