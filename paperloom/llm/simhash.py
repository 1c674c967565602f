"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are compared as sets: all copies of a fingerprint are one node.  Two tries are traversed together; a pair
of nodes accumulates its differing bits and is dropped as soon as they exceed the budget.  To deal the join over
tasks, the trie is entered through every choice of blocks of bits that must agree exactly: with ``n`` blocks and a budget
of ``k`` bits, at least ``n - k`` blocks of a near pair agree, so each pair meets under one such choice, where the
traversal starts below the agreeing bits.  The number of blocks grows with the number of fingerprints, which keeps
the tries small; a trie over the cap is dealt into pairs of parts."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import linked_groups, members
from .common import fewer, settle
from .graph import Forest, connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash as a signed integer.  Words are runs without ASCII white space, A-Z lower-cased; a bit is set if
    it is set in more than half of the shingles' XXH64 (seed 42).  Fewer words than a shingle: one shingle of all."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(n + 1) - 1
    start = end - n
    k = min(shingle, len(words))
    h, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    start, end = start[: len(words) - k + 1], end[k - 1 :]
    for at in range(0, len(start), 1 << 14):
        v = np.array([h(line[a:b], 42) for a, b in zip(start[at : at + (1 << 14)].tolist(), end[at : at + (1 << 14)].tolist(), strict=True)], dtype="<u8")
        total += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(start)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (signed long) of every row of ``docs`` (doc_id, text; other columns are ignored)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, roots: np.ndarray, budget: np.ndarray, leaf: int = 8, width: int = 1 << 17):
    """Index pairs (i < j) of near values, per trie, in slices.

    ``values`` (unsigned 64-bit) are sorted inside each trie, ``roots`` holds where each trie begins and the end.
    A frontier entry is a pair of nodes, each a range of values with a common prefix, and their differing bits; it is
    dropped where these exceed ``budget`` at its depth (0 to 64).  Pairs of few values are compared by the last budget."""
    ones = np.zeros((BITS, len(values) + 1), dtype=np.int32)
    for d in range(BITS):
        np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    lo, hi = roots[:-1], roots[1:]
    keep = hi - lo > 1
    stack = [(0, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), dtype=np.int64))]
    while stack:
        depth, a, b, c, d, diff = stack.pop()
        if len(a) > width:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, diff))), (depth, *(x[half:] for x in (a, b, c, d, diff)))]
            continue
        done = ((b - a) * (d - c) <= leaf * leaf) | (depth == BITS)
        if done.any():
            yield from _leaves(values, a[done], b[done], c[done], d[done], int(budget[-1]), width)
            a, b, c, d, diff = (x[~done] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        m = b - (ones[depth][b] - ones[depth][a])
        n = d - (ones[depth][d] - ones[depth][c])
        same = (a == c) & (b == d)
        cross = ~same
        nodes = [(a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1), (m[cross], b[cross], c[cross], n[cross], diff[cross] + 1)]
        a, b, c, d, diff = (np.concatenate(x) for x in zip(*nodes, strict=True))
        keep = (a < b) & (c < d) & (diff <= budget[depth + 1]) & ~((a == c) & (b - a == 1) & (d - c == 1))
        if keep.any():
            stack.append((depth + 1, a[keep], b[keep], c[keep], d[keep], diff[keep]))


def _leaves(values, a, b, c, d, budget, width, tile=1024):
    """Compare all values of pairs of nodes directly: large ones tile by tile, small ones together."""
    size = (b - a) * (d - c)
    for n in np.flatnonzero(size > 4096).tolist():
        for i0 in range(int(a[n]), int(b[n]), tile):
            for j0 in range(int(c[n]), int(d[n]), tile):
                x = values[i0 : min(i0 + tile, int(b[n])), None] ^ values[None, j0 : min(j0 + tile, int(d[n]))]
                i, j = np.nonzero(np.bitwise_count(x) <= budget)
                i, j = i + i0, j + j0
                if (i < j).any():
                    yield i[i < j], j[i < j]
    few = size <= 4096
    if not few.any():
        return
    a, b, c, d, size = (x[few] for x in (a, b, c, d, size))
    cut = np.searchsorted(np.cumsum(size), np.arange(width, int(size.sum()) + width, width), side="left") + 1
    for lo, hi in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
        s = size[lo:hi]
        if not len(s):
            continue
        which = np.repeat(np.arange(lo, lo + len(s)), s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        w = (d - c)[which]
        i, j = a[which] + k // w, c[which] + k % w
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            yield i[near], j[near]


def _masks(n: int, budget: int, target: int) -> list[int]:
    """Masks of the bits that must agree: one for each choice of blocks, as fine as ``n`` fingerprints ask for."""
    for blocks in range(budget + 1, budget + 5):
        agree = blocks - budget
        edges = np.linspace(0, BITS, blocks + 1).round().astype(int)
        parts = [((1 << int(e - s)) - 1) << int(s) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        masks = [sum(x) for x in combinations(parts, agree)]
        if n >> min(m.bit_count() for m in masks) <= target:
            break
    return masks


def near_links(fps: DataFrame, budget: int, n: int, cap: int = 1 << 13, target: int = 1 << 12) -> DataFrame:
    """Links a, b between distinct fingerprints ``fp`` that differ in at most ``budget`` bits: from every trie, a spanning
    forest of its links, so the components are those of all links while the rows stay within a few times the input."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(n, budget, target)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("r"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("x")).select("fp", "x.r", "x.k")

    def run(batches):
        for b in batches:
            held = list(members(b))
            for at in range(0, len(held), 2048):
                some = [(g["fp"].view(np.uint64), g["side"], g["comp"], across) for g, across in held[at : at + 2048]]
                order = [np.argsort(v, kind="stable") for v, _, _, _ in some]
                v, side, comp = (np.concatenate([x[k][o] for x, o in zip(some, order, strict=True)]) for k in range(3))
                v, roots = v.copy(), np.cumsum([0, *map(len, order)])
                met = np.repeat([not across for *_, across in some], np.diff(roots))
                forest = Forest(len(v))
                for i, j in trie_pairs(v, roots, np.full(BITS + 1, budget)):
                    ok = met[i] | ((side[i] != side[j]) & (comp[i] != comp[j]))
                    forest.add(i[ok], j[ok])
                e = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
                s = v.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s[e[:, 0]]), pa.array(s[e[:, 1]])], names=["a", "b"])

    return linked_groups(rows, ["r", "k"], ["fp"], "fp", cap, run)


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``budget`` differing bits reach, the row's own included.
    Null and blank texts have fingerprint zero, which links like any other.  A null doc_id is kept, takes part in links
    and never names a component unless it is alone (then null).  Repeated rows are kept.  An empty table gives an empty
    result."""
    rows = settle(fingerprints(docs, shingle))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), shuffled=True)
    parts = connected_components(near_links(classes.select("fp"), budget, classes.count()))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "component").select("fp", "component_id")
    return fewer(rows.join(lookup, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


WORDS = 4  # 64-bit words of a wide fingerprint
MISS = 0.002  # share of pairs at the wanted similarity that no table may propose, at most
SMALL = 25  # sets below this many shingles enter more tables, as their bits differ more often
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the text's shingles, sorted; words as in ``fingerprint``."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(n + 1) - 1
    k = min(shingle, len(words))
    start, end = (end - n)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[a:b], 42) for a, b in zip(start, end, strict=True)], dtype="<u8"))


def sketch(v: np.ndarray) -> tuple[int, ...]:
    """SimHash of a *set* of shingles in 256 bits, as four signed words; zeros for an empty set.

    The first word comes from the shingles' XXH64, the others from that hash mixed three ways."""
    total = np.zeros((WORDS, BITS), dtype=np.int64)
    for at in range(0, len(v), 1 << 14):
        x = v[at : at + (1 << 14)]
        for w in range(WORDS):
            y = x if not w else (x ^ (x >> np.uint64(31))) * _MIX[w - 1]
            y = y if not w else y ^ (y >> np.uint64(29))
            total[w] += np.unpackbits(y.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (*np.packbits(total * 2 > len(v), axis=1, bitorder="little").view("<i8")[:, 0].tolist(),)


def bit_rate(similarity: float, n: int) -> float:
    """How often a bit differs between sets of this similarity, the smaller of ``n`` shingles; a little more where sets are small."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) + 0.2 / max(n, 1)


def safe_budget(similarity: float, n: int, bits: int = BITS * WORDS) -> int:
    """Differing bits that sets of at least this similarity stay within: five standard deviations above the mean."""
    p = bit_rate(similarity, n)
    return int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


def tables(n: int, similarity: float, target: int) -> tuple[list[tuple[int, ...]], int]:
    """Masks of the bits that must agree, as signed words, for ``n`` sketches; and how many of them larger sets enter.

    Each mask samples bits of the whole sketch, as many as leave about ``target`` sketches to a trie.  There are enough
    masks for a pair at the wanted similarity to agree under one of them but for ``MISS`` of such pairs."""
    wide = max(4, int(np.ceil(np.log2(max(2, n / target)))))
    need = lambda size: int(np.ceil(np.log(MISS) / np.log1p(-((1 - bit_rate(similarity, size)) ** wide))))
    draw, out = np.random.default_rng(wide), []
    for _ in range(max(need(4), need(SMALL))):
        bits = np.zeros(BITS * WORDS, dtype=np.uint8)
        bits[draw.choice(BITS * WORDS, wide, replace=False)] = 1
        out.append((*np.packbits(bits, bitorder="little").view("<i8").tolist(),))
    return out, need(int(SMALL * similarity))


def _digest(v: np.ndarray) -> bytes:
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest()


def _edges(ids: np.ndarray, pairs: list) -> pa.RecordBatch:
    t = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[t[:, 0]]), pa.array(ids[t[:, 1]])], names=["a", "b"])


def _proposer(similarity: float, names: list[str]):
    """Links inside the tries of a batch: pairs whose first words stay within a budget at every depth, and whose sketches do."""

    def propose(batches):
        for b in batches:
            for g, across in members(b):
                order = np.argsort(g["f0"].view(np.uint64), kind="stable")
                f = [g[c].view(np.uint64)[order] for c in names]
                ids, k, side, comp = (g[c][order] for c in ("cid", "n", "side", "comp"))
                least, forest = int(k.min()), Forest(len(order))
                first = np.array([safe_budget(similarity, least, d) for d in range(BITS + 1)])
                whole = safe_budget(similarity, least)
                for i, j in trie_pairs(f[0], np.array([0, len(order)]), first, leaf=64):
                    near = np.minimum(k[i], k[j]) >= similarity * np.maximum(k[i], k[j]) - 1e-9
                    if across:
                        near &= (side[i] != side[j]) & (comp[i] != comp[j])
                    i, j = i[near], j[near]
                    near = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in f) <= whole
                    if near.any():
                        forest.add(i[near], j[near])
                yield _edges(ids, forest.edges)

    return propose


def _verifier(similarity: float, names: list[str]):
    """Links inside candidate families by the exact similarity of shingle sets: each pair that sketches do not rule out and that no
    verified link connects yet."""

    def verify(batches):
        for b in batches:
            for g, across in members(b):
                order = np.argsort(g["n"], kind="stable")
                w = np.stack([g[c].view(np.uint64)[order] for c in names])
                ids, k, side, comp = (g[c][order] for c in ("cid", "n", "side", "comp"))
                raw, sets = g["shingles"], {}

                def of(i):
                    if i not in sets:
                        sets[i] = np.frombuffer(raw[int(order[i])].as_py(), dtype="<u8")
                    return sets[i]

                _, tree = np.unique(comp, return_inverse=True)
                out = []
                for i in range(len(order) - 1):
                    hi = int(np.searchsorted(k, k[i] / similarity + 1e-9, side="right"))
                    near = np.bitwise_count(w[:, i + 1 : hi] ^ w[:, i, None]).sum(axis=0, dtype=np.int64) <= safe_budget(similarity, int(k[i]))
                    if across:
                        near &= side[i + 1 : hi] != side[i]
                    for j in (np.flatnonzero(near & (tree[i + 1 : hi] != tree[i])) + i + 1).tolist():
                        if tree[i] == tree[j]:
                            continue
                        both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                        if both * (1 + similarity) >= similarity * int(k[i] + k[j]) - 1e-9:
                            tree[tree == tree[j]] = tree[i]
                            out.append((i, j))
                yield _edges(ids, out)

    return verify


def _text_id(doc_id, text):
    """Names a row's content: rows that agree in it are repeats of one document."""
    return F.xxhash64(doc_id, text)


def _copy_groups(docs: DataFrame, similarity: float, shingle: int, target: int, cap: int, part: int, heavy: int) -> DataFrame:
    """Per row of ``docs``: doc_id, tid (see ``_text_id``), lead (struct none, doc_id, tid of the row that stands for its group)."""
    names = [f"f{w}" for w in range(WORDS)]

    def sketches(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            cols = list(zip(*[(*sketch(v), len(v)) for v in sets], strict=True)) or [[]] * (WORDS + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_digest(v) for v in sets], pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "tid", "digest", *names, "n"])

    def shingles(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(v) for v in sets], pa.binary()), pa.array([v.tobytes() for v in sets], pa.binary())], names=["digest", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("tid", _text_id("doc_id", "text"))
    rows = settle(texts.mapInArrow(sketches, "doc_id long, tid long, digest binary, " + ", ".join(f"{c} long" for c in names) + ", n long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid"))
    classes = rows.groupBy("digest", *names, "n").agg(first.alias("least")).withColumn("cid", F.monotonically_increasing_id())
    classes = settle(classes, shuffled=True)
    smallest = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else np.iinfo(np.int64).max  # of unequal sets that similar
    able = classes.filter(F.col("n") >= smallest)
    masks, large = tables(able.count(), similarity, target)
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(names, mask, strict=True)]) for t, mask in enumerate(masks)]
    keyed = able.select("cid", "n", *names, F.explode(F.when(F.col("n") < SMALL, F.array(*keys)).otherwise(F.array(*keys[:large]))).alias("k"))
    proposed = connected_components(linked_groups(keyed, ["k"], ["cid", "n", *names], "cid", cap, _proposer(similarity, names)))
    maybe = settle(proposed.withColumnRenamed("node", "cid").withColumnRenamed("component", "family").join(classes, "cid"), shuffled=True)
    some = texts.join(maybe.select(F.col("least.tid").alias("tid")).distinct(), "tid", "left_semi").select("doc_id", "text")
    sets = settle(maybe.join(some.mapInArrow(shingles, "digest binary, shingles binary"), "digest").dropDuplicates(["cid"]))
    links = linked_groups(sets, ["family"], [*names, "n", "cid", "shingles"], "cid", part, _verifier(similarity, names), F.col("n"), heavy)
    parts = connected_components(links)
    named = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lookup = named.join(named.groupBy("component").agg(F.min("least").alias("lead")), "component").select("digest", "lead")
    return rows.join(lookup, "digest").select("doc_id", "tid", "lead")


def similar_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, target: int = 1 << 9, cap: int = 1 << 12, part: int = 1 << 9, heavy: int = 1 << 22) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, component_id, linking documents whose shingle sets have at least this Jaccard
    similarity, and no others.

    Candidates come from 256-bit SimHash of the sets.  The tries are entered through sampled bits that must agree (see ``tables``);
    the traversal drops a pair of nodes whose differing bits exceed what sets that similar stay within at that depth,
    and all 256 bits decide.  Candidates form families; the shingle sets of their documents alone are gathered, and links
    inside a family are verified exactly.  ``target`` is the wanted size of a trie, ``cap``, ``part`` and ``heavy`` bound what a task
    compares at once (sketches, shingle sets, shingles).

    Texts without words link with each other, sets too small for an unequal one to be that similar only with equal ones.  Null
    doc_ids are kept, take part in links and never name a component unless it has no other (then null).  Repeated rows
    are kept.  An empty table gives an empty result; other columns are ignored."""
    return fewer(_copy_groups(docs, similarity, shingle, target, cap, part, heavy).select("doc_id", F.col("lead.doc_id").alias("component_id")))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row for each group of copies (see ``similar_copies``): the one with the smallest doc_id, null last.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are judged each by its own text, and
    none is lost that has no copy.  Of rows that agree in both, one stays, the least by a hash of all its columns."""
    near = _copy_groups(docs, similarity, shingle, 1 << 9, 1 << 12, 1 << 9, 1 << 22)
    near = near.groupBy("doc_id", "tid").agg(F.bool_or(F.col("lead.tid") == F.col("tid")).alias("lead"), F.count("*").alias("n"))
    near = settle(near.filter("not lead or n > 1"), shuffled=True)
    named = docs.withColumn("_tid", _text_id(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    gone = near.select(F.col("tid").alias("_tid")).distinct()
    kept = fewer(named.join(gone.hint("merge"), "_tid", "left_anti"), 4).select(docs.columns)
    again = near.filter("lead").select(F.col("tid").alias("_tid"))
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = named.join(again, "_tid", "left_semi").groupBy("_tid").agg(F.min_by(row, F.struct(F.xxhash64(*docs.columns))).alias("_row"))
    return kept.unionByName(once.select("_row.*"))
