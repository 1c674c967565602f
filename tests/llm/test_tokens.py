"""Token operators against the libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing, queries, tokencounts, tokenfile, tokens

ODD = ["", None, " ", "  a  b ", "▁x y", "日本語 テスト 😀 é", "<0x0A> <s>a\n\nb\tc<|endoftext|> d", "I'LL don't Σας ΣΑΣ İx", "x" * 5000, "a\x00b \x1c! \x85?  c", "word " * 3000, "<|startoftext|>Hi", "tab\t\t x\r\n\r\n y  z"]
SCHEMA = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "s", None), (3, "same id", "s", None)], SCHEMA).repartition(3)


def expected(rows, name, tail):
    lib = Tokenizer.from_file(P.path(name))
    return [[*lib.encode(t or "", add_special_tokens=False).ids, tail] for t in rows]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, sf):
    import pyarrow.parquet as pq

    texts = [t for t in ODD if t] + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    enc = tokens.Encoder(P.path(name))
    assert [enc.ids(t) for t in texts] == [enc.full.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_vocabulary_entry_encodes_to_itself(name):
    enc = tokens.Encoder(P.path(name))
    assert all(enc.bpe._core_bpe.encode_single_piece(b) == [i] for b, i in enc.bpe._mergeable_ranks.items())


def check_packing(rows, texts, capacity):
    """rows: of pack(); texts: list of (doc_id, text) in any order."""
    want = sorted((str(d), i) for (d, _), ids in zip(texts, expected([t for _, t in texts], "byte_bpe_50k.json", 0), strict=True) for i in split(ids, capacity))
    assert sorted((str(r.doc_id), (r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def split(ids, capacity):
    first, out, at = len(ids) % capacity or capacity, [], 0
    while at < len(ids):
        e = at + (first if not out else capacity)
        out.append((len(out), at, len(ids[at:e]), zlib.crc32(np.array(ids[at:e], dtype="<u4").tobytes())))
        at = e
    return out


def test_pack_whole_table(spark, sf):
    rows = queries.op3_pack(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = check_packing(rows, docs, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_pack_odd_rows(spark, docs):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), 64).collect()
    check_packing(rows, docs.select("doc_id", "text").collect(), 64)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_pack_sequences_hold_the_ids(spark, docs):
    packed = packing.pack(docs, P.path("byte_bpe_50k.json"), 64, keep_ids=True)
    total = packed.selectExpr("sum(length)").head()[0]
    seqs = packing.sequences(packed).collect()
    assert sum(s.n_ids for s in seqs) == total and all(len(s.ids) == 4 * s.n_ids <= 256 for s in seqs)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 5000, 300), strict=True)}
    places = packing.plan_places(counts, 2048)
    total = sum(n * c for n, c in counts.items())
    for n, c in counts.items():
        lo = places[places[:, 0] == n][:, 1]
        assert lo[0] == 0 and (np.diff(lo) > 0).all() and lo[-1] < c
    assert places[:, 2].max() < total / 2048 * 1.1


def test_linear_grouping_decides_and_is_no_worse_than_best_fit(sf):
    """Configurations of several large pieces hold most of them, in as few sequences as longest-first best fit of all pieces needs."""
    import duckdb

    enc, hist = tokens.encoder(P.path("byte_bpe_50k.json")), np.zeros(2049, dtype=np.int64)
    for (t,) in duckdb.sql(f"select text from '{sf.replace('sf0.001', 'sf0.1')}/documents.parquet'").fetchall():
        n = len(enc.ids(t)) + 1
        hist[2048] += n // 2048
        hist[n % 2048] += n % 2048 > 0
    mixed = np.concatenate([[0], np.random.default_rng(5).permutation(hist[1:])])
    for h in (hist, hist * 9, mixed):
        kinds, together = packing.best_plan(h, 2048)
        held = np.zeros(2049, dtype=np.int64)
        for times, lengths in kinds:
            assert sum(n * c for n, c in lengths) <= 2048
            for n, c in lengths:
                held[n] += times * c
        assert (held == h).all()
        assert sum(t for t, _ in kinds) <= sum(t for t, _ in packing._best_fit(h.copy(), [], 2048)) * 1.0005
        assert together > h[683:2048].sum() / 2 or h is mixed
    assert sum(t for t, _ in packing.best_plan(hist, 2048)[0]) <= sum(t for t, _ in packing._best_fit(hist.copy(), [], 2048))


def check_file(rows, texts, tail=2):
    ids = expected([t for _, t in texts], "word_bpe_49k.json", tail)
    want = [(d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (d, _), x in zip(texts, ids, strict=True)]
    got = sorted(rows, key=lambda r: r.start)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(d if d is not None else -1 for d, _ in texts)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_file_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_file(queries.op8_token_file(spark, sf).collect(), docs)


def test_token_file_odd_rows_many_parts(spark, docs, tmp_path):
    path = str(tmp_path / "file")
    tokenfile.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2, block_ids=100, part_ids=1000)
    check_file(tokenfile.read_tokens(spark, path, with_ids=True).collect(), docs.select("doc_id", "text").collect())
    tokenfile.write_tokens(docs.limit(0), str(tmp_path / "none"), P.path("word_bpe_49k.json"), 2)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (3, 2), (1000, 10), (1000, 16), (40000, 16)])
def test_codes_are_prefix_free_and_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 7, dtype=np.int64)
    counts[rng.permutation(n + 7)[:n]] = rng.zipf(1.3, n).clip(max=10**12)
    lengths = tokenfile.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -float(x) for x in lengths if x) <= 1
    ids = rng.choice(np.flatnonzero(counts), 5000)
    payload, at = tokenfile.pack_bits(ids, lengths, tokenfile.canonical_codes(lengths))
    assert (tokenfile.unpack_bits(payload, at[:: tokenfile.STRIDE], len(ids), tokenfile.decode_table(lengths)) == ids).all()


def test_codes_are_optimal_without_a_binding_limit():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 200)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((counts * tokenfile.code_lengths(counts, 20)).sum()) == total


@pytest.fixture(scope="module")
def counter():
    return tokencounts.PrefixCounter(P.path("piece_bpe_32k.model"))


def test_prefix_counts_are_the_librarys(counter, sf):
    import pyarrow.parquet as pq

    texts = [t for t in ODD if t and len(t) < 200] + [t[:250] for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:12]]
    for t in texts:
        assert counter.prefix_counts(t).tolist() == [len(counter.direct.encode(t[:i])) for i in range(len(t) + 1)]


def test_counts_are_the_librarys(counter, sf):
    import pyarrow.parquet as pq

    texts = [t or "" for t in ODD] + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    assert [counter.count(t) for t in texts] == [len(counter.direct.encode(t)) for t in texts]


def test_count_query_and_odd_rows(spark, docs, counter):
    rows = tokencounts.count_tokens(docs, P.path("piece_bpe_32k.model"), limit=10).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r.doc_id not in (None, 3):
            t = ODD[r.doc_id] or ""
            n = len(counter.direct.encode(t))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 10)
            if n > 10 and len(t) < 200:
                assert r.fit_chars == max(i for i in range(len(t) + 1) if len(counter.direct.encode(t[:i])) <= 10)
    tables = tokencounts.prefix_tables(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(tables) == len(rows)
    for r in tables:
        t = (ODD[r.doc_id] or "") if r.doc_id not in (None, 3) else None
        if t is not None:
            assert len(r.counts) == len(t) + 1 and r.counts[-1] == len(counter.direct.encode(t))
            assert len(t) >= 200 or r.counts == [len(counter.direct.encode(t[:i])) for i in range(len(t) + 1)]
    assert tokencounts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_counts_of_a_whole_query_are_the_librarys(spark, sf, counter):
    """Every text of the table by one call, and the prefix that fits, also inside long and many words."""
    rows = {r.doc_id: r for r in queries.op9_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        t, got = r.text or "", rows[r.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(t.encode()), len(counter.direct.encode(t)), len(counter.direct.encode(t)) > 4096)
        assert got.fit_chars == len(t) if not got.over_limit else len(counter.direct.encode(t[: got.fit_chars])) <= 4096 < len(counter.direct.encode(t[: got.fit_chars + 1]))


def test_prefixes_that_fit(counter):
    texts = ["a bc  def " * 40, "word " * 300 + "x" * 700 + " tail", " lead and trail ", "▁odd ▁ marks", "one", "é€😀 " * 90, "supercalifragilistic" * 30]
    for limit in (0, 1, 2, 7, 50, 333):
        n, fit = counter.counts(texts, limit)
        for t, k, f in zip(texts, n, fit, strict=True):
            counts = counter.prefix_counts(t)
            assert k == counts[-1] == len(counter.direct.encode(t))
            assert f == counter.fitting(t, limit) == max(i for i in range(len(t) + 1) if counts[i] <= limit)
