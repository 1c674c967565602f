"""What made queries fail on larger tables, shown on small ones."""

import math
from collections import Counter

import duckdb

from paperloom.functions import similarity
from paperloom.operators import supplements
from paperloom.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _grams(text):
    return Counter(w[i : i + n] for w in (f" {x} " for x in (text or "").lower().split()) for n in (3, 4, 5) for i in range(len(w) - n + 1))


def test_tfidf_broadcasts_the_vocabulary_alone(spark):
    texts = ["Large ring", "hot bolt bolt", None, "", "blue ring of a", "large ring"]
    fit = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in [*texts, "large unseen"])]
    d = similarity.tfidf_cosine(spark.createDataFrame(rows, "id long, x string, y string"), ["id"], "x", "y", fit, "t")
    assert _plan(d).count("BroadcastExchange") == 1
    df = Counter(g for t in texts for g in _grams(t))

    def weights(text):
        w = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in _grams(text).items() if g in df}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / size for g, v in w.items()}

    got = {r.id: r.tfidf_cosine for r in d.collect()}
    assert len(got) == len(rows)
    for i, x, y in rows:
        a, b = weights(x), weights(y)
        assert abs(got[i] - sum(v * b.get(g, 0) for g, v in a.items())) < 1e-9
    similarity.BROADCAST_GRAMS, most = 0, similarity.BROADCAST_GRAMS
    try:
        d = similarity.tfidf_cosine(spark.createDataFrame(rows, "id long, x string, y string"), ["id"], "x", "y", fit, "t")
        assert "BroadcastExchange" not in _plan(d) and all(abs(r.tfidf_cosine - got[r.id]) < 1e-9 for r in d.collect())
    finally:
        similarity.BROADCAST_GRAMS = most


def test_archive_lines_leave_python_together(spark, sf):
    from paperloom.plans import sources

    assert sources._archives(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = []
    supplements.pd.read_csv, whole = lambda *a, **k: read.append(a) or whole(*a, **k), supplements.pd.read_csv
    try:
        for text, lines in [
            ("name;n\nx;1\n\nother;NA\n", ["\0columns: name | n", "x | 1", "other | "]),
            ("a\tb\n1\t2\n", ["\0columns: a | b", "1 | 2"]),
        ]:
            assert supplements._delimited(text.encode(), ".csv") == lines and not read
        for text, lines in [
            ('a,b\n"1,5",2\n', ["\0columns: a | b", "1,5 | 2"]),  # quotes
            ("a,a\n1,2\n", ["\0columns: a | a.1", "1 | 2"]),  # equal names
            ("a,\n1,2\n", ["\0columns: a | Unnamed: 1", "1 | 2"]),
            ("a,b\n1,2\n3\n4,5,6\n", ["\0columns: a | b", "1 | 2", "3 | "]),  # rows of other lengths
        ]:
            supplements._delimited(text.encode(), ".csv")
            assert read and supplements._delimited(text.encode(), ".csv") == lines
            read.clear()
    finally:
        supplements.pd.read_csv = whole


def test_context_blocks_broadcast_no_lines(spark, tmp_path):
    lines = spark.createDataFrame([("1", 0, "a.txt", "text", 0, False, "gene abc1"), ("1", 1, "p.png", "image", 0, False, None)], supplements.LINE_SCHEMA)
    pairs = spark.createDataFrame([("1", "abc1", None, ["x"], ["abc1"])], "pmid string, gene_id string, pmcid string, aliases array<string>, terms array<string>")
    texts = spark.createDataFrame([("1", 0, "A.pdf", "S1")], "pmid string, pos int, file string, caption string")
    for name, d in (("lines", lines), ("pairs", pairs), ("texts", texts)):  # files, as the optimiser knows their small size
        d.write.parquet(f"{tmp_path}/{name}")
    lines, pairs, texts = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("lines", "pairs", "texts"))
    for c in (texts, None):
        d = supplements.context_blocks(pairs, lines, c)
        assert "BroadcastExchange" not in _plan(d)
        (r,) = d.collect()
        assert "[a.txt]" + " — S1" * (c is not None) + "\ngene abc1\n" in r.block and "[1 figure/image file(s)" in r.block


def test_mention_counts_read_lines_once(spark):
    lines = spark.createDataFrame([("1", 0, "a.txt", "text", 0, False, "gene abc"), ("1", 0, "a.txt", "text", 1, False, "1 and ABC 1"), ("1", 1, "p.png", "image", 0, False, None), ("2", 0, "q.png", "image", 0, False, None), ("3", 0, "", "error", 0, False, "bad abc-1"), (None, 0, "a.txt", "text", 0, False, "abc1")], supplements.LINE_SCHEMA)
    pairs = spark.createDataFrame([(p, g, ["abc 1"]) for p in ("1", "2", "3", "4", None) for g in ("abc1", None)] + [("1", "no", ["ab"])], "pmid string, gene_id string, terms array<string>")
    d = supplements.mention_counts(pairs, lines.mapInArrow(lambda batches: batches, lines.schema))
    assert _plan(d).count("MapInArrow") == 1 and "BroadcastExchange" not in _plan(d)
    got = {(r.pmid, r.gene_id): (r.available, r.found, r.mentions, [tuple(f) for f in r.files]) for r in d.collect()}
    nothing = lambda available: (available, False, 0, [])
    assert got == {("1", "abc1"): (True, True, 2, [("a.txt", 2)]), ("1", "no"): nothing(True), ("1", None): nothing(True), ("2", "abc1"): nothing(True), ("2", None): nothing(True)} | {(p, g): nothing(False) for p in ("3", "4", None) for g in ("abc1", None)}


def test_file_types_read_lines_once(spark):
    lines = spark.createDataFrame([("1", 0, "a.txt", "text", 0, False, "abc1 abc1 abc1"), ("1", 1, "b.csv", "table", 0, False, "abc1")], supplements.LINE_SCHEMA)
    pairs = spark.createDataFrame([("1", "abc1", ["abc1"]), ("2", "abc1", ["abc1"])], "pmid string, gene_id string, terms array<string>")
    d = supplements.by_file_type(pairs, lines.mapInArrow(lambda batches: batches, lines.schema))
    assert _plan(d).count("MapInArrow") == 1
    assert sorted(map(tuple, d.collect())) == [(".csv", 1, 1, 25.0), (".txt", 3, 1, 75.0)]


def test_first_of_tied_rows_wins(spark, tmp_path):
    rows = [(1, 5, 1, "A"), (1, 5, 1, "B"), (1, 5, 1, "A"), (2, 1, 1, "R"), (2, 1, 1, "N"), (2, 9, 7, "N"), (2, 9, 7, "A"), (3, 1, 1, None), (3, 2, 1, "X"), (3, None, 1, "Y"), (3, 3, 1, None), (4, 1, 1, None)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, catalog.QUERIES["last_and_first_wins"](spark, str(tmp_path)).select("k", "last_value", "first_value").collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(duck.execute(f"SELECT k, last_value, first_value FROM ({catalog.ORACLE_SQL['last_and_first_wins']})").fetchall())
    assert got == [(1, "A", "A"), (2, "N", "R"), (3, "X", "X"), (4, None, None)]
