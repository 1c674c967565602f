"""Expressions against the Python definitions they stand for."""

import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import llmjson, similarity, text, values
from paperloom.operators import ranking


def py_mentions(body, term):
    if not term.strip():
        return 0
    parts = re.split(r"[_\-\s]+", term)
    core = re.sub("^([A-Za-z]+)([0-9]+)$", r"\1-?\2", term) if re.fullmatch("[A-Za-z]+[0-9]+", term) else r"[-_\s]+".join(re.escape(p) for p in parts)
    return len(re.findall(rf"(?<![A-Za-z0-9])(?:{core})(?![A-Za-z0-9])", body, re.I))


CASES = [("abc1 abc-1 ABC1 xabc1 abc12", "abc1"), ("a.b a+b a$b (a.b)", "a.b"), ("β-tubulin Β-TUBULIN β tubulin", "β-tubulin"), ("foo bar foo_bar foo  - bar foobar", "foo bar"), ("x x x", "x"), ("[q] [q]", "[q]"), ("", "x"), ("text", " "), ("a|b^c", "a|b^c"), ("kin1kin1", "kin1"), ("cost $5 and $5", "$5")]


def test_mentions(spark):
    df = spark.createDataFrame(CASES, "t string, term string")
    got = [r.n for r in df.select(text.mentions(F.col("t"), F.col("term")).alias("n")).collect()]
    assert got == [py_mentions(t, term) for t, term in CASES]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab1- _.\n", max_size=30), st.text("ab1-_.", min_size=1, max_size=4).filter(lambda t: t.strip("-_ "))), min_size=1, max_size=20))
def test_mentions_property(spark, rows):
    df = spark.createDataFrame(rows, "t string, term string")
    got = [r.n for r in df.select(text.mentions(F.col("t"), F.col("term")).alias("n")).collect()]
    assert got == [py_mentions(t, term) for t, term in rows]


def test_alternation_and_fragments(spark):
    df = spark.createDataFrame([(["ab", "abc", "abc1"],), (["a"],), ([],)], "a array<string>")
    p = [r.p for r in df.select(text.any_term_pattern(F.col("a")).alias("p")).collect()]
    assert p[1] is None and p[2] is None and p[0].count("|") == 1
    d = spark.createDataFrame([("αβ-kinase 12",), ("...",)], "t string")
    assert [r[0] for r in d.select(text.longest_fragment(F.col("t"))).collect()] == ["kinase", ""]


def test_values(spark):
    d = spark.createDataFrame([("12.0",), ("x",), (None,), ("",), ("NA",)], "c string")
    assert [r[0] for r in d.select(values.whole_number(F.col("c"))).collect()] == [12, 0, 0, 0, 0]
    assert [r[0] for r in d.select(values.missing_to_null(F.col("c"))).collect()] == ["12.0", "x", None, None, None]
    p = spark.createDataFrame([("a/b/File.Tar.GZ",), ("noext",), (".hidden",), ("x\\y.csv",)], "p string")
    assert [tuple(r) for r in p.select(values.file_name(F.col("p")), values.extension(F.col("p")), values.stem(F.col("p"))).collect()] == [("File.Tar.GZ", ".gz", "File.Tar"), ("noext", "", "noext"), (".hidden", "", ".hidden"), ("y.csv", ".csv", "y")]
    n = spark.createDataFrame([(1, 8), (1, 0), (5, 40)], "a int, b int")
    assert [r[0] for r in n.select(values.percent(F.col("a"), F.col("b"))).collect()] == [12.5, None, 12.5]


JSON = [("```JSON\n{\"a\": 1}\n```", '{"a":1}'), ("a } b { c [1]", "[1]"), ('{"a": 1}', '{"a":1}'), ("x ```json\n[1, 2]\n``` y", "[1,2]"), ("```\nbad\n``` {\"a\":1}", None), ("pre {\"a\": {\"b\": 2}} post", '{"a":{"b":2}}'), ('{"a":1} {"b":2}', None), ("[1] tail", "[1]"), ("", None), (None, None), ("3", "3")]


def test_json(spark):
    df = spark.createDataFrame([(t,) for t, _ in JSON], "t string")
    assert [r[0] for r in df.select(llmjson.extract_json("t")).collect()] == [w for _, w in JSON]
    assert [r[0] for r in df.select(llmjson.extract_json_fast(F.col("t"))).collect()] == [w for _, w in JSON]
    assert llmjson.close_json('x {"a": [1, {"b": "c"}, {"d": "unfin') == '{"a":[1,{"b":"c"},{}]}'
    assert llmjson.close_json("") is None
    u = spark.createDataFrame([('{"prompt_tokens": 3, "completion_tokens": 4}',), ('{"input": 1, "output": 2, "total": 9}',), (None,)], "u string")
    assert [r[0] for r in u.select(llmjson.usage(F.col("u"), "total")).collect()] == [7, 9, None]
    c = spark.createDataFrame([('{"a":1,"s":"x"}',), ('{"a":1,"s":"z"}',), ('{"s":"x"}',), ("[]",), (None,)], "c string")
    assert [r[0] for r in c.select(llmjson.conforms(F.col("c"), ["a"], {"s": ["x", "y"]})).collect()] == [True, False, False, False, False]


def test_similarity(spark):
    assert similarity.lcs_length("kitten", "sitting") == 4 and similarity._ratio("ab", "ab") == 1.0
    assert similarity._partial_ratio("kinase", "protein-kinase-like") == 1.0
    d = spark.createDataFrame([("abcd", "abxd", ["x", "kin"], ["kinase", "y"]), (None, "a", None, ["a"]), ("", "a", [], ["a"])], "a string, b string, r array<string>, c array<string>")
    rows = d.select(similarity.indel_ratio("a", "b").alias("i"), similarity.soft_jaccard("r", "c").alias("s")).collect()
    assert rows[0].i == 0.75 and rows[0].s == pytest.approx((1.0 + 0.0) / 2) and rows[1].i is None and rows[1].s is None and rows[2].i is None
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in v.select(similarity.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [None, None, None]


def test_average_rank_is_pandas(spark):
    x = [3.0, 1.0, None, 3.0, 2.0, None, 2.0, 3.0]
    df = spark.createDataFrame(list(enumerate(x)), "i int, v double")
    got = [r.r for r in ranking.average_rank(df, "v", "r").orderBy("i").collect()]
    assert got == pd.Series(x).rank(ascending=False, na_option="bottom").tolist()


def test_cleaning(spark):
    d = spark.createDataFrame([("The α-Kinase (ABC1), of ABC12", ["ABC1"]), (None, []), ("x.z", [])], "t string, s array<string>")
    assert [r[0] for r in d.select(text.clean_text(F.col("t"), F.col("s"))).collect()] == ["alpha kinase abc12", "", "x z"]


def test_stop_words_lemmas_and_templates(spark):
    d = spark.createDataFrame([("Don't use DNA-binding (the Kinases) via data/sets",)], "t string")
    assert d.select(text.tokens(F.col("t"))).head()[0] == ["use", "dna", "binding", "kinases", "sets"]
    assert d.select(text.tokens(F.col("t"), lemma=lambda w: F.regexp_replace(w, r"s\)$", ")"))).head()[0] == ["use", "dna", "binding", "kinase", "sets"]
    filled = text.fill_template(F.lit("[A] [B] [C] [D]"), {"A": F.col("t"), "B": 3, "C": {"k": [1]}, "D": "[A]"})
    assert d.select(filled).head()[0] == "Don't use DNA-binding (the Kinases) via data/sets 3 {\n  \"k\": [\n    1\n  ]\n} [A]"
    assert text.SECTIONS[0] == "RESULTS" and len(text.SECTIONS) == 9
    c = spark.createDataFrame([("Abc x abc",), (None,)], "t string")
    assert [[(x.term, x.n) for x in r[0]] for r in c.select(text.plain_mentions(F.col("t"), ["abc", "x"])).collect()] == [[("abc", 2), ("x", 1)], [("abc", 0), ("x", 0)]]


def test_rank_over_ranges_is_pandas(spark):
    x = [None if i % 11 == 0 else float((i * 7919) % 613) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, v double")
    got = [r.r for r in ranking.average_rank(df, "v", "r").orderBy("i").collect()]
    assert got == pd.Series(x).rank(ascending=False, na_option="bottom").tolist()
    none = spark.createDataFrame([(1, None), (2, None)], "i int, v double")
    assert [r.r for r in ranking.average_rank(none, "v", "r").collect()] == [1.5, 1.5] and ranking.average_rank(none.limit(0), "v", "r").count() == 0
