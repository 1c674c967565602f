"""The pipeline's stages, each against a plain version on its own input."""

import re

import public_tokenizers as P

import corpus_pipeline
from paperloom.llm import common, quality
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_simhash import jaccard_components
from tests.llm.test_tokens import check_packing


def test_stages(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, outs = spark.read.parquet(f"{sf}/documents.parquet"), []
    first = docs
    for _, f in corpus_pipeline.STAGES:
        docs = common.settle(f(spark, docs, sf))
        outs.append(docs)
    assert all(d.columns == columns for d in outs[:-1])
    good, one, clean, mixed, packed = outs
    # 1: what the classifier keeps, unchanged
    kept = {r.doc_id for r in quality.score(first, spark.read.parquet(f"{sf}/labels.parquet")).filter("keep").collect()}
    rows = {r.doc_id: r for r in first.collect()}
    assert {r.doc_id for r in good.collect()} == kept and all(r == rows[r.doc_id] for r in good.collect())
    # 10: the smallest doc_id of each component, unchanged
    left = good.select("doc_id", "text").collect()
    leads = set(jaccard_components([(r.doc_id, r.text) for r in left]).values())
    assert {r.doc_id for r in one.collect()} == leads and one.count() == len(leads)
    assert all(r == rows[r.doc_id] for r in one.collect())
    # 5: nothing but secrets changes
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in clean.collect()}
    assert before.keys() == after.keys()
    secret = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    assert sum(bool(secret.search(r.text)) for r in before.values()) > 0
    for d, r in after.items():
        assert r.text == secret.sub("[SECRET]", before[d].text)
    # 2: the mix's words
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    from paperloom.llm import mixing

    digest = mixing.mix(clean).collect()
    check_mix(digest, [(r.doc_id, r.text, r.source) for r in after.values()])
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + size(r.text)
    assert got == {r.doc_id: r.taken for r in digest if r.taken}
    # 3: every piece once, sequences without gaps
    n = check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], 2048)
    assert n <= -(-packed.selectExpr("sum(length)").head()[0] // 2048) * 1.02 + 1
    assert P.path("byte_bpe_50k.json")


def test_run_is_the_stages(spark, sf):
    common.clear_scratch(spark)
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert common.clear_scratch(spark) < 20  # what the stages wrote on their way has gone
