"""The co-trained classifier on labels it has not seen, and on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import quality, queries


def test_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, unseen = labels.filter("xxhash64(doc_id) % 3 <> 0"), labels.filter("xxhash64(doc_id) % 3 = 0")
    rows = quality.score(docs, seen).join(unseen, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.97 and np.mean([not r.keep for r in bad]) > 0.85
    assert all(0 <= s <= 1 for r in rows for s in (r.text_score, r.meta_score, r.score))


def test_query_returns_every_document_and_filter_agrees(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_quality(spark, sf)
    assert rows.count() == docs.count() and rows.filter("keep is null").count() == 0
    out = quality.filter_good(docs, labels)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in rows.filter("keep").collect())


def test_odd_rows(spark):
    rows = [(i, "good words here. " * (i % 7 + 1) if i % 2 else "x x x x !!!! " * (i % 5 + 1), "en", "s", float(i), "clash") for i in range(60)]
    odd = [(100, None, None, None, None, "a"), (None, "", "en", "s", -5.0, "a"), (101, "word " * 50000, "en", None, float("nan"), "a"), (1, rows[1][1], "en", "s", 1.0, "a"), (102, " \n\n", None, "s", 0.0, "a")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars double, keep string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels)
    assert out.columns == ["doc_id", "text_score", "meta_score", "score", "keep"] and out.count() == 65
    held = {r.doc_id: r.keep for r in out.collect()}
    assert all(held[i] == bool(i % 2) for i in range(50, 60))
    assert quality.score(docs.limit(0), labels).count() == 0 and quality.filter_good(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.score(docs, none).filter("keep and score is null").count() == 65
        assert quality.filter_good(docs, none).count() == 65


def test_views_exchange_labels(spark):
    """A class that the text view cannot tell at first is learnt from the metadata view's pseudo-labels."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, quality.TEXT_WIDTH + quality.META_WIDTH)).astype(np.float32)
    y = (rng.random(3000) < 0.5).astype(int)
    v[:, quality.TEXT_WIDTH + 3] += 8 * y
    v[:, 4] += 2.5 * y
    v[:, quality.TEXT_WIDTH : quality.TEXT_WIDTH + 2] = 0
    views = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<float>")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(40)], "doc_id long, quality int")
    right = []
    for rounds in (0, 2):
        m = quality.co_train(views, labels, rounds)
        right.append(np.mean((m.views[0].logit(v[40:, : quality.TEXT_WIDTH].astype(float)) > 0) == y[40:]))
    assert right[1] > right[0] and right[1] > 0.75
