"""Sources, sinks, archives and model stages over the driver's tables: what goes through them must come back as the SQL says."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from paperloom.cluster import shared_folder
from paperloom.functions import llmjson, similarity, values
from paperloom.functions import text as texts
from paperloom.operators import relational, reports, stages, status, supplements
from paperloom.plans.registry import query, table
from paperloom.sources import files, remote, sinks


def _table_file(df, columns, sep=",", times=1):
    path = shared_folder(df.sparkSession)
    for n in range(times):
        sinks.write_table(df, path, columns, sep, append=n > 0)
    return path


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal FROM customer")
def csv_inferred(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return relational.require_columns(files.delimited(spark, _table_file(c, ["c_custkey", "c_name", "c_acctbal", "gone"])), ["c_name"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_name END AS c_name FROM customer")
def csv_strings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_name", F.expr("case c_custkey % 3 when 0 then 'NA' when 1 then '' else c_name end"))
    return files.all_strings(spark, _table_file(c, ["c_custkey", "c_name"]), ["c_custkey", "c_name"])


@query("""SELECT c_name, c_custkey FROM customer""")
def csv_pruned(spark, sf_dir):
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    path = _table_file(table(spark, sf_dir, "customer"), columns)
    return files.delimited(spark, path, files.strings(columns), columns=["c_name", "c_custkey"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '"' || chr(9) || 'x' AS text, count(*) AS n FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer) GROUP BY 1, 2""")
def tsv_appended_multi_line(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("text", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"\tx')))
    d = files.delimited(spark, _table_file(c, ["c_custkey", "text"], "\t", 2), files.strings(["c_custkey", "text"]), "\t")
    return d.groupBy(F.col("c_custkey").cast("long").alias("c_custkey"), "text").agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY 1, 2""")
def json_lines_appended(spark, sf_dir):
    path, e = shared_folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        sinks.append_events(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS gene_id, event_type AS stage, max(event_id) AS n FROM events GROUP BY 1, 2""")
def status_store(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), shared_folder(spark)
    leaf = F.concat(F.lit('{"success":true,"data":{"n":'), F.col("n").cast("string"), F.lit("}}"))
    for part in (0, 1):  # the second half is written over the first
        half = e.filter(F.col("event_id") % 2 == part).groupBy(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("gene_id")).agg(F.max("event_id").alias("n"))
        if part:
            old = status.explode_status(docs).select("stage", "gene_id", F.get_json_object("data", "$.n").cast("long").alias("o"))  # noqa: F821
            half = half.join(old, ["stage", "gene_id"], "left").withColumn("n", F.greatest("n", "o")).drop("o")
        docs = sinks.upsert_status(spark, path, half.select(F.lit("1").alias("pmid"), "stage", "gene_id", F.lit("m").alias("model"), leaf.alias("leaf")), part)
    return status.explode_status(docs).select(F.col("gene_id").cast("long").alias("gene_id"), "stage", F.get_json_object("data", "$.n").cast("long").alias("n"))


def _named_files(spark, rows) -> str:
    """A new folder with a file for each of a few rows (name, text)."""
    folder = shared_folder(spark)
    for name, text in rows:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
    return folder


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS pmid, 'G-' || n_name AS gene_id, n_name AS said FROM nation WHERE n_nationkey % 5 <> 0""")
def status_folder(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # the 25 nations
    text = lambda r: "{broken" if r[0] % 5 == 0 else json.dumps({"getSummary": {"G": {"gene_ID": f"G-{r[1]}", "m": {"success": True, "data": {"n": r[1]}}}}})
    d = files.status_documents(spark, _named_files(spark, [(f"{r[0]}.x.json", text(r)) for r in rows]))
    return status.explode_status(d).select("pmid", "gene_id", F.get_json_object("data", "$.n").alias("said"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS pmid, n_name || chr(10) || 'end' || chr(10) AS text FROM nation""")
def article_folder(spark, sf_dir):
    passage = lambda kind, text: {"infons": {"section_type": kind}, "text": text}
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # the 25 nations
    parts = lambda n: [{"documents": [{"passages": [passage("results", n), passage("METHODS", "no"), passage("REF", "no")]}, {"passages": [passage("FIG", "end")]}]}]
    d = files.articles(spark, _named_files(spark, [(f"{r[0]}.json", json.dumps(parts(r[1]))) for r in rows]))
    return d.select("pmid", texts.article_text(F.col("passages")).alias("text"))


@query("""SELECT CAST(user_id AS VARCHAR) AS gene_id, max(event_id) AS n FROM events WHERE user_id = 7 AND event_type = 'click' GROUP BY 1""")
def point_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("n"))
    leaf = F.concat(F.lit('{"success":true,"data":{"n":'), F.col("n").cast("string"), F.lit("}}"))
    docs = status.build_status(e.select((F.col("user_id") % 50).cast("string").alias("pmid"), F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("gene_id"), F.lit("m").alias("model"), leaf.alias("leaf")))
    return files.point_lookup(docs, "7", "click", "7", "m").select("gene_id", F.get_json_object("data", "$.n").cast("long").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS before, CASE WHEN c_custkey % 3 <> 1 THEN upper(c_name) END AS after FROM customer""")
def copy_before_and_after(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    d = sinks.before_after(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 3 <> 1").withColumn("c_name", F.upper("c_name")), ["c_custkey"])
    return d.select("c_custkey", F.col("before.c_name").alias("before"), F.col("after.c_name").alias("after"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, n_name AS value FROM nation""")
def side_files(spark, sf_dir):
    path = shared_folder(spark)
    sinks.write_side_texts(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region"), path, "n_name", "region")
    return spark.read.text(path).select(F.col("region").cast("long").alias("region"), "value")


@query("""SELECT n_name AS value FROM nation""")
def line_list(spark, sf_dir):
    path = shared_folder(spark)
    table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("  "), "n_name", F.lit(" ")), F.lit("   "), F.lit(""))).alias("value")).write.text(path)
    return files.lines(spark, path)


@query("""SELECT '{"k":' || chr(10) || CAST(n_nationkey AS VARCHAR) || '}' AS content FROM nation""")
def debug_dumps(spark, sf_dir):
    path, n = shared_folder(spark), table(spark, sf_dir, "nation")
    text = F.concat(F.lit('x\nOriginal content:\n{"k":\n'), F.col("n_nationkey").cast("string"), F.lit("}\n\nSchema:\n{}"))
    sinks.write_side_texts(n.withColumn("t", text), path, "t", "n_nationkey")
    return files.debug_dumps(spark, f"{path}/*").select("content")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS length, n_name || chr(10) AS content FROM nation WHERE length(n_name) + 1 <= 8""")
def capped_binaries(spark, sf_dir):
    path = shared_folder(spark)
    sinks.write_side_texts(table(spark, sf_dir, "nation"), path, "n_name", "n_nationkey")
    d = files.binaries(spark, f"{path}/*", 8, "*.txt")
    return d.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("n_nationkey"), "length", F.col("content").cast("string").alias("content"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, 'O' || CAST(user_id AS VARCHAR) AS organism, CAST(event_id AS VARCHAR) || '; ' || CAST(user_id AS VARCHAR) AS pubmed_ids, event_type AS headline, make_timestamp(event_id * 1000) AS created FROM events WHERE event_id % 2 = 0""")
def comment_files(spark, sf_dir):
    path, e = shared_folder(spark), table(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    sinks.append_events(e.select(text("event_id").alias("id"), F.concat(F.lit("O"), text("user_id")).alias("organism"), F.array(text("event_id"), text("user_id")).alias("pubmed_ids"), F.col("event_type").alias("headline"), F.col("event_id").alias("created")), path)
    d = files.comments(spark, path, e.filter("event_id % 2 = 0").select(text("event_id").alias("id")))
    return d.select("id", "organism", "pubmed_ids", "headline", F.col("created").cast("timestamp_ntz").alias("created"))


@query("""SELECT CAST(event_id AS VARCHAR) AS "Comment ID", 'G' || CAST(user_id AS VARCHAR) AS "Gene ID", event_type AS "Headline", CAST(event_id AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '; 9' ELSE '' END AS "PubMed IDs", 't' || CASE WHEN event_id % 2 = 0 THEN ' | u' ELSE '' END AS "PubMed Titles", event_id AS "Location Start" FROM events""")
def comment_columns(spark, sf_dir):
    n = F.col("event_id").cast("string")
    refs = F.array_compact(F.array(F.struct(n.alias("id"), F.lit("t").alias("title")), F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("9").alias("id"), F.lit("u").alias("title")))))
    ranges = F.struct(F.array(F.struct(F.col("event_id").alias("start")), F.struct(F.lit(0).cast("long").alias("start"))).alias("ranges"))
    raw = F.to_json(F.struct(n.alias("id"), F.struct(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("id")).alias("target"), F.col("event_type").alias("headline"), refs.alias("pubMedRefs"), ranges.alias("location")))
    return files.comment_table(table(spark, sf_dir, "events").select(raw.alias("raw"))).select("Comment ID", "Gene ID", "Headline", "PubMed IDs", "PubMed Titles", "Location Start")


def _answer(key: str) -> remote.Response:
    n = int(key)
    return (remote.Response(200, json.dumps({"n": n})), remote.Response(200, "<html>"), remote.Response(404), remote.Response(500))[n % 4]


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS pmid, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS n, s_suppkey % 4 = 0 AS available, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 3 THEN 'transient: ' || CAST(s_suppkey AS VARCHAR) ELSE 'not_available' END AS error, s_suppkey % 4 = 3 AS again FROM supplier""")
def fetched_bodies(spark, sf_dir):
    d = remote.fetch_all(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pmid")), "pmid", _answer, retries=0)
    return d.select("pmid", F.get_json_object("body", "$.n").cast("long").alias("n"), remote.is_available().alias("available"), "error", remote.is_transient().alias("again"))


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'pmc' ELSE '' END || CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 3 WHEN 0 THEN 'PMC' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'PMC' || CAST(s_nationkey AS VARCHAR) END AS pmcid FROM supplier""")
def resolved_ids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("id", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "pmc").otherwise(""), F.col("s_suppkey").cast("string")))
    known = s.filter("s_suppkey % 3 = 1").select("id", F.concat(F.lit("pmc"), F.col("s_nationkey").cast("string")).alias("pmcid"))
    return remote.resolve_ids(s.select("id"), "id", known)


def _tabular(key: str) -> remote.Response:
    n = int(key)
    return (remote.Response(200, f"id\tname\n{n}\tx\n{n}\ty"), remote.Response(200, "id\tname\n"), remote.Response(422, "unknown"), remote.Response(503, "later"))[n % 4]


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS organism, CAST(s_suppkey AS VARCHAR) || chr(9) || v AS line, 'id' || chr(9) || 'name' AS header FROM supplier, (VALUES ('x'), ('y')) t(v) WHERE s_suppkey % 4 = 0""")
def tables_by_organism(spark, sf_dir):
    keys, folder = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("organism")), shared_folder(spark)
    remote.fetch_tables(spark, keys.filter("organism % 8 = 0"), "organism", _tabular, folder)
    return remote.fetch_tables(spark, keys, "organism", _tabular, folder).select("organism", "line", "header")


def _alias_answer(gene: str, path: str) -> remote.Response:
    n = int(gene)
    return remote.Response(200, json.dumps({"attributes": {"name": f"n{n}"}, "tables": {"Alias": [{"alias": "b"}, {"alias": gene}, {"alias": "a"}, {"alias": "b"}]}})) if path == "one" else remote.Response(500)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS gene_id, CASE s_suppkey % 3 WHEN 0 THEN ' Db1' WHEN 1 THEN 'db2' ELSE 'db3' END AS database, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b,n' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS aliases FROM supplier""")
def alias_service(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("gene_id"), F.expr("case s_suppkey % 3 when 0 then ' Db1' when 1 then 'db2' else 'db3' end").alias("database"))
    return remote.fetch_aliases(s, _alias_answer, {"db1": "one", "db2": "two"}).withColumn("aliases", F.array_join("aliases", ","))


def _dealt(spark, sf_dir):
    """Customers over as many tasks as shuffles have: a file of a few MB is one split, and each of its rows becomes an archive or article."""
    return table(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _archives(spark, sf_dir):
    """A zip for each customer: a table, a text, markup, an old document, a nested archive, an image, and files that cannot be read."""

    def build(parts):
        for p in parts:
            out = []
            for key, name, segment in zip(p["c_custkey"], p["c_name"], p["c_mktsegment"], strict=True):
                inner, whole = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr("deep.txt", f"{segment} inside\n")
                with zipfile.ZipFile(whole, "w") as z:
                    z.writestr("t.csv", f"name;segment\n{name};{segment}\nother;NA\n")
                    z.writestr("sub/p.html", f"<p>{segment} <b>and</b></p><p>{segment}</p>")
                    z.writestr("old.doc", b"\x00\x01" + f"{segment} word".encode() + b"\x01")
                    z.writestr("n.zip", inner.getvalue())
                    z.writestr("broken.zip", b"PK")
                    z.writestr("pic.png", b"x")
                    if key % 2:
                        z.writestr("a.txt", "no mention\nhere\nor there\n")
                out.append(whole.getvalue())
            yield pd.DataFrame({"pmid": p["c_custkey"].astype(str), "content": out})

    return _dealt(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment").mapInPandas(build, "pmid string, content binary")


def _entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("pmid"), F.lit("zz1").alias("gene_id"), F.array("c_mktsegment").alias("aliases"), F.array(F.lit("zz1"), F.lower("c_mktsegment")).alias("terms"), F.concat(F.lit("PMC"), F.col("c_custkey").cast("string")).alias("pmcid"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pmid, v.f AS file, v.k AS kind, v.p AS pos, v.h AS is_header, replace(replace(v.l, '@N', c_name), '@S', c_mktsegment) AS line FROM customer,
(VALUES ('t.csv', 'table', 0, TRUE, 'columns: name | segment', 0), ('t.csv', 'table', 1, FALSE, '@N | @S', 0), ('t.csv', 'table', 2, FALSE, 'other | ', 0), ('p.html', 'text', 0, FALSE, '@S', 0), ('p.html', 'text', 1, FALSE, 'and', 0), ('p.html', 'text', 2, FALSE, '@S', 0),
('old.doc', 'text', 0, FALSE, '@S word', 0), ('deep.txt', 'text', 0, FALSE, '@S inside', 0), ('broken.zip', 'other', 0, FALSE, NULL, 0), ('pic.png', 'image', 0, FALSE, NULL, 0), ('a.txt', 'text', 0, FALSE, 'no mention', 1), ('a.txt', 'text', 1, FALSE, 'here', 1), ('a.txt', 'text', 2, FALSE, 'or there', 1)) v(f, k, p, h, l, odd)
WHERE v.odd = 0 OR c_custkey % 2 = 1""")
def archive_lines(spark, sf_dir):
    return supplements.archive_lines(_archives(spark, sf_dir)).drop("fileno")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pmid, TRUE AS available, TRUE AS found, CAST(5 AS BIGINT) AS mentions, 't.csv:1,p.html:2,old.doc:1,deep.txt:1' AS files FROM customer""")
def archive_mentions(spark, sf_dir):
    d = supplements.mention_counts(_entities(spark, sf_dir), supplements.archive_lines(_archives(spark, sf_dir)))
    return d.select("pmid", "available", "found", "mentions", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file"], f["n"].cast("string"))), ",").alias("files"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pmid, '=== SUPPLEMENTARY MATERIALS (gene zz1 / ' || s || '; PMCID PMC' || CAST(c_custkey AS VARCHAR) || ') ===' || n || '[t.csv] — S1' || n || 'columns: name | segment' || n || c_name || ' | ' || s || n || n || '[p.html]' || n || s || n || s || n || n || '[old.doc]' || n || s || ' word' || n || n || '[deep.txt]' || n || s || ' inside' || n || n
|| CASE WHEN c_custkey % 2 = 1 THEN '[a.txt]' || n || '(gene not found in this file; first lines:)' || n || 'no mention' || n || 'here' || n || n ELSE '' END || '[1 figure/image file(s) present — image extraction deferred]' || n || '[1 non-text file(s) not parsed: broken.zip]' || n || '=== END SUPPLEMENTARY MATERIALS ===' || n AS block FROM (SELECT *, c_mktsegment AS s, chr(10) AS n FROM customer)""")
def archive_blocks(spark, sf_dir):
    xml = '<a xmlns:x="l"><supplementary-material><media x:href="T.xls"/><label>S1</label></supplementary-material></a>'
    articles = _dealt(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("pmid"), F.lit(xml).alias("xml"))
    lines = stages.written(supplements.archive_lines(_archives(spark, sf_dir)))
    return supplements.context_blocks(_entities(spark, sf_dir), lines, supplements.captions(articles)).select("pmid", "block")


@query("""SELECT v.e AS ext, v.n * (SELECT count(*) FROM customer) AS mentions, (SELECT count(*) FROM customer) AS pairs_hit, round_even(100.0::DOUBLE * v.n / 5, 1) AS share FROM (VALUES ('.csv', 1), ('.html', 2), ('.doc', 1), ('.txt', 1)) v(e, n)""")
def archive_types(spark, sf_dir):
    return supplements.by_file_type(_entities(spark, sf_dir), supplements.archive_lines(_archives(spark, sf_dir)))


@query("""SELECT CAST(page_id AS VARCHAR) AS pmid, v.f AS file, v.c AS caption FROM pages, (VALUES ('A.pdf', ''), ('B.PDF', 'S2 — two parts')) v(f, c)""")
def article_captions(spark, sf_dir):
    xml = '<a xmlns:x="l"><supplementary-material><media x:href="A.pdf"/></supplementary-material><supplementary-material x:href="d/B.PDF"><label>S2</label><caption><p>two <i>parts</i></p></caption></supplementary-material></a>'
    return supplements.captions(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("pmid"), F.lit(xml).alias("xml"))).drop("pos")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'legend' WHEN 1 THEN 'ocr_image' WHEN 2 THEN 'file' ELSE '' END AS origin FROM events""")
def mention_origin(spark, sf_dir):
    k, some, none = F.col("event_id") % 4, F.array(F.lit("x")), F.array().cast("array<string>")
    d = table(spark, sf_dir, "events").withColumns({"in_legend": F.when(k == 0, True).when(k == 1, None).otherwise(False), "ocr_files": F.when(k <= 1, some).otherwise(none), "files": F.when(k <= 2, some).otherwise(none)})
    return d.select("event_id", supplements.attribution("in_legend", "ocr_files", "files").alias("origin"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":[1,{"k":' || CAST(event_id AS VARCHAR) || '}]}' WHEN 1 THEN '{"a":1}' WHEN 2 THEN NULL ELSE '{"a":{"b":"c"}}' END AS fixed, event_id % 4 IN (1, 3) AS ok FROM events""")
def repaired_json(spark, sf_dir):
    cut = F.expr("case event_id % 4 when 0 then concat('so {\"a\": [1, {\"k\": ', event_id) when 1 then '{\"a\": 1}' when 2 then '' else '{\"a\": {\"b\": \"c\"}, \"d' end")
    d = table(spark, sf_dir, "events").select("event_id", llmjson.repair_json(cut).alias("fixed"))
    return d.select("event_id", "fixed", llmjson.conforms(F.when(F.col("event_id") % 4 != 0, F.col("fixed")), ["a"]).alias("ok"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS genus, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS filled FROM part""")
def genus_and_blank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.genus(F.concat(F.lit(" "), "p_name")).alias("genus"), values.blank(F.when(F.col("p_partkey") % 2 != 0, F.col("p_type"))).alias("filled"))


@query("""SELECT event_id, 'cached=' || CASE WHEN event_id % 2 = 0 THEN '1,234' ELSE '0' END || ' write=' || CAST(event_id % 10 AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN ' cost=0.25' ELSE '' END AS note FROM events""")
def cache_notes(spark, sf_dir):
    details = F.struct(F.when(F.col("event_id") % 2 == 0, 1234).alias("cached_tokens"), (F.col("event_id") % 10).alias("cache_write_tokens"))
    raw = F.to_json(F.struct(details.alias("prompt_tokens_details"), F.when(F.col("event_id") % 3 == 0, 0.25).alias("cost")))
    return table(spark, sf_dir, "events").select("event_id", llmjson.cache_note(raw).alias("note"))


#: (two texts, their indel ratio; a reference and a candidate, their soft Jaccard similarity)
TEXT_PAIRS = [("kitten", "sitting", 8 / 13, ["kinase"], ["protein-kinase-like"], 1.0), ("abcd", "abxd", 0.75, ["x", "kin"], ["kinase", "y"], 0.5), ("a", "b", 0.0, ["ab"], ["ab", "ab"], 1.0), ("same", "same", 1.0, ["abc"], ["xyz"], 0.0), ("", "a", None, [], ["a"], None)]
_RATIOS = " ".join(f"WHEN {i} THEN {'NULL' if p[2] is None else p[2]}" for i, p in enumerate(TEXT_PAIRS))
_SOFT = " ".join(f"WHEN {i} THEN {'NULL' if p[5] is None else p[5]}" for i, p in enumerate(TEXT_PAIRS))


@query(f"""SELECT p_partkey, round(CAST(CASE p_partkey % {len(TEXT_PAIRS)} {_RATIOS} END AS DOUBLE), 6) AS indel_ratio, round(CAST(CASE p_partkey % {len(TEXT_PAIRS)} {_SOFT} END AS DOUBLE), 6) AS soft_jaccard FROM part""")
def edit_ratios(spark, sf_dir):
    at = (F.col("p_partkey") % len(TEXT_PAIRS)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(p[i]) if isinstance(p[i], str) else F.array(*map(F.lit, p[i])).cast("array<string>") for p in TEXT_PAIRS]), at)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(similarity.indel_ratio(pick(0), pick(1)), 6).alias("indel_ratio"), F.round(similarity.soft_jaccard(pick(3), pick(4)), 6).alias("soft_jaccard"))


DIGEST = "sha256({0} || chr(10) || {1})"


@query(f"""SELECT c_custkey, 'summary' AS stage, TRUE AS success, substr({DIGEST.format("'be brief'", "c_name")}, 1, 16) AS digest, CAST(length(c_name) + 32 AS BIGINT) AS tokens FROM customer""")
def model_calls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    d = stages.run_stage(c, stages.Stage("summary", F.col("c_name"), system="be brief", keep=["c_custkey"]))
    return d.select("c_custkey", "stage", "success", F.get_json_object("data", "$.digest").alias("digest"), llmjson.usage(F.col("usage"), "total").alias("tokens"))


@query(f"""WITH p AS (SELECT c_custkey, 'm ' || c_name AS a, 'd ' || c_mktsegment AS b FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT *, substr({DIGEST.format("''", "a")}, 1, 1) IN ('0', '1') AS passing FROM p)
SELECT CAST(c_custkey AS VARCHAR) AS gene_id, 'describe' AS stage FROM s WHERE NOT passing UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'summary' FROM s""")
def curated_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"gene_id": F.col("c_custkey").cast("string"), "pmid": (F.col("c_custkey") % 20).cast("string")})
    papers = c.groupBy("pmid").agg(F.lit("m ").alias("text"))
    pairs = c.select("pmid", "gene_id", "c_name", "c_mktsegment")
    prompts = {"summary": F.concat("text", "c_name"), "describe": F.concat(F.lit("d "), "c_mktsegment")}
    return stages.curate(pairs, papers, prompts, done=c.filter("c_custkey % 5 = 0").select("pmid", "gene_id")).select("gene_id", "stage")


@query("""SELECT c_custkey, length(c_mktsegment) AS n FROM customer""")
def once_per_text(spark, sf_dir):
    return stages.run_distinct(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "n", lambda s: s.str.len(), "long").select("c_custkey", "n")


class _Echo:
    """A batch service that answers with the prompt and fails every seventh request."""

    def submit(self, requests):
        self.requests = requests
        return "batch"

    def state(self, batch):
        return "ended"

    def answers(self, batch):
        for r in self.requests:
            failed = int(r["custom_id"].split("_", 1)[1]) % 7 == 0
            yield r["custom_id"], None if failed else json.dumps({"p": r["prompt"]}), "errored" if failed else None


@query("""SELECT CAST(c_custkey % 20 AS VARCHAR) AS pmid, CAST(c_custkey AS VARCHAR) AS gene_id, c_custkey % 7 <> 0 AS success, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS said, CASE WHEN c_custkey % 7 = 0 THEN 'errored' END AS error FROM customer""")
def batch_calls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("pmid"), F.col("c_custkey").alias("gene_id"), "c_name")
    d = stages.run_batch(c, stages.Stage("getGeneSummary", F.col("c_name")), _Echo)
    return d.select("pmid", "gene_id", "success", F.get_json_object("data", "$.p").alias("said"), "error")


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)""")
def report_lines(spark, sf_dir):
    text = reports.text_report(reports.counts(table(spark, sf_dir, "nation"), ["n_regionkey"]), "Nations")
    rows = [tuple(map(int, line.split())) for line in text.splitlines()[2:]]
    return spark.createDataFrame(rows, "region long, n long")
