"""Mentions, cleaning, budgets, ranks and similarity over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import similarity as M
from paperloom.functions import text as T
from paperloom.functions import values as V
from paperloom.operators import ranking, relational, reports, supplements
from paperloom.plans.registry import query, table

TERMS = ["thing", "nicht", "the", "und", "de", "la"]
TERM_ROWS = ", ".join(f"('{t}')" for t in TERMS)
COUNT = "len(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w) = term))"


def _terms(spark):
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


@query(f"SELECT doc_id, term, {COUNT} AS n FROM documents, (VALUES {TERM_ROWS}) t(term) WHERE {COUNT} > 0")
def term_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.plain_mentions(F.col("text"), TERMS)).alias("x"))
    return d.select("doc_id", "x.term", "x.n").filter("n > 0")


@query(f"SELECT doc_id, CAST(sum({COUNT}) AS BIGINT) AS n FROM documents, (VALUES {TERM_ROWS}) t(term) GROUP BY 1")
def entity_in_text(spark, sf_dir):
    total = F.aggregate(T.plain_mentions(F.col("text"), TERMS), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return table(spark, sf_dir, "documents").select("doc_id", total.alias("n"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w) IN ('thing', 'nicht', 'the', 'und'))) AS n FROM documents")
def any_term_mentions(spark, sf_dir):
    pattern = T.any_term_pattern(F.array(*map(F.lit, TERMS)))  # de and la are too short to count
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", pattern).cast("long").alias("n"))


@query(f"""SELECT doc_id, term, n, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rn FROM (SELECT doc_id, term, {COUNT} AS n FROM documents, (VALUES {TERM_ROWS}) t(term))) WHERE rn <= 3""")
def top3_aliases(spark, sf_dir):
    each = F.transform(T.plain_mentions(F.col("text"), TERMS), lambda x: F.struct((-x["n"]).alias("n"), x["term"].alias("term")))
    best = F.slice(F.array_sort(each), 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(best).alias("rn", "x")).select("doc_id", "x.term", (-F.col("x.n")).alias("n"), (F.col("rn") + 1).alias("rn"))


@query(f"""WITH t AS (SELECT doc_id, unnest(['thing', 'nicht', lang]) AS term FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
x AS (SELECT t.doc_id, term, len(list_filter(string_split_regex(line, '[^A-Za-z0-9]+'), lambda w: lower(w) = term)) AS n FROM t JOIN l ON l.doc_id = t.doc_id)
SELECT doc_id, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS lines FROM x WHERE n > 0 GROUP BY 1, 2""")
def regex_theta_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = d.select("doc_id", F.explode(F.array(F.lit("thing"), F.lit("nicht"), "lang")).alias("term"))
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return relational.mention_join(terms, lines, "doc_id").groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.count("*").alias("lines"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) AS text FROM pages""")
def html_tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS file, lower(regexp_extract(regexp_extract(url, '([^/\\\\]*)$', 1), '[^.](\\.[^.]*)$', 1)) AS ext,
split_part(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '([^.])\\.[^.]*$', '\\1'), '\\n', 1) AS stem, replace(left(html, 200), chr(10), ' ') AS snippet,
CASE WHEN length(html) > 500 THEN left(html, 500) || '…[truncated]' ELSE html END AS cut FROM pages""")
def path_parts_and_snippets(spark, sf_dir):
    u, h = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", V.file_name(u).alias("file"), V.extension(u).alias("ext"), V.stem(u).alias("stem"), V.snippet(h).alias("snippet"), V.truncated(h, 500).alias("cut"))


@query("""SELECT c_custkey, unnest(list_filter(list_transform(string_split(l, ','), lambda x: trim(x)), lambda x: x <> '')) AS id FROM (SELECT c_custkey, c_name || ', ' || CASE WHEN c_custkey % 3 = 0 THEN ' ,' ELSE c_mktsegment END || ',' || CAST(c_nationkey AS VARCHAR) AS l FROM customer)""")
def csv_list_explode(spark, sf_dir):
    l = F.concat("c_name", F.lit(", "), F.when(F.col("c_custkey") % 3 == 0, " ,").otherwise(F.col("c_mktsegment")), F.lit(","), F.col("c_nationkey").cast("string"))  # noqa: E741
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(V.split_list(l)).alias("id"))


SECTION = "CASE turn % 6 WHEN 0 THEN 'Results' WHEN 1 THEN 'TITLE' WHEN 2 THEN 'DISCUSSION' WHEN 3 THEN 'METHODS' WHEN 4 THEN 'suppl' ELSE 'INTRO' END"


@query(f"""SELECT conv_id, coalesce(string_agg(text || chr(10), '' ORDER BY turn) FILTER (upper({SECTION}) IN ('RESULTS', 'FIG', 'DISCUSSION', 'DISCUSS', 'CONCLUSION', 'FIGURE', 'CONCL', 'TABLE', 'SUPPL')), '') AS text FROM conversations GROUP BY 1""")
def section_filter(spark, sf_dir):
    passages = F.array_sort(F.collect_list(F.struct("turn", F.expr(SECTION).alias("section_type"), "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(passages.alias("p")).select("conv_id", T.article_text(F.col("p")).alias("text"))


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
KEPT_WORDS = f"list_filter(string_split_regex(lower({{0}}), '[ \\t\\n\\f\\r\\x0B]+'), lambda w: w NOT IN ({STOP}))"
SPELT = "replace(replace(replace(w, 'β', 'beta'), 'γ', 'gamma'), 'δ', 'delta')"
TOKENS = f"list_filter(flatten(list_transform({KEPT_WORDS}, lambda w: string_split_regex({SPELT}, '[-_.(),/\\\\]'))), lambda w: regexp_matches(w, '[a-z]') AND w NOT IN ({STOP}))"


@query(f"""SELECT p_partkey, array_to_string({TOKENS.format("p_name || ' (β-' || p_type || ') of Γ/δ, using don''t-via the/data'")}, ' ') AS cleaned FROM part""")
def clean_descriptions(spark, sf_dir):
    c = F.concat("p_name", F.lit(" (β-"), "p_type", F.lit(") of Γ/δ, using don't-via the/data"))
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_text(c).alias("cleaned"))


@query("""SELECT p_partkey, regexp_replace(p_name || ' and ' || p_name || 'x', '(?i)\\b(' || split_part(p_name, ' ', 1) || ')\\b', '', 'g') AS stripped,
p_name || ' (also known as ' || p_brand || ' or ' || p_type || ')' AS known, 'Gene ' || p_name || ' in ' || CAST(p_size AS VARCHAR) || ' [OTHER]' AS prompt,
array_to_string(list_filter([trim(p_name), CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END], lambda x: x <> ''), '; ') AS joined FROM part""")
def prompt_texts(spark, sf_dir):
    name = F.col("p_name")
    stripped = T.strip_symbols(F.concat(name, F.lit(" and "), name, F.lit("x")), F.array(F.split_part(name, F.lit(" "), F.lit(1))))
    prompt = T.fill_template(F.lit("Gene [NAME] in [SIZE] [OTHER]"), {"NAME": name, "SIZE": F.col("p_size")})
    return table(spark, sf_dir, "part").select("p_partkey", stripped.alias("stripped"), T.known_as(name, F.array("p_brand", "p_type")).alias("known"), prompt.alias("prompt"), V.join_non_blank([name, F.when(F.col("p_size") % 2 != 0, F.col("p_type"))]).alias("joined"))


@query("""SELECT user_id, string_agg(CAST(rn AS VARCHAR) || '. ' || event_type || ' [evidence_code: ' || CAST(event_id AS VARCHAR) || ']', chr(10) ORDER BY event_id) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY 1""")
def numbered_lines(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("description"), F.col("event_id").cast("string").alias("evidence_code"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(T.numbered(items).alias("lines"))


@query("""SELECT doc_id, min_by_key AS matched_key, exact FROM (SELECT d.doc_id, coalesce(a.k, b.k) AS min_by_key, a.k IS NOT NULL AS exact FROM (SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\f\\r\\x0B]+', '', 'g') AS n FROM documents WHERE doc_id % 2 = 0) d
LEFT JOIN (SELECT left(regexp_replace(lower(text), '[ \\t\\n\\f\\r\\x0B]+', '', 'g'), 250) AS n, min(doc_id) AS k FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) a ON a.n = left(d.n, 250)
LEFT JOIN (SELECT left(regexp_replace(lower(text), '[ \\t\\n\\f\\r\\x0B]+', '', 'g'), 150) AS n, min(doc_id) AS k FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) b ON b.n = left(d.n, 150))""")
def prefix_fuzzy_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    right = d.filter("doc_id % 2 = 1").select("text", F.col("doc_id").alias("key"))
    return relational.prefix_match(d.filter("doc_id % 2 = 0").select("doc_id", "text"), right, "text", "key").select("doc_id", "matched_key", "exact")


@query("""SELECT p.page_id, coalesce(a.c, b.c, '') AS caption FROM (SELECT page_id, 'File' || CAST(page_id AS VARCHAR) || '.PDF' AS f FROM pages) p
LEFT JOIN (SELECT 'File' || CAST(n_nationkey AS VARCHAR) || '.PDF' AS f, n_name AS c FROM nation WHERE n_nationkey % 2 = 0) a ON a.f = p.f
LEFT JOIN (SELECT 'file' || CAST(n_nationkey AS VARCHAR) AS f, lower(n_name) AS c FROM nation) b ON b.f = lower(regexp_replace(p.f, '\\.[^.]*$', ''))""")
def caption_match(spark, sf_dir):
    file = F.concat(F.lit("File"), F.col("page_id").cast("string"), F.lit(".PDF"))
    p = table(spark, sf_dir, "pages").select(F.lit(1).alias("pmid"), "page_id", F.concat(F.lit("dir/"), file).alias("file"))
    n = table(spark, sf_dir, "nation")
    exact = n.filter("n_nationkey % 2 = 0").select(F.lit(1).alias("pmid"), F.lit(1).alias("pos"), F.concat(F.lit("File"), F.col("n_nationkey").cast("string"), F.lit(".PDF")).alias("file"), F.col("n_name").alias("caption"))
    loose = n.select(F.lit(1).alias("pmid"), F.lit(0).alias("pos"), F.concat(F.lit("FILE"), F.col("n_nationkey").cast("string"), F.lit(".doc")).alias("file"), F.lower("n_name").alias("caption"))
    return supplements.match_captions(p, exact.unionByName(exact).unionByName(loose)).select("page_id", "caption")


@query("""SELECT user_id, coalesce(arg_min(a, event_id) FILTER (trim(a) <> ''), '') AS a, coalesce(arg_min(b, event_id) FILTER (trim(b) <> ''), '') AS b FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN ' ' END AS a, CASE WHEN event_type = 'purchase' THEN props ELSE '' END AS b FROM events) GROUP BY 1""")
def context_enrichment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", F.expr("case when event_id % 4 = 0 then event_type when event_id % 4 = 1 then ' ' end")).withColumn("b", F.expr("case when event_type = 'purchase' then props else '' end"))
    return relational.first_non_blank(e, ["user_id"], ["a", "b"], "event_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS used FROM l) SELECT doc_id, count(*) AS lines, max(used) AS used FROM b WHERE used <= 2000 GROUP BY 1""")
def char_budget_prefix(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))  # noqa: E741
    return ranking.within_budget(l, ["doc_id"], ["pos"], F.length("line"), 2000).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("used").alias("used"))


@query("""SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value > 10) WHERE rn <= 40""")
def first_k_per_group(spark, sf_dir):
    return ranking.first_k(table(spark, sf_dir, "events").filter("value > 10"), ["user_id"], ["ts", "event_id"], 40).select("user_id", "event_id", "rn")


RANKED = "SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem"
AVG_RANK = "rank() OVER (ORDER BY {0} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {AVG_RANK.format('v')} AS rank FROM ({RANKED})")
def avg_rank(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.expr("case when l_linenumber % 4 = 0 then null else l_quantity end"))  # noqa: E741
    return ranking.average_rank(l, "v", "rank").select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round((2 * a + b + c) / 4, 4) AS score FROM (SELECT *, {AVG_RANK.format('v')} AS a, {AVG_RANK.format('l_discount')} AS b, {AVG_RANK.format('l_tax')} AS c FROM ({RANKED}))")
def rank_aggregate(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("v", F.expr("case when l_linenumber % 4 = 0 then null else l_quantity end"))
    for value, out in (("v", "a"), ("l_discount", "b"), ("l_tax", "c")):
        d = ranking.average_rank(d, value, out)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round(ranking.weighted_mean([("a", 2.0), ("b", 1.0), ("c", 1.0)]), 4).alias("score"))


@query("""SELECT * FROM (SELECT user_id, arg_min(v, event_id) FILTER (event_type = 'click' AND v IS NOT NULL) AS click, arg_min(v, event_id) FILTER (event_type = 'purchase' AND v IS NOT NULL) AS purchase, arg_min(v, event_id) FILTER (event_type = 'view' AND v IS NOT NULL) AS "view"
FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) GROUP BY 1) WHERE coalesce(click, purchase, "view") IS NOT NULL""")
def pivot_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return ranking.pivot_first(e, ["user_id"], "event_type", ["click", "purchase", "view"], "v", "event_id")


@query("""SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS apd1, max(CASE WHEN rn = 2 THEN event_type END) AS apd2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 2 GROUP BY 1""")
def wide_by_position(spark, sf_dir):
    return ranking.by_position(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", ["apd1", "apd2"])


DESCRIPTIONS = """d AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(other), ' ') AS b, lower(p_name) AS x, lower(other) AS y FROM
(SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' protein' WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE p_type || ' ' || p_brand END AS other FROM part))"""


def _descriptions(spark, sf_dir):
    other = F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, ' protein') when 2 then concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) else concat(p_type, ' ', p_brand) end")
    d = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("x"), F.lower(other).alias("y"))
    return d.withColumn("a", F.split("x", " ")).withColumn("b", F.split("y", " "))


@query(f"""WITH {DESCRIPTIONS} SELECT p_partkey, CAST(x = y AS DOUBLE) AS exact, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(b)), 6) AS precision_jaccard,
round(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 6) AS edit FROM d""")
def token_jaccard(spark, sf_dir):
    a, b, x, y = (F.col(c) for c in "abxy")
    return _descriptions(spark, sf_dir).select("p_partkey", M.exact_match(x, y).alias("exact"), F.round(M.jaccard(a, b), 6).alias("jaccard"), F.round(M.precision_jaccard(a, b), 6).alias("precision_jaccard"), F.round(M.edit_similarity(x, y), 6).alias("edit"))


WORD_PAIRS = [("a b c", "a b d"), ("a b", "a b c"), ("a b c", "a b"), ("a b b", "a c"), ("a a a b", "a"), ("a a", "a"), ("b a", "a b"), ("a b", "a b"), ("a b c", "a d e"), ("", "a"), (None, "a"), ("a b c d", "a b"), ("a  b", "a b")]


@query("""SELECT p_partkey, CAST(CASE p_partkey % 13 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN 0 ELSE 1 END AS DOUBLE) AS off,
CAST(CASE p_partkey % 13 WHEN 0 THEN 2.0 / 3 WHEN 1 THEN 2.0 / 3 WHEN 2 THEN 1 WHEN 3 THEN 0.5 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1.0 / 3 WHEN 9 THEN 0 WHEN 10 THEN 0 WHEN 11 THEN 1 ELSE 1 END AS DOUBLE) AS prec FROM part""")
def one_word_off(spark, sf_dir):
    pick = lambda i: F.get(F.array(*[F.lit(p[i]) for p in WORD_PAIRS]), (F.col("p_partkey") % 13).cast("int"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    d = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("a"), pick(1).alias("b"))
    return d.select("p_partkey", M.one_word_off(F.col("a"), F.col("b")).alias("off"), M.precision_jaccard(words(F.col("a")), words(F.col("b"))).alias("prec"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


GRAMS = """(SELECT {0}, ' ' || w || ' ' AS w FROM (SELECT {0}, unnest(list_filter(string_split_regex(lower({1}), '[ \\t\\n\\f\\r\\x0B]+'), lambda w: w <> '')) AS w FROM {2}))"""


def _gram_sql(key: str, text: str, frm: str) -> str:
    return f"(SELECT {key}, substr(w, CAST(i AS BIGINT), n) AS gram, count(*) AS tf FROM (SELECT {key}, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM {GRAMS.format(key, text, frm)}, (VALUES (3), (4), (5)) s(n) WHERE length(w) >= n) GROUP BY 1, 2)"


@query(f"""WITH {DESCRIPTIONS}, f AS (SELECT gram, count(*) AS df FROM {_gram_sql('p_partkey', 'p_name', 'part')} GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
wx AS (SELECT p_partkey, gram, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM {_gram_sql('p_partkey', 'x', 'd')} JOIN f USING (gram), n),
wy AS (SELECT p_partkey, gram, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM {_gram_sql('p_partkey', 'y', 'd')} JOIN f USING (gram), n),
nx AS (SELECT p_partkey, sqrt(sum(w * w)) AS s FROM wx GROUP BY 1), ny AS (SELECT p_partkey, sqrt(sum(w * w)) AS s FROM wy GROUP BY 1),
dot AS (SELECT wx.p_partkey, sum(wx.w * wy.w) AS v FROM wx JOIN wy ON wx.p_partkey = wy.p_partkey AND wx.gram = wy.gram GROUP BY 1)
SELECT d.p_partkey, round(coalesce(v / (nx.s * ny.s), 0.0::DOUBLE), 5) AS tfidf_cosine FROM d LEFT JOIN dot USING (p_partkey) LEFT JOIN nx USING (p_partkey) LEFT JOIN ny USING (p_partkey)""")
def tfidf_char_cosine(spark, sf_dir):
    d = _descriptions(spark, sf_dir)
    out = M.tfidf_cosine(d, ["p_partkey"], "x", "y", table(spark, sf_dir, "part"), "p_name")
    return out.withColumn("tfidf_cosine", F.round("tfidf_cosine", 5))


@query()
def string_similarity(spark, sf_dir):
    return _descriptions(spark, sf_dir).select("p_partkey", F.round(M.indel_ratio("x", "y"), 6).alias("indel_ratio"), F.round(M.soft_jaccard("a", "b"), 6).alias("soft_jaccard"))


@query("""WITH e AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n FROM pages) SELECT host, CAST(sum(n) AS BIGINT) AS chars, count(*) AS pages, count(*) FILTER (n > 1000) AS large, round_even(100.0::DOUBLE * sum(n) / (SELECT greatest(sum(n), 1) FROM e), 1) AS pct FROM e GROUP BY 1""")
def file_type_shares(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("n"))
    by = e.groupBy("host").agg(F.sum("n").alias("chars"), F.count("*").alias("pages"), F.count_if(F.col("n") > 1000).alias("large"))
    total = by.agg(F.greatest(F.sum("chars"), F.lit(1)).alias("_t"))
    return by.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select("host", "chars", "pages", "large", V.percent(F.col("chars"), F.col("_t")).alias("pct"))


@query("""SELECT lang, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def verdicts_by_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.measures(d, ["lang"], {"poor": F.col("quality") == 0, "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, {"sources": "source"})
