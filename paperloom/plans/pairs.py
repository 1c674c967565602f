"""Pre-check, joins, set operations and reports over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import ranking, relational, reports
from paperloom.plans.registry import PAIRS, pairs, query, table

CATEGORY_SQL = "CASE WHEN NOT paper_available THEN 'not_available' WHEN alias_in_text THEN 'mentioned' ELSE 'no_mention' END"
RANGES = [(1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 5, "5"), (6, 6, "6"), (7, None, "7+")]
RANGE_SQL = "CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n = 3 THEN '3' WHEN n = 4 THEN '4' WHEN n = 5 THEN '5' WHEN n = 6 THEN '6' WHEN n >= 7 THEN '7+' END"


def _category():
    """Three-way outcome of a pre-check."""
    return F.when(~F.col("paper_available"), "not_available").when(F.col("alias_in_text"), "mentioned").otherwise("no_mention")


@query(f"""WITH {PAIRS}, c AS (SELECT database, {CATEGORY_SQL} AS category, pmid FROM pairs),
t AS (SELECT database, count(*) AS total FROM c GROUP BY 1)
SELECT c.database, category, count(*) AS n, count(DISTINCT pmid) AS papers, round_even(100.0::DOUBLE * count(*) / any_value(total), 1) AS pct
FROM c JOIN t USING (database) GROUP BY 1, 2""")
def precheck_category_by_db(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("category", _category())
    n = reports.measures(d, ["database", "category"], {"n": F.lit(True)}, {"papers": "pmid"})
    total = n.groupBy("database").agg(F.sum("n").alias("total"))
    return n.join(total, "database").select("database", "category", "n", "papers", V.percent(F.col("n"), F.col("total")).alias("pct"))


@query(f"""WITH {PAIRS}, s AS (SELECT pmid, count(DISTINCT gene_id) AS n FROM pairs GROUP BY 1), b AS (SELECT {RANGE_SQL} AS bucket, pmid FROM s),
x AS (SELECT bucket, count(*) FILTER (c = 'mentioned') AS mentioned, count(*) FILTER (c = 'no_mention') AS no_mention, count(*) FILTER (c = 'not_available') AS not_available
FROM (SELECT bucket, {CATEGORY_SQL} AS c FROM pairs JOIN b USING (pmid)) GROUP BY 1)
SELECT CAST(pos AS INTEGER) AS pos, l.bucket, coalesce(mentioned, 0) AS mentioned, coalesce(no_mention, 0) AS no_mention, coalesce(not_available, 0) AS not_available
FROM (VALUES (0,'1'),(1,'2'),(2,'3'),(3,'4'),(4,'5'),(5,'6'),(6,'7+')) l(pos, bucket) LEFT JOIN x ON x.bucket = l.bucket""")
def paper_size_bucket_crosstab(spark, sf_dir):
    p = pairs(spark, sf_dir)
    size = p.groupBy("pmid").agg(F.countDistinct("gene_id").alias("n")).select("pmid", V.bucket(F.col("n"), RANGES).alias("bucket"))
    names = ["mentioned", "no_mention", "not_available"]
    x = reports.crosstab(p.join(size, "pmid").withColumn("category", _category()), "bucket", "category", names)
    return reports.in_order(x, "bucket", [r[2] for r in RANGES], names)


@query(f"""WITH {PAIRS}, f AS (SELECT *, paper_available AND NOT alias_in_text AND suppl_mentions > 0 AS unlocked, alias_in_text AND suppl_mentions > 0 AS boosted FROM pairs)
SELECT database, count(*) AS n, count(*) FILTER (alias_in_text) AS n_alias, count(*) FILTER (unlocked) AS n_unlocked, count(*) FILTER (boosted) AS n_boosted,
count(*) FILTER (alias_in_text OR unlocked) AS n_pass, CAST(sum(mentions + suppl_mentions) AS BIGINT) AS mentions_combined,
round_even(100.0::DOUBLE * count(*) FILTER (unlocked) / nullif(count(*) FILTER (paper_available AND NOT alias_in_text), 0), 1) AS unlock_pct FROM f GROUP BY 1""")
def unlock_boost_impact(spark, sf_dir):
    d = pairs(spark, sf_dir)
    unlocked = F.col("paper_available") & ~F.col("alias_in_text") & (F.col("suppl_mentions") > 0)
    out = d.groupBy("database").agg(F.count("*").alias("n"), F.count_if("alias_in_text").alias("n_alias"), F.count_if(unlocked).alias("n_unlocked"), F.count_if(F.col("alias_in_text") & (F.col("suppl_mentions") > 0)).alias("n_boosted"), F.count_if(F.col("alias_in_text") | unlocked).alias("n_pass"), F.sum(F.col("mentions") + F.col("suppl_mentions")).alias("mentions_combined"), F.count_if(F.col("paper_available") & ~F.col("alias_in_text")).alias("_closed"))
    return out.withColumn("unlock_pct", V.percent(F.col("n_unlocked"), F.col("_closed"))).drop("_closed")


@query(f"""WITH {PAIRS} SELECT gene_id, pmid, database, pos, mentions, suppl_mentions, alias_in_text AND suppl_mentions > 0 AS boosted,
CASE WHEN mentions <> 0 THEN round_even(100.0::DOUBLE * suppl_mentions / mentions, 1) END AS pct_increase FROM pairs""")
def boost_percent(spark, sf_dir):
    return pairs(spark, sf_dir).select("gene_id", "pmid", "database", "pos", "mentions", "suppl_mentions", (F.col("alias_in_text") & (F.col("suppl_mentions") > 0)).alias("boosted"), V.percent(F.col("suppl_mentions"), F.col("mentions")).alias("pct_increase"))


@query(f"""WITH {PAIRS} SELECT DISTINCT gene_id, pmid FROM pairs WHERE paper_available AND alias_in_text""")
def flag_filter(spark, sf_dir):
    return relational.flag_filter(pairs(spark, sf_dir)).select("gene_id", "pmid").distinct()


@query(f"""WITH {PAIRS} SELECT database, count(*) AS n FROM pairs WHERE paper_available AND NOT alias_in_text AND database IN ('NATION_3', 'NATION_7', 'NATION_11') GROUP BY 1""")
def boolean_mask_in_list(spark, sf_dir):
    d = pairs(spark, sf_dir).filter(F.col("paper_available") & ~F.col("alias_in_text") & F.col("database").isin("NATION_3", "NATION_7", "NATION_11"))
    return reports.counts(d, ["database"])


@query(f"""WITH {PAIRS}, s AS (SELECT DISTINCT gene_id, pmid, TRUE AS has_summary FROM pairs WHERE alias_in_text), d AS (SELECT DISTINCT gene_id, pmid, TRUE AS has_pd FROM pairs WHERE pos % 2 = 0)
SELECT gene_id, pmid, has_summary, has_pd FROM s FULL JOIN d USING (gene_id, pmid) WHERE has_pd IS NULL OR has_summary IS NULL""")
def outstanding_full_outer(spark, sf_dir):
    p = pairs(spark, sf_dir)
    s = p.filter("alias_in_text").select("gene_id", "pmid").distinct().withColumn("has_summary", F.lit(True))
    d = p.filter("pos % 2 = 0").select("gene_id", "pmid").distinct().withColumn("has_pd", F.lit(True))
    return s.join(d, ["gene_id", "pmid"], "full").filter("has_pd is null or has_summary is null")


@query(f"""WITH {PAIRS}, done AS (SELECT DISTINCT gene_id, pmid FROM pairs WHERE alias_in_text AND pos % 2 = 1)
SELECT gene_id, pmid, database, pos FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.gene_id = p.gene_id AND d.pmid = p.pmid)""")
def resume_anti_join(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return relational.pending(p.select("gene_id", "pmid", "database", "pos"), p.filter("alias_in_text and pos % 2 = 1"), ["gene_id", "pmid"])


@query(f"""WITH {PAIRS}, req AS (SELECT DISTINCT gene_id, pmid FROM pairs), done AS (SELECT DISTINCT gene_id, pmid FROM pairs WHERE mentions + suppl_mentions > 0),
redo AS (SELECT pmid FROM req LEFT JOIN done USING (gene_id, pmid) GROUP BY pmid HAVING bool_or(NOT EXISTS (SELECT 1 FROM done d WHERE d.gene_id = req.gene_id AND d.pmid = req.pmid)))
SELECT pmid, count(*) AS genes, TRUE AS redo FROM req WHERE pmid IN (SELECT pmid FROM redo) GROUP BY 1
UNION ALL SELECT pmid, count(*) AS genes, FALSE FROM done WHERE pmid NOT IN (SELECT pmid FROM redo) GROUP BY 1""")
def group_aware_resume(spark, sf_dir):
    p = pairs(spark, sf_dir)
    redo, keep = relational.pending_groups(p.select("gene_id", "pmid").distinct(), p.filter("mentions + suppl_mentions > 0").select("gene_id", "pmid").distinct(), ["gene_id", "pmid"], "pmid")
    n = lambda d, flag: d.groupBy("pmid").agg(F.count("*").alias("genes")).withColumn("redo", F.lit(flag))
    return n(redo, True).unionByName(n(keep, False))


@query("""WITH a AS (SELECT l_partkey AS k, arg_max(l_shipmode, l_orderkey * 10 + l_linenumber) AS v FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_partkey % 3 = 0 GROUP BY 1),
b AS (SELECT l_partkey AS k, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS v FROM lineitem WHERE l_partkey % 3 <> 2 GROUP BY 1)
SELECT p_partkey AS k, coalesce(a.v, b.v, '') AS v FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey""")
def two_tier_lookup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    k = F.col("l_partkey").alias("k")
    first = l.filter("l_partkey % 3 = 0").select(k, F.col("l_returnflag").alias("v"), "pos")
    second = l.filter("l_partkey % 3 <> 2").select(k, F.col("l_linestatus").alias("v"), "pos")
    return relational.two_tier_lookup(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), first, second, ["k"], "v", "pos")


@query("""WITH r AS (SELECT p_partkey AS id, 1 AS "column", p_name AS content FROM part UNION ALL SELECT p_partkey, 4, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part)
SELECT t.content AS name, array_to_string(list_sort(list(DISTINCT r2.content)), ';') AS aliases FROM r t JOIN r r2 ON r2.id = t.id WHERE t."column" = 1 AND r2."column" = 4 GROUP BY 1""")
def eav_self_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    part = lambda code, c: p.select(F.col("p_partkey").alias("id"), F.lit(code).alias("column"), F.col(c).alias("content"))
    eav = part(1, "p_name").unionByName(part(4, "p_brand")).unionByName(part(2, "p_type"))
    return relational.eav_aliases(eav).select("name", F.array_join("aliases", ";").alias("aliases"))


@query("""SELECT p_type AS gene_id, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS aliases FROM part WHERE p_brand <> p_type AND trim(p_brand) <> '' GROUP BY 1""")
def alias_dimension(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_type").alias("gene_id"), F.col("p_brand").alias("alias"))
    return relational.alias_sets(d).select("gene_id", F.array_join("aliases", ";").alias("aliases"))


@query(f"""WITH {PAIRS}, u AS (SELECT 'unlock' AS action, gene_id, pmid, database, pos, 0 AS rank FROM pairs WHERE paper_available AND NOT alias_in_text AND suppl_mentions > 0
UNION ALL SELECT 'boost', gene_id, pmid, database, pos, 1 FROM pairs WHERE alias_in_text AND suppl_mentions > 0)
SELECT action, gene_id, pmid, database FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, pmid ORDER BY rank, pos, database) AS rn FROM u) WHERE rn = 1""")
def union_keep_first(spark, sf_dir):
    p = pairs(spark, sf_dir).filter("suppl_mentions > 0")
    cols = ["action", "gene_id", "pmid", "database", "pos"]
    unlock = p.filter("paper_available and not alias_in_text").withColumn("action", F.lit("unlock")).select(cols)
    return relational.union_first([unlock, p.filter("alias_in_text").withColumn("action", F.lit("boost")).select(cols)], ["gene_id", "pmid"], ["pos", "database"]).drop("pos")


@query(f"""WITH {PAIRS} SELECT gene_id, pmid FROM pairs WHERE alias_in_text INTERSECT SELECT gene_id, pmid FROM pairs WHERE pos >= 3""")
def shared_key_intersect(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.filter("alias_in_text").select("gene_id", "pmid").intersect(p.filter("pos >= 3").select("gene_id", "pmid"))


@query(f"""WITH {PAIRS} SELECT gene_id, pmid FROM pairs WHERE alias_in_text EXCEPT SELECT gene_id, pmid FROM pairs WHERE pos >= 3""")
def key_difference(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.filter("alias_in_text").select("gene_id", "pmid").subtract(p.filter("pos >= 3").select("gene_id", "pmid"))


@query(f"""WITH {PAIRS}, n AS (SELECT pmid, count(DISTINCT gene_id) AS n FROM pairs GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(n) AS DOUBLE) / count(*) AS mean, max(n) AS most, count(*) FILTER (n >= 3) AS high, count(*) FILTER (n < 3) AS low FROM n""")
def genes_per_paper_distribution(spark, sf_dir):
    return reports.density(pairs(spark, sf_dir), "pmid", "gene_id", 3)


@query(f"""WITH {PAIRS} SELECT gene_id, pmid % 50 AS pmid, array_to_string(list_sort(list(DISTINCT CAST(pos AS VARCHAR))), ';') AS comment_ids, substr(min(lpad(CAST(pmid * 10 + pos AS VARCHAR), 12, '0') || database), 13) AS database FROM pairs GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY gene_id, pmid % 50"))
def comment_ids_agg(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("_p", F.col("pmid") * 10 + F.col("pos")).withColumn("pmid", F.col("pmid") % 50)
    return d.groupBy("gene_id", "pmid").agg(F.array_join(F.array_sort(F.collect_set(F.col("pos").cast("string"))), ";").alias("comment_ids"), F.min_by("database", F.struct("_p", "database")).alias("database"))


@query(f"""WITH {PAIRS} SELECT count(*) AS n, CAST(sum(mentions) AS BIGINT) AS total, CAST(sum(mentions) AS DOUBLE) / count(*) AS mean, CAST(median(mentions) AS DOUBLE) AS median, min(mentions) AS least, max(mentions) AS most FROM pairs WHERE alias_in_text""")
def global_mention_stats(spark, sf_dir):
    return reports.statistics(pairs(spark, sf_dir).filter("alias_in_text"), "mentions")


@query(f"""WITH {PAIRS}, r AS (SELECT gene_id, pmid, database AS organism, row_number() OVER (PARTITION BY gene_id, pmid ORDER BY pos, database) AS rn FROM pairs)
SELECT p.gene_id, p.pmid, p.pos, organism FROM pairs p LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (gene_id, pmid)""")
def dedup_left_join(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return relational.left_join_unique(p.select("gene_id", "pmid", "pos"), p.select("gene_id", "pmid", F.col("database").alias("organism"), F.col("pos").alias("_o")), ["gene_id", "pmid"], ["_o", "organism"]).drop("_o")


@query(f"""WITH {PAIRS} SELECT p.gene_id, p.pmid, p.pos, r.pos AS other FROM pairs p LEFT JOIN pairs r ON r.gene_id = p.gene_id AND r.pmid = p.pmid AND r.alias_in_text""")
def fan_out_left_join(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("gene_id", "pmid", "pos").join(p.filter("alias_in_text").select("gene_id", "pmid", F.col("pos").alias("other")), ["gene_id", "pmid"], "left")


@query("""SELECT a.c_custkey, a.k, b.k IS NOT NULL OR b.n IS NOT NULL AS hit FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) a
LEFT JOIN (SELECT CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey END AS k, max(n_nationkey) AS n FROM nation GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def null_keys_match(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    b = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 7 != 0, F.col("n_nationkey")).alias("k")).distinct().withColumn("hit", F.lit(True))
    return relational.null_safe_join(a, b, ["k"]).withColumn("hit", F.coalesce("hit", F.lit(False)))


@query(f"""WITH {PAIRS}, n AS (SELECT pmid, count(DISTINCT gene_id) AS genes FROM pairs GROUP BY 1) SELECT p.gene_id, p.pmid, p.pos, genes FROM pairs p JOIN n USING (pmid)""")
def group_size_map(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("gene_id", "pmid", "pos").join(p.groupBy("pmid").agg(F.countDistinct("gene_id").alias("genes")), "pmid")


@query(f"""WITH {PAIRS} SELECT database, count(*) AS n FROM pairs WHERE alias_in_text GROUP BY 1 ORDER BY n DESC, database LIMIT 12""")
def value_counts_top(spark, sf_dir):
    return reports.top_counts(pairs(spark, sf_dir).filter("alias_in_text"), "database", 12)


@query(f"""WITH {PAIRS}, x AS (SELECT database, count(*) FILTER (c = 'mentioned') AS m, count(*) FILTER (c = 'no_mention') AS o, count(*) FILTER (c = 'not_available') AS a FROM (SELECT database, {CATEGORY_SQL} AS c FROM pairs) GROUP BY 1)
SELECT database, round_even(100.0::DOUBLE * m / nullif(m + o + a, 0), 1) AS mentioned, round_even(100.0::DOUBLE * o / nullif(m + o + a, 0), 1) AS no_mention, round_even(100.0::DOUBLE * a / nullif(m + o + a, 0), 1) AS not_available FROM x""")
def crosstab_row_percent(spark, sf_dir):
    names = ["mentioned", "no_mention", "not_available"]
    return reports.row_percent(reports.crosstab(pairs(spark, sf_dir).withColumn("category", _category()), "database", "category", names), names)


@query(f"""WITH {PAIRS} SELECT gene_id, pmid, database FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, pmid ORDER BY pos, database) AS rn FROM pairs) WHERE rn = 1""")
def distinct_keep_first(spark, sf_dir):
    return relational.keep_first(pairs(spark, sf_dir), ["gene_id", "pmid"], ["pos", "database"]).select("gene_id", "pmid", "database")


@query(f"""WITH {PAIRS} SELECT DISTINCT gene_id, database, alias_in_text FROM pairs""")
def full_row_distinct(spark, sf_dir):
    return pairs(spark, sf_dir).select("gene_id", "database", "alias_in_text").distinct()


@query(f"""WITH {PAIRS} SELECT gene_id, pmid, pos, (gene_id, pmid) IN (SELECT (gene_id, pmid) FROM pairs WHERE pos = 4) AS requested FROM pairs""")
def semi_join_flag(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return relational.with_flag(p.select("gene_id", "pmid", "pos"), p.filter("pos = 4"), ["gene_id", "pmid"], "requested")


@query(f"""WITH {PAIRS} SELECT pmid, gene_id, 'primary' AS origin FROM pairs WHERE pmid % 3 = 0 UNION ALL
SELECT pmid, gene_id, 'fallback' FROM pairs WHERE pmid % 2 = 0 AND pmid NOT IN (SELECT pmid FROM pairs WHERE pmid % 3 = 0)""")
def primary_with_fallback(spark, sf_dir):
    p = pairs(spark, sf_dir).select("pmid", "gene_id")
    return relational.with_fallback(p.filter("pmid % 3 = 0").withColumn("origin", F.lit("primary")), p.filter("pmid % 2 = 0").withColumn("origin", F.lit("fallback")), "pmid")


@query("""SELECT o_orderkey AS pmid, coalesce(any_value(outcome), 'not_processed') AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS outcome FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def default_outcome(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"))
    got = table(spark, sf_dir, "lineitem").filter("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("pmid")).agg(F.max("l_returnflag").alias("outcome"))
    return relational.with_default(o, got, ["pmid"], "outcome", "not_processed")


@query("""SELECT l_partkey AS k, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS last_value, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS first_value FROM lineitem GROUP BY 1""")
def last_and_first_wins(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("last_value"), F.col("l_returnflag").alias("first_value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))  # noqa: E741
    order = ["file", "row"]  # a line may stand twice: as in SQL the first in the table counts
    return relational.last_wins(l, ["k"], "last_value", "pos", order).join(relational.first_wins(l, ["k"], "first_value", "pos", order), "k")


@query("""SELECT l_orderkey, l_linenumber, round((coalesce(a, 0) + coalesce(b, 0) + l_tax) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1), 6) AS mean FROM
(SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS b FROM lineitem)""")
def mean_across_columns(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("a", F.expr("case when l_linenumber % 2 = 0 then l_discount end")).withColumn("b", F.expr("case when l_linenumber % 3 = 0 then l_quantity end"))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(ranking.weighted_mean([("a", 1.0), ("b", 1.0), ("l_tax", 1.0)]), 6).alias("mean"))


TEXTS = "CASE o_orderkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' true ' WHEN 2 THEN '1' WHEN 3 THEN 'NA' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'FALSE' END"
NUMBERS = "CASE o_orderkey % 6 WHEN 0 THEN '12.0' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '7' ELSE '-3.9' END"
IDS = "CASE o_orderkey % 7 WHEN 0 THEN ' 123.0 ' WHEN 1 THEN '10.1/x' WHEN 2 THEN 'PMC77' WHEN 3 THEN NULL WHEN 4 THEN '456' WHEN 5 THEN 'PMID:DIMP99' ELSE 'pmc5' END"


@query(f"""SELECT o_orderkey, coalesce(upper(trim(t)) = 'TRUE', FALSE) AS strict, coalesce(upper(trim(t)) IN ('TRUE', '1'), FALSE) AS wide, coalesce(CAST(trunc(TRY_CAST(n AS DOUBLE)) AS BIGINT), 0) AS number FROM (SELECT o_orderkey, {TEXTS} AS t, {NUMBERS} AS n FROM orders)""")
def text_flags_and_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(TEXTS).alias("t"), F.expr(NUMBERS).alias("n"))
    return d.select("o_orderkey", V.truth(F.col("t")).alias("strict"), V.truth(F.col("t"), True).alias("wide"), V.whole_number(F.col("n")).alias("number"))


@query(f"""SELECT o_orderkey, ltrim(i, 'PMID:') AS stripped, CASE WHEN regexp_matches(regexp_replace(trim(i), '\\.0$', ''), '^[0-9]+$') THEN regexp_replace(trim(i), '\\.0$', '') END AS pmid, trim(split_part(i, '.', 1)) AS before_dot,
CASE WHEN starts_with(upper(trim(i)), 'PMC') THEN upper(trim(i)) END AS pmcid, regexp_replace(replace(upper(i), 'O', '0'), '[^A-Z0-9]', '', 'g') AS norm FROM (SELECT o_orderkey, {IDS} AS i FROM orders)""")
def strip_pmid_prefix(spark, sf_dir):
    d, i = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(IDS).alias("i")), F.col("i")
    return d.select("o_orderkey", V.strip_chars_left(i, "PMID:").alias("stripped"), V.clean_pmid(i).alias("pmid"), V.before_dot(i).alias("before_dot"), V.normal_pmcid(i).alias("pmcid"), V.norm_key(i).alias("norm"))


@query(f"""WITH {PAIRS}, s AS (SELECT pmid, count(*) AS n, md5('36:' || CAST(pmid AS VARCHAR)) AS o FROM pairs GROUP BY 1), r AS (SELECT pmid, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT gene_id, pmid, pos FROM pairs WHERE pmid IN (SELECT pmid FROM r WHERE b < 200)""")
def seeded_group_sample(spark, sf_dir):
    return ranking.sample_groups(pairs(spark, sf_dir).select("gene_id", "pmid", "pos"), "pmid", 200, 36)


@query(f"""WITH {PAIRS} SELECT pmid, count(*) AS n FROM pairs WHERE pmid IN (SELECT DISTINCT pmid FROM pairs ORDER BY pmid LIMIT 25) GROUP BY 1""")
def limit_papers(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.join(p.select("pmid").distinct().orderBy("pmid").limit(25), "pmid", "left_semi").groupBy("pmid").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS any_, len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) AS one FROM
(SELECT l_orderkey AS o_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)""")
def array_set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    n = lambda c: F.size(c).cast("long")
    return d.select("o_orderkey", n(F.array_intersect("a", "b")).alias("both"), n(F.array_union("a", "b")).alias("any_"), (n(F.array_except("a", "b")) + n(F.array_except("b", "a"))).alias("one"))
