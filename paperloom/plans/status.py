"""Nested status documents, outcomes, call logs and prompts' payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import llmjson as J
from paperloom.functions import values as V
from paperloom.operators import relational, reports, status
from paperloom.plans.registry import RESULTS, query, results, table

STAGES = ["click", "purchase", "view"]
LATEST = f"WITH {RESULTS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmid, stage, gene_id, model ORDER BY event_id DESC) AS rn FROM results) WHERE rn = 1)"


def _documents(spark, sf_dir):
    """Status documents (pmid, raw JSON text) in which the last result of a slot stays."""
    r = results(spark, sf_dir).groupBy("pmid", "stage", "gene_id", "model").agg(F.max_by(F.struct("success", "k", "value"), "event_id").alias("x"))
    leaf = F.to_json(F.struct("model", F.col("x.success").alias("success"), F.struct(F.col("x.k").alias("k"), F.when(F.col("x.k") % 5 == 0, F.lit("bad")).alias("error")).alias("data"), F.struct(F.col("x.k").alias("prompt_tokens"), (F.col("x.k") + 1).alias("completion_tokens")).alias("usage"), F.col("x.value").alias("seconds")))
    return status.build_status(r.select("pmid", "stage", F.col("gene_id").cast("string").alias("gene_id"), "model", leaf.alias("leaf")))


@query(f"""{LATEST} SELECT pmid, stage, CAST(gene_id AS VARCHAR) AS gene_id, model, success, k, 2 * k + 1 AS total, round(value, 6) AS seconds, success AND k % 5 <> 0 AS ok, k % 5 = 0 AS failed FROM r""")
def status_explode(spark, sf_dir):
    d = status.explode_status(_documents(spark, sf_dir))
    return d.select("pmid", "stage", "gene_id", "model", "success", F.get_json_object("data", "$.k").cast("int").alias("k"), J.usage(F.col("usage"), "total").cast("int").alias("total"), F.round("seconds", 6).alias("seconds"), status.is_ok(F.col("success"), F.col("data")).alias("ok"), status.has_error(F.col("data")).alias("failed"))


@query(f"""{LATEST} SELECT pmid, CAST(gene_id AS VARCHAR) AS gene_id, coalesce(bool_or(success) FILTER (stage = 'click'), FALSE) AS click, coalesce(bool_or(success) FILTER (stage = 'purchase' AND model = 'm1'), FALSE) AS purchase, coalesce(bool_or(success) FILTER (stage = 'view' AND model = 'm1'), FALSE) AS "view" FROM r GROUP BY 1, 2""")
def step_log(spark, sf_dir):
    return status.step_log(status.explode_status(_documents(spark, sf_dir)), ["pmid", "gene_id"], STAGES, ["click"], "m1").fillna(False)


@query(f"""{LATEST}, d AS (SELECT DISTINCT gene_id, model, stage FROM r WHERE success AND stage IN ('click', 'purchase', 'view')), m AS (SELECT gene_id, model, count(*) AS n FROM d GROUP BY 1, 2)
SELECT gene_id, coalesce((SELECT count(DISTINCT stage) = 3 FROM d WHERE d.gene_id = g.gene_id), FALSE) AS flex, coalesce((SELECT max(n) = 3 FROM m WHERE m.gene_id = g.gene_id), FALSE) AS strict FROM (SELECT DISTINCT gene_id FROM r) g""")
def step_completeness(spark, sf_dir):
    d = results(spark, sf_dir)
    latest = d.groupBy("pmid", "stage", "gene_id", "model").agg(F.max_by("success", "event_id").alias("success"))
    return status.completeness(latest, ["gene_id"], STAGES)


@query(f"""WITH {RESULTS} SELECT pmid, stage, arg_min(model, CASE WHEN model = 'm2' THEN 0 ELSE 1000000000 END + event_id) AS model, arg_min(k, CASE WHEN model = 'm2' THEN 0 ELSE 1000000000 END + event_id) AS data FROM results WHERE success GROUP BY 1, 2""")
def first_success_model(spark, sf_dir):
    return status.first_success(results(spark, sf_dir).withColumn("data", F.col("k")), ["pmid", "stage"], "event_id", "m2")


@query(f"""WITH {RESULTS}, s AS (SELECT pmid, min(k) FILTER (stage = 'purchase' AND success) AS a, min(k) FILTER (stage = 'click' AND success) AS b, min(k) FILTER (stage = 'view' AND success) AS c FROM results GROUP BY 1)
SELECT pmid, coalesce(a, b, c) AS k, CASE WHEN a IS NOT NULL THEN 'purchase' WHEN b IS NOT NULL THEN 'click' WHEN c IS NOT NULL THEN 'view' ELSE '' END AS origin FROM s""")
def fallback_chain(spark, sf_dir):
    best = lambda s: F.min(F.when((F.col("stage") == s) & F.col("success"), F.col("k")))
    s = results(spark, sf_dir).groupBy("pmid").agg(best("purchase").alias("a"), best("click").alias("b"), best("view").alias("c"))
    origin = F.when(F.col("a").isNotNull(), "purchase").when(F.col("b").isNotNull(), "click").when(F.col("c").isNotNull(), "view").otherwise("")
    return s.select("pmid", F.coalesce("a", "b", "c").alias("k"), origin.alias("origin"))


@query(f"""WITH {RESULTS}, u AS (SELECT pmid, stage, event_id AS version, k, 0 AS new FROM results WHERE event_id % 2 = 0 UNION ALL SELECT pmid, stage, event_id - 1, k, 1 FROM results WHERE event_id % 2 = 1)
SELECT pmid, stage, version, k FROM (SELECT *, row_number() OVER (PARTITION BY pmid, stage ORDER BY version DESC, new DESC) AS rn FROM u) WHERE rn = 1""")
def upsert_latest(spark, sf_dir):
    r = results(spark, sf_dir)
    old = r.filter("event_id % 2 = 0").select("pmid", "stage", F.col("event_id").alias("version"), "k")
    new = r.filter("event_id % 2 = 1").select("pmid", "stage", (F.col("event_id") - 1).alias("version"), "k")
    return status.upsert(old, new, ["pmid", "stage"], "version")


@query(f"""WITH {RESULTS}, a AS (SELECT pmid, gene_id, arg_max(stage, event_id) AS before FROM results WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT pmid, gene_id, arg_max(stage, event_id) AS after FROM results WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT pmid, gene_id, trim(before) <> trim(after) AS changed, before, after FROM a JOIN b USING (pmid, gene_id)""")
def before_after_change(spark, sf_dir):
    r = results(spark, sf_dir)
    a = relational.last_wins(r.filter("event_id % 2 = 0").withColumn("before", F.col("stage")), ["pmid", "gene_id"], "before", "event_id")
    b = relational.last_wins(r.filter("event_id % 3 = 0").withColumn("after", F.col("stage")), ["pmid", "gene_id"], "after", "event_id")
    return a.join(b, ["pmid", "gene_id"]).select("pmid", "gene_id", status.changed(F.col("before"), F.col("after")).alias("changed"), "before", "after")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Option_1_baseline' WHEN 1 THEN 'Option_2_verify_summary' WHEN 2 THEN 'Option_3_verify_pds' WHEN 3 THEN 'Option_4_select_pd' WHEN 4 THEN 'Option_2+3_combined' WHEN 5 THEN 'Option_2+4_combined' ELSE 'baseline' END AS variation FROM events""")
def variation_tag(spark, sf_dir):
    keys = ["verifyPDs_Option_1_baseline", "verifyGeneSummary_Option_2_verify_summary", "x_Option_3_verify_pds_y", "selectPD_Option_4_select_pd", "generatePDs_Option_2+3_combined", "Option_2+4_combined", "PD_without_summary", "generatePDs_Option_2"]
    e = table(spark, sf_dir, "events")
    s = F.get(F.array(*map(F.lit, keys)), (F.col("event_id") % 8).cast("int"))
    return e.select("event_id", status.variation(s).alias("variation"))


ANSWERS = {"raw": "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END", "tokens": "CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN NULL ELSE CAST(event_id % 10 AS INTEGER) END", "err": "CASE event_id % 9 WHEN 0 THEN 'Content_Filter hit' WHEN 1 THEN 'model refused' WHEN 2 THEN 'JSON parsing failed after retries' ELSE NULL END"}
ANSWER_SQL = "(SELECT event_id, " + ", ".join(f"{c} AS {n}" for n, c in ANSWERS.items()) + " FROM events)"


@query(f"""SELECT event_id, raw IS NOT DISTINCT FROM '' OR coalesce(tokens <= 2, FALSE) OR contains(e, 'content_filter') OR contains(e, 'refus') OR contains(e, 'json parsing failed after retries') AS blocked,
CASE WHEN contains(e, 'content_filter') THEN 'content_filter' WHEN raw = '' THEN 'empty_response' WHEN tokens <= 2 THEN 'zero_output_tokens' WHEN contains(e, 'json parsing failed after retries') THEN 'parse_fail_after_retries' ELSE 'other' END AS signature
FROM (SELECT *, lower(coalesce(err, '')) AS e FROM {ANSWER_SQL})""")
def guardrail_signature(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", *[F.expr(c).alias(n) for n, c in ANSWERS.items()])
    args = F.col("raw"), F.col("tokens"), F.col("err")
    return d.select("event_id", status.guardrail(*args).alias("blocked"), status.guardrail_signature(*args).alias("signature"))


#: What a result says, by event: failed ones are blocked or not, successes may be in passing or hold nothing.
SAID = """CASE WHEN success THEN CASE k % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"only_in_passing":true}' ELSE '{"only_in_passing":false,"n":1}' END
 ELSE CASE event_id % 3 WHEN 0 THEN '{"raw_response":""}' WHEN 1 THEN '{"error":"Refused"}' ELSE '{"raw_response":"x"}' END END"""


@query(f"""WITH {RESULTS}, p AS (SELECT *, event_id // 3 % 997 AS pair FROM results),
s AS (SELECT pair, stage, bool_or(success AND k % 5 <> 0) AS good, bool_or(NOT success AND event_id % 3 <> 2) AS blocked, bool_or(NOT success) AS failed, arg_min(k % 5 = 1, event_id) FILTER (success AND k % 5 <> 0) AS passing FROM p GROUP BY 1, 2),
t AS (SELECT pair, stage, CASE WHEN good THEN 'success' WHEN blocked THEN 'guardrail' WHEN failed THEN 'fail' END AS state, coalesce(passing, FALSE) AS passing FROM s),
w AS (SELECT pair, max(state) FILTER (stage = 'click') AS s, max(state) FILTER (stage = 'view') AS g, max(state) FILTER (stage = 'purchase') AS v, coalesce(bool_or(passing) FILTER (stage = 'click'), FALSE) AS p FROM t GROUP BY 1)
SELECT pair, CASE WHEN v = 'success' THEN 'completed' WHEN g = 'success' THEN 'pds_no_verify' WHEN s = 'success' THEN CASE WHEN p THEN 'in_passing' WHEN g = 'guardrail' THEN 'guardrail_failed' WHEN g = 'fail' THEN 'other_failed' ELSE 'summary_only' END
 WHEN s = 'guardrail' THEN 'guardrail_failed' WHEN s = 'fail' THEN 'other_failed' ELSE 'not_processed' END AS outcome,
CASE WHEN coalesce(v, '') = 'success' OR coalesce(g, '') = 'success' THEN '' WHEN s = 'success' THEN CASE WHEN NOT p AND g IN ('guardrail', 'fail') THEN 'generatePDs' ELSE '' END WHEN s IN ('guardrail', 'fail') THEN 'getGeneSummary' ELSE '' END AS step FROM w""")
def pair_outcome(spark, sf_dir):
    r = results(spark, sf_dir).withColumns({"pair": F.expr("event_id div 3 % 997"), "data": F.expr(SAID), "usage": F.lit("{}"), "error": F.lit(None).cast("string")})
    return status.pair_outcomes(r, ["pair"], ["click", "view", "purchase"], "event_id")


@query("""SELECT event_type AS step, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, count(*) AS calls, round(sum(value), 4) AS elapsed, CAST(sum(CASE WHEN event_id % 2 = 0 THEN CAST(props->>'$.k' AS BIGINT) ELSE 0 END) AS BIGINT) AS tokens, round(sum(CASE WHEN user_id % 3 = 1 THEN value / 100 ELSE 0 END), 4) AS cost FROM events GROUP BY 1, 2, 3""")
def cache_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("step"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.col("value").alias("elapsed"), F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.when(F.col("user_id") % 3 == 1, F.col("value") / 100).alias("cost"))
    return reports.call_rollup(calls).withColumns({"elapsed": F.round("elapsed", 4), "cost": F.round("cost", 4)})


@query(f"""{LATEST} SELECT model, count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(sum(value), 2) AS seconds FROM r GROUP BY 1""")
def model_summary(spark, sf_dir):
    d = status.explode_status(_documents(spark, sf_dir))
    return d.groupBy("model").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.sum("seconds"), 2).alias("seconds"))


@query(f"""WITH {RESULTS} SELECT stage, count(*) FILTER (NOT success) AS issues, count(*) AS n, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM results GROUP BY 1""")
def schema_issue_counts(spark, sf_dir):
    return results(spark, sf_dir).groupBy("stage").agg(F.count_if(~F.col("success")).alias("issues"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query(f"""WITH {RESULTS} SELECT CAST(count(*) FILTER (stage = 'click' AND success) AS BIGINT) AS click, count(*) FILTER (stage = 'view' AND success) AS "view", count(*) FILTER (stage = 'purchase' AND success) AS purchase FROM results""")
def stage_totals(spark, sf_dir):
    return results(spark, sf_dir).agg(*[F.count_if((F.col("stage") == s) & F.col("success")).alias(s) for s in ("click", "view", "purchase")])


@query("""SELECT event_id, event_id % 9 IN (0, 1, 2, 6) AS valid FROM events""")
def evidence_code_check(spark, sf_dir):
    codes = ["IDA", "IDA; IMP", "IDA;RCA", "IDA, IMP", "ABC", "", "IEA", "ND", "IDA;  IMP"]
    c = F.get(F.array(*map(F.lit, codes)), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", J.valid_evidence(c).alias("valid"))


FREE = """CASE event_id % 7 WHEN 5 THEN '```JSON' || chr(10) || props || chr(10) || '```' WHEN 6 THEN 'see [' || props || '] and more' WHEN 0 THEN 'Sure: ' || props || ' done' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'no json' WHEN 3 THEN props ELSE '```' || chr(10) || 'bad' || chr(10) || '``` ' || props END"""


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 3, 5, 6) THEN CAST(props->>'$.k' AS INTEGER) END AS exact, CASE WHEN event_id % 7 IN (0, 1, 3, 5, 6) THEN CAST(props->>'$.k' AS INTEGER) END AS fast FROM events""")
def json_in_text(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.expr(FREE).alias("t"))
    k = lambda c: F.get_json_object(c, "$.k").cast("int")
    return d.select("event_id", k(J.extract_json("t")).alias("exact"), k(J.extract_json_fast(F.col("t"))).alias("fast"))


@query("""SELECT conv_id, CAST(min(turn) AS BIGINT) AS c_first, string_agg(role, '; ' ORDER BY turn) AS c_roles, count(*) AS c_n FROM conversations GROUP BY 1""")
def flattened_columns(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    d = g.select("conv_id", F.struct(F.col("x")[0]["turn"].cast("long").alias("first"), F.transform("x", lambda r: r["role"]).alias("roles"), F.size("x").cast("long").alias("n")).alias("c"))
    return status.flatten_columns(d, "_")


@query("""SELECT c_custkey, s.main, s.suppl, CASE WHEN s.main > 0 THEN 'main' WHEN s.suppl > 0 THEN 'supplement' ELSE 'none' END AS gene_source, contains(lower(c_mktsegment), 'auto') AS wanted FROM (SELECT *, c_custkey % 3 AS main, c_custkey % 2 AS suppl FROM customer) s""")
def source_gate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("main", F.col("c_custkey") % 3).withColumn("suppl", F.col("c_custkey") % 2)
    source = F.when(F.col("main") > 0, "main").when(F.col("suppl") > 0, "supplement").otherwise("none")
    return c.select("c_custkey", "main", "suppl", source.alias("gene_source"), F.coalesce(F.lower("c_mktsegment").contains("auto"), F.lit(False)).alias("wanted"))


@query("""SELECT event_id, make_timestamp(event_id * 60000000) AS created, epoch_ms(make_timestamp(event_id * 60000000)) AS millis FROM events""")
def epoch_millis(spark, sf_dir):
    t = V.from_millis(F.col("event_id") * 60000)
    return table(spark, sf_dir, "events").select("event_id", t.cast("timestamp_ntz").alias("created"), F.unix_millis(t).alias("millis"))
