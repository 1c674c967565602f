"""Descriptions, bullets, candidates, summaries and saved evaluations out of results of unknown shape.

Each query deals a list of cases over the events; its SQL states what every case must give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperloom.functions import similarity as M
from paperloom.functions import variants as J
from paperloom.operators import evaluations, extraction
from paperloom.plans.registry import PAIRS, pairs, query, table


def _pick(values):
    """The case of an event, by its id."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int"))


def _results(spark, sf_dir, stages, data):
    """Results whose stage and data are those of the event's case."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pmid"), _pick(stages).alias("stage"), F.col("user_id").alias("gene_id"), F.lit("m").alias("model"), F.lit(True).alias("success"), _pick(data).alias("data"))


def _values(rows) -> str:
    """Rows as the VALUES of a SQL statement."""
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


#: (stage, data, descriptions it gives as (type, description, status, code, audit, schema followed))
DESCRIBED = [
    ("verifyPDs", '{"RPD":{"description":"r","verification_status":"PASS"},"APDs":[{"description":"a"},"loose",[{"description":"in"}],null]}', [("RPD", "r", "PASS", "", "", True), ("APD", "a", "", "", "", True), ("APD", "loose", "", "", "", False), ("APD", "in", "", "", "", False), ("APD", "", "", "", "", False)]),
    ("verifyPDs", '{"RPD":null,"APDs":{"description":"one","evidence_code":"IDA"}}', [("RPD", "", "", "", "", False), ("APD", "one", "", "IDA", "", False)]),
    ("verifyPDs", '{"APDs":{"x":{"description":"u"},"y":"skip","z":{"description":"v","audit_status":"OK"}}}', [("APD", "u", "", "", "", False), ("APD", "v", "", "", "OK", False)]),
    ("verifyPDs", '{"RPD":"text","APDs":"just text"}', [("RPD", "text", "", "", "", False), ("APD", "just text", "", "", "", False)]),
    ("verifyPDs", '{"APDs":""}', []),
    ("verifyPDs", '{"error":"x","RPD":{"description":"r"}}', []),
    ("verifyPDs", '[{"RPD":{}}]', []),
    ("verifyPDs", None, []),
    ("verifyPDs", '{"RPD":{"description":null,"evidence_code":"IMP"},"APDs":[]}', [("RPD", "", "", "IMP", "", True)]),
    ("verifyPDs", '{"APDs":{"verification_status":"FAIL"}}', [("APD", "", "FAIL", "", "", False)]),
    ("selectPD", '{"recommended_product":{"description":"s"}}', [("selected_PD", "s", "", "", "", True)]),
    ("selectPDs", '{"recommended_product":"","selected_PD":"plain"}', [("selected_PD", "plain", "", "", "", False)]),
    ("selectPD", '{"selectedPD":[{"description":"l"}]}', [("selected_PD", "l", "", "", "", False)]),
    ("selectPD", '{"selected_PD":{},"recommended_product":null}', []),
    ("selectPDs", '{"selected_PD":{"description":"s"},"message":"no"}', []),
    ("generatePDs", '{"PDs":[{"description":"g1"},"g2"]}', [("raw_PD", "g1", "", "", "", True), ("raw_PD", "g2", "", "", "", False)]),
    ("generatePDs", '{"PDs":{"description":"g3","evidence_code":"IEA"}}', [("raw_PD", "g3", "", "IEA", "", False)]),
    ("generatePDs", '{"PDs":"x"}', []),
    ("generatePDs", "{broken", []),
]


@query(f"""SELECT event_id, v.* EXCLUDE (k) FROM events JOIN (VALUES {_values([(i, *row) for i, (_, _, rows) in enumerate(DESCRIBED) for row in rows])}) v(k, PD_type, description, verification_status, evidence_code, audit_status, schema_followed) ON v.k = event_id % {len(DESCRIBED)}""")
def apd_polymorphic_flatten(spark, sf_dir):
    d = extraction.description_rows(_results(spark, sf_dir, [c[0] for c in DESCRIBED], [c[1] for c in DESCRIBED]))
    return d.select(F.col("pmid").alias("event_id"), "PD_type", "description", "verification_status", "evidence_code", "audit_status", "schema_followed")


@query(f"""SELECT event_id, v.* EXCLUDE (k), CASE WHEN event_id % 2 = 0 THEN 'Option_2+4_combined' ELSE 'baseline' END AS variation FROM events JOIN (VALUES {_values([(i, *row[:2]) for i, (_, _, rows) in enumerate(DESCRIBED) for row in rows])}) v(k, PD_type, description) ON v.k = event_id % {len(DESCRIBED)} WHERE event_id % 3 = 0""")
def extraction_of_subset(spark, sf_dir):
    r = _results(spark, sf_dir, [c[0] for c in DESCRIBED], [c[1] for c in DESCRIBED])
    r = r.withColumn("stage", F.concat("stage", F.when(F.col("pmid") % 2 == 0, "_Option_2+4_combined").otherwise("")))
    d = extraction.description_rows(r, r.filter("pmid % 3 = 0").select("pmid"), with_variation=True)
    return d.select(F.col("pmid").alias("event_id"), "PD_type", "description", "variation")


@query(f"""SELECT event_id, v.* EXCLUDE (k) FROM events JOIN (VALUES {_values([(i, *row[1:4]) for i, (_, _, rows) in enumerate(DESCRIBED) for row in rows if row[0] == "RPD"])}) v(k, description, verification_status, evidence_code) ON v.k = event_id % {len(DESCRIBED)}""")
def row_core(spark, sf_dir):
    d = extraction.description_rows(_results(spark, sf_dir, [c[0] for c in DESCRIBED], [c[1] for c in DESCRIBED])).filter("PD_type = 'RPD'")
    return d.select(F.col("pmid").alias("event_id"), "description", "verification_status", "evidence_code")


#: (stage, data, bullets it gives as (text, place, quotes, status, reason, schema followed))
BULLETS = [
    ("getGeneSummary", '{"GeneSummary":[{"bullet_point":"p","evidence_location":"L","supporting_quotes":["q1","q2"]},{"bullet_point":"q"}]}', [("p", "L", "q1;;;;;q2", "", "", True), ("q", "", "", "", "", True)]),
    ("getGeneSummary", '{"GeneSummary":{"bullet_point":"single","supporting_quotes":["q"]}}', [("single", "", "q", "", "", False)]),
    ("getGeneSummary", '{"GeneSummary":"text"}', []),
    ("getGeneSummary", '{"GeneSummary":[],"n":1}', []),
    ("getGeneSummary", '{"GeneSummary":[{"bullet_point":"p"}],"error":null}', []),
    ("getGeneSummary", None, []),
    ("verifyGeneSummary", '{"VerifiedSummary":[{"bullet_point":"v","verification_status":"PASS","reason":"ok"}]}', [("v", "", "", "PASS", "ok", True)]),
    ("verifyGeneSummary", '[{"bullet_point":"bare","verification_status":"FAIL"}]', [("bare", "", "", "FAIL", "", True)]),
    ("verifyGeneSummary", '{"bullet_point":"own","reason":"r"}', [("own", "", "", "", "r", False)]),
    ("verifyGeneSummary", '{"VerifiedSummary":{"bullet_point":"w"}}', [("w", "", "", "", "", False)]),
    ("other", '{"GeneSummary":[{"bullet_point":"p"}]}', []),
]


@query(f"""SELECT event_id, v.* EXCLUDE (k) FROM events JOIN (VALUES {_values([(i, *row) for i, (_, _, rows) in enumerate(BULLETS) for row in rows])}) v(k, bullet_point, evidence_location, supporting_quotes, verification_status, reason, schema_followed) ON v.k = event_id % {len(BULLETS)}""")
def bullets_flatten(spark, sf_dir):
    d = extraction.bullet_rows(_results(spark, sf_dir, [c[0] for c in BULLETS], [c[1] for c in BULLETS]))
    return d.select(F.col("pmid").alias("event_id"), *extraction.BULLET_FIELDS, "schema_followed")


@query("""WITH i AS (SELECT user_id, d, CASE event_id % 3 WHEN 0 THEN 'IDA' WHEN 1 THEN 'IMP' ELSE '' END AS e, event_id FROM (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN upper(event_type) || ' ' WHEN 2 THEN NULL ELSE event_type || CAST(event_id % 4 AS VARCHAR) END AS d FROM events) WHERE trim(coalesce(d, '')) <> ''),
k AS (SELECT user_id, arg_min(d, event_id) AS d, arg_min(e, event_id) AS e, min(event_id) AS o FROM i GROUP BY user_id, lower(trim(d))) SELECT user_id, string_agg(d || '/' || e, '|' ORDER BY o) AS kept FROM k GROUP BY 1""")
def candidate_normaliser(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.expr("case event_id % 5 when 0 then ' ' when 1 then concat(upper(event_type), ' ') when 2 then null else concat(event_type, event_id % 4) end"))
    # the same fields under the keys they come with
    item = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("d").alias("description"), F.lit("IDA").alias("evidence_code")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.lit("").alias("description"), F.col("d").alias("Description"), F.lit("IMP").alias("evidenceCode")))).otherwise(F.to_json(F.struct("d").withField("description", F.col("d")).dropFields("d")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("j")))), lambda x: x["j"])
    docs = e.groupBy("user_id").agg(F.concat(F.lit('{"PDs":['), F.array_join(items, ","), F.lit(',"text",null]}')).alias("raw"))
    kept = extraction.generated_candidates(F.try_parse_json("raw"))
    return docs.select("user_id", F.array_join(F.transform(kept, lambda x: F.concat(x["description"], F.lit("/"), x["evidence_code"])), "|").alias("kept")).filter("kept <> ''")


#: (a verification, the candidates it gives)
VERIFIED = [
    ('{"RPD":{"description":"R","reason":"because"},"APDs":[{"Description":"a","evidence":"IDA"},{"description":" r "},{"description":""}]}', "R//because|a/IDA/"),
    ('{"APDs":{"description":"one","evidence_code":"IMP","code_reason":"c"}}', "one/IMP/c"),
    ('{"RPD":"text","APDs":"text","PDs":[{"description":"p"},{"description":"P "}]}', "p//"),
    ('{"RPD":{"description":"r"},"PDs":[{"description":"p"}]}', "r//"),
    ('{"RPD":{"description":5}}', ""),
    ("[]", ""),
    (None, ""),
]


@query(f"""SELECT event_id, v.kept FROM events JOIN (VALUES {_values([(i, kept) for i, (_, kept) in enumerate(VERIFIED)])}) v(k, kept) ON v.k = event_id % {len(VERIFIED)}""")
def verified_candidates(spark, sf_dir):
    kept = extraction.verified_candidates(F.try_parse_json(_pick([v for v, _ in VERIFIED])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(kept, lambda x: F.concat_ws("/", x["description"], x["evidence_code"], x["code_reason"])), "|").alias("kept"))


#: (a verified summary, a summary, the text of both)
SUMMARIES = [
    ('{"VerifiedSummary":[{"bullet_point":"a","verification_status":"PASS"},{"bullet_point":"b","verification_status":"FAIL"},{"bullet_point":"c"}]}', '{"GeneSummary":[{"bullet_point":"s"}],"AdditionalInferences":["x"]}', "- a\n- c"),
    ('{"VerifiedSummary":[{"bullet_point":"b","verification_status":"FAIL"}]}', '{"GeneSummary":[{"bullet_point":"s"},{"bullet_point":""},"t"],"AdditionalInferences":["x","",null,"y"]}', "- s\nAdditional inferences:\n- x\n- y"),
    ('{"VerifiedSummary":[{"bullet_point":"b","verification_status":"fail"}]}', None, "- b"),
    (None, '{"GeneSummary":[{"bullet_point":"s"}],"AdditionalInferences":[]}', "- s"),
    ('{"VerifiedSummary":{}}', '{"GeneSummary":{},"AdditionalInferences":["x"]}', "Additional inferences:\n- x"),
    (None, None, ""),
]


@query(f"""SELECT event_id, v.summary FROM events JOIN (VALUES {_values([(i, s) for i, (_, _, s) in enumerate(SUMMARIES)])}) v(k, summary) ON v.k = event_id % {len(SUMMARIES)}""")
def extended_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", extraction.summary_text(_pick([a for a, _, _ in SUMMARIES]), _pick([b for _, b, _ in SUMMARIES])).alias("summary"))


COLLECTED = [('{"GeneSummary":[{"bullet_point":"a"},{"other":1},"text",{"bullet_point":"b"}]}', "a|b"), ('{"GeneSummary":[]}', ""), ('{"other":[{"bullet_point":"a"}]}', ""), ("[]", ""), (None, "")]


@query(f"""SELECT event_id, v.bullets FROM events JOIN (VALUES {_values([(i, b) for i, (_, b) in enumerate(COLLECTED)])}) v(k, bullets) ON v.k = event_id % {len(COLLECTED)}""")
def collected_bullets(spark, sf_dir):
    held = extraction.collected_bullets(F.try_parse_json(_pick([s for s, _ in COLLECTED])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(held, "|").alias("bullets"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) AS score, CASE WHEN event_id % 2 = 0 THEN '["a",1]' ELSE '{"k":null}' END AS reasons, CASE WHEN event_id % 3 = 0 THEN event_type END AS verdict FROM events""")
def evaluation_row(spark, sf_dir):
    n = F.col("event_id").cast("string")
    answer = F.concat(F.lit('{"score":'), n, F.lit(',"reasons":'), F.when(F.col("event_id") % 2 == 0, '["a",1]').otherwise('{"k":null}'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"verdict":"'), "event_type", F.lit('"'))).otherwise(',"verdict":null'), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", *evaluations.evaluation_columns(F.try_parse_json(answer), ["score", "reasons", "verdict"]))


#: (a verification, status and description of its RPD)
RPDS = [('{"RPD":{"verification_status":"pass","description":"d"}}', "PASS", "d"), ('{"RPD":{"description":"d"}}', "", "d"), ('{"RPD":"x"}', "", ""), ("{}", "", ""), (None, "", ""), ('{"RPD":{"verification_status":null}}', "NONE", "")]


@query(f"""SELECT event_id, v.* EXCLUDE (k) FROM events JOIN (VALUES {_values([(i, *r[1:]) for i, r in enumerate(RPDS)])}) v(k, rpd_status, rpd_description) ON v.k = event_id % {len(RPDS)}""")
def rpd_status(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *extraction.rpd_status(_pick([r[0] for r in RPDS])))


@query(f"""WITH {PAIRS}, d AS (SELECT DISTINCT pmid, gene_id, lower(database) AS database FROM pairs) SELECT pmid, count(*) AS n, string_agg(CAST(gene_id AS VARCHAR) || ':' || database, ',' ORDER BY gene_id, database) AS genes FROM d GROUP BY 1""")
def pairs_of_paper(spark, sf_dir):
    d = extraction.pairs_per_paper(pairs(spark, sf_dir))
    return d.select("pmid", F.size("genes").cast("long").alias("n"), F.array_join(F.transform("genes", lambda g: F.concat_ws(":", g["gene_id"].cast("string"), g["database"])), ",").alias("genes"))


@query("""WITH c AS (SELECT event_id, user_id, event_type, CASE event_id % 4 WHEN 0 THEN '17' WHEN 1 THEN ' 18.0' WHEN 2 THEN 'x1' END AS p FROM events), k AS (SELECT *, regexp_replace(trim(p), '\.0$', '') AS pmid FROM c),
g AS (SELECT user_id AS gene_id, pmid, string_agg(DISTINCT CAST(event_id AS VARCHAR), ';' ORDER BY CAST(event_id AS VARCHAR)) AS comment_ids, min(event_type) AS database FROM k WHERE regexp_matches(pmid, '^[0-9]+$') GROUP BY 1, 2)
SELECT g.*, (SELECT count(*) FROM k WHERE NOT coalesce(regexp_matches(pmid, '^[0-9]+$'), FALSE)) AS dropped FROM g""")
def priority_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pmid = F.expr("case event_id % 4 when 0 then '17' when 1 then ' 18.0' when 2 then 'x1' end")
    good, dropped = extraction.priority_pairs(e.select(F.col("event_id").alias("comment_id"), F.col("user_id").alias("gene_id"), pmid.alias("pmid"), F.col("event_type").alias("database")))
    return good.withColumn("_k", F.lit(1)).join(F.broadcast(dropped.withColumn("_k", F.lit(1))), "_k").drop("_k")


MODELS = ["m2", "m0"]


@query("""WITH r AS (SELECT event_id, user_id AS gene_id, event_type AS pmid, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, event_id % 4 AS c FROM events),
l AS (SELECT pmid, gene_id, model, max(event_id) AS e FROM r GROUP BY ALL), x AS (SELECT pmid, gene_id, e, CASE model WHEN 'm2' THEN 1 ELSE 2 END AS o, e % 4 AS c FROM l WHERE model IN ('m2', 'm0') AND e % 4 <> 2),
y AS (SELECT pmid, gene_id, o, CASE c WHEN 0 THEN 'saved' WHEN 1 THEN 'repaired' END AS origin, e FROM x WHERE c IN (0, 1) UNION ALL SELECT pmid, gene_id, 3, 'legacy', 0 FROM l WHERE gene_id % 2 = 0 GROUP BY ALL)
SELECT pmid, gene_id, arg_min(origin, o) AS origin, arg_min(e, o) AS n FROM y GROUP BY 1, 2""")
def existing_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pmid"), F.col("user_id").alias("gene_id"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model")).agg(F.max("event_id").alias("e"))
    case, n = F.col("e") % 4, F.col("e").cast("string")
    data = F.when(case == 0, F.concat(F.lit('{"n":'), n, F.lit("}"))).when(case == 1, F.to_json(F.struct(F.concat(F.lit('text {"n":'), n, F.lit(',"cut":[1')).alias("raw_response")))).when(case == 2, F.concat(F.lit('{"n":'), n, F.lit(',"error":"x"}'))).otherwise(F.lit('{"raw_response":" "}'))
    r = e.select("pmid", "gene_id", "model", F.lit("getGeneSummary").alias("stage"), case.isin(0, 2).alias("success"), data.alias("data"))
    legacy = e.filter("gene_id % 2 = 0").select("pmid", "gene_id", F.lit('{"n":0}').alias("data")).distinct()
    d = extraction.existing_summary(r, MODELS, legacy)
    return d.select("pmid", "gene_id", "origin", F.get_json_object("data", "$.n").cast("long").alias("n"))


@query("""SELECT c_custkey AS gene_id, n_name AS database, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment || ',' || c_name ELSE '' END AS aliases, CASE WHEN c_custkey % 3 = 0 THEN 'live' ELSE 'saved' END AS source,
CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def alias_override(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    live = c.select(F.col("c_custkey").alias("gene_id"), F.col("n_name").alias("database"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).when(F.col("c_custkey") % 3 == 1, F.array().cast("array<string>")).alias("aliases"))
    saved = c.filter("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("gene_id"), F.array("c_mktsegment", "c_name").alias("aliases"))
    return extraction.override_aliases(live, saved).withColumn("aliases", F.array_join("aliases", ","))


@query("""SELECT event_id, event_id % 4 IN (0, 1) AS family FROM events""")
def model_family(spark, sf_dir):
    key = _pick(["anthropic/Claude-Sonnet-4.5", "claude-sonnet-4-5-20250929", "claude-sonnet-4", None])
    return table(spark, sf_dir, "events").select("event_id", extraction.is_model_family(key, "sonnet-4.5", "sonnet-4-5").alias("family"))


MADE_UP = json.dumps({"assessment_possible": False, "assessment_limitations": evaluations.MADE_UP_TEXT} | dict.fromkeys(evaluations.MADE_UP_SCORES, 0))
#: (a saved evaluation, why it does not count, whether it succeeded)
PAYLOADS = [
    ('{"success":true,"raw_response":"{\\"a\\":1}","parsed":{"a":1},"seconds":1.5}', None, True),
    ('{"success":true,"raw_response":" { ","seconds":2}', "truncated_raw_response:'{'", True),
    ('{"success":false,"error":"bad","evaluation":{"raw_response":"x","parsed":{"a":1}}}', None, False),
    ('{"success":true,"evaluation":{"raw_response":"["}}', "truncated_raw_response:'['", True),
    ('{"success":true,"raw_response":5}', "truncated_raw_response:''", True),
    (json.dumps({"success": True, "raw_response": "words", "evaluation": json.loads(MADE_UP)}), "known_fake_no_data_formatter_payload", True),
    (json.dumps({"success": True, "raw_response": "words", "parsed": json.loads(MADE_UP) | {"short_vs_headline_score": 1}}), None, True),
    (json.dumps({"success": False, "raw_response": "words", "parsed": json.loads(MADE_UP)}), "known_fake_no_data_formatter_payload", False),
    ('{"raw_response":"words","parsed":{"assessment_possible":true}}', None, None),
    ('"no object"', None, None),
]
EVAL = "evaluateComment"


def _evaluations(spark, sf_dir):
    """One result per event whose data hold one evaluation, under the event's number."""
    data = F.concat(F.lit('{"comment_results":{"c'), F.col("event_id").cast("string"), F.lit('":'), _pick([p[0] for p in PAYLOADS]), F.lit("}}"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") % 50).cast("string").alias("pmid"), F.lit(EVAL).alias("stage"), F.col("user_id").cast("string").alias("gene_id"), F.lit("m1").alias("model"), F.lit(True).alias("success"), data.alias("data"), F.lit("{}").alias("usage"), F.lit(0.0).alias("seconds"))


@query(f"""SELECT 'c' || CAST(event_id AS VARCHAR) AS comment_id, CAST(event_id % 50 AS VARCHAR) AS pmid, CAST(user_id AS VARCHAR) AS gene_id, 'would_patch' AS action, v.reason FROM events JOIN (VALUES {_values([(i, r) for i, (_, r, _) in enumerate(PAYLOADS) if r])}) v(k, reason) ON v.k = event_id % {len(PAYLOADS)}""")
def invalid_evaluations(spark, sf_dir):
    return evaluations.invalid_report(_evaluations(spark, sf_dir), EVAL).select("comment_id", "pmid", "gene_id", "action", "reason")


@query(f"""SELECT 'c' || CAST(event_id AS VARCHAR) AS comment_id, CAST(event_id % 50 AS VARCHAR) AS pmid, CAST(user_id AS VARCHAR) AS gene_id, CASE event_id % {len(PAYLOADS)} WHEN 2 THEN 'bad' END AS error FROM events JOIN (VALUES {_values([(i,) for i, p in enumerate(PAYLOADS) if p[2] is False])}) v(k) ON v.k = event_id % {len(PAYLOADS)} WHERE event_id % 3 <> 0""")
def failed_evaluations(spark, sf_dir):
    ids = F.when(F.col("event_id") % 3 == 0, F.concat("pmid", F.lit(",7"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" , "), "pmid")).otherwise(F.col("pmid"))
    e = _evaluations(spark, sf_dir)
    comments = e.select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment_id"), "gene_id", ids.alias("pubmed_ids"))
    return evaluations.failed_evaluations(comments, evaluations.saved_evaluations(e, EVAL)).select("comment_id", "pmid", "gene_id", "error")


@query(f"""WITH c AS (SELECT event_id, user_id, event_id % {len(PAYLOADS)} AS k FROM events) SELECT 'c' || CAST(c.event_id AS VARCHAR) AS comment_id, CASE WHEN v.reason IS NOT NULL THEN FALSE ELSE v.ok END AS succeeded,
CASE WHEN v.reason IS NOT NULL THEN 'Legacy invalid STEP 4 evaluation (' || v.reason || ')' WHEN c.k = 2 THEN 'bad' END AS error, CASE WHEN v.reason IS NULL THEN 0 ELSE CASE WHEN c.k = 1 THEN 2.0 ELSE 0 END END::DOUBLE AS seconds
FROM c JOIN (VALUES {_values([(i, r, ok) for i, (_, r, ok) in enumerate(PAYLOADS) if i != 9])}) v(k, reason, ok) ON v.k = c.k""")
def repaired_evaluations(spark, sf_dir):
    r = evaluations.repaired(_evaluations(spark, sf_dir).drop("event_id"), EVAL)
    p = evaluations.comment_payloads(r, EVAL)
    p = p.join(r.select("pmid", "gene_id", "data", F.col("seconds").alias("spent")).withColumn("comment_id", F.get(F.json_object_keys(F.get_json_object("data", "$.comment_results")), F.lit(0))).drop("data"), ["pmid", "gene_id", "comment_id"])
    state = F.when(J.kind(J.field(F.col("payload"), "success")) == "boolean", F.try_variant_get("payload", "$.success", "boolean"))
    return p.select("comment_id", state.alias("succeeded"), F.when(J.kind(J.field(F.col("payload"), "error")) != "null", J.text(J.field(F.col("payload"), "error"))).alias("error"), F.col("spent").alias("seconds"))


@query("""WITH d AS (SELECT p_partkey, lower(p_name) AS x, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' protein' WHEN 2 THEN '' ELSE p_type || ' zz' END) AS y FROM part),
t AS (SELECT *, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM d)
SELECT p_partkey, CASE WHEN y <> '' THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard, CASE WHEN y <> '' THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(b)), 6) END AS prec, CASE WHEN y <> '' THEN CAST(x = y AS DOUBLE) END AS exact_raw,
CASE WHEN y <> '' THEN CASE p_partkey % 4 WHEN 1 THEN 1.0 WHEN 3 THEN CASE WHEN len(list_intersect(a, b)) = 1 THEN 1.0 ELSE 0.0 END ELSE 0.0 END END::DOUBLE AS one_word FROM t""")
def score_row(spark, sf_dir):
    other = F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, ' protein') when 2 then '' else concat(p_type, ' zz') end")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("gold"), other.alias("cand"), F.array().cast("array<string>").alias("symbols"))
    d = M.score_pairs(p, ["p_partkey"], "gold", ["cand"], "symbols", p, "p_name")
    r = lambda c: F.round(c, 6)
    return d.select("p_partkey", r("SemSim_cand_jaccard").alias("jaccard"), r("SemSim_cand_prec_jaccard").alias("prec"), F.col("cand_Exact_raw").alias("exact_raw"), F.col("cand_OneWord_raw").alias("one_word"))
