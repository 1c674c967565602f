"""Saved comment evaluations: look-up, failed ones, invalid ones of older runs and their repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import variants as J

#: Fields of an answer that was made up where there was no data, and what they hold.
MADE_UP_SCORES = [
    "comment_information_density_score",
    "short_vs_headline_score",
    "short_vs_content_score",
    "extended_vs_content_score",
    "pipeline_usefulness_for_submission_score",
    "user_comment_usefulness_for_submission_score",
]
MADE_UP_TEXT = "No data provided to assess"


def comment_payloads(results: DataFrame, stage: str) -> DataFrame:
    """Each saved evaluation of results (pmid, stage, gene_id, model, data): pmid, gene_id, model, comment_id, payload (a variant).

    Payloads that are no objects are left out."""
    held = J.entries(J.field(F.try_parse_json("data"), "comment_results"))
    d = results.filter(F.col("stage") == stage).select("pmid", "gene_id", "model", F.explode(held).alias("comment_id", "payload"))
    return d.filter(J.kind(F.col("payload")) == "object")


def saved_evaluations(results: DataFrame, stage: str, preferred: str | None = None, flexible: bool = True) -> DataFrame:
    """The evaluation that counts for each comment, of the preferred model, else (if ``flexible``) of the first other: pmid, gene_id,
    comment_id, model, succeeded, error, seconds."""
    d = comment_payloads(results, stage)
    if not flexible:
        d = d.filter(F.col("model").eqNullSafe(F.lit(preferred)))
    order = F.struct((~F.col("model").eqNullSafe(F.lit(preferred))).alias("other"), F.col("model"))
    one = d.groupBy("pmid", "gene_id", "comment_id").agg(F.min_by("model", order).alias("model"), F.min_by(F.to_json("payload"), order).alias("_p"))
    p = F.try_parse_json("_p")
    state = F.when(J.kind(J.field(p, "success")) == "boolean", F.try_variant_get(p, "$.success", "boolean"))
    text = lambda f: F.when(J.kind(J.field(p, f)) != "null", J.text(J.field(p, f)))
    return one.select("pmid", "gene_id", "comment_id", "model", state.alias("succeeded"), text("error").alias("error"), F.try_variant_get(p, "$.seconds", "double").alias("seconds"))


def failed_evaluations(comments: DataFrame, saved: DataFrame) -> DataFrame:
    """Comments (comment_id, gene_id, pubmed_ids separated by commas) of a single paper whose saved evaluation failed: comment_id,
    gene_id, pmid, error, seconds."""
    ids = F.filter(F.transform(F.split("pubmed_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    one = comments.withColumn("_ids", ids).filter(F.size("_ids") == 1).select("comment_id", "gene_id", F.get("_ids", F.lit(0)).alias("pmid"))
    return one.join(saved.filter("succeeded = false").select("pmid", "gene_id", "comment_id", "error", "seconds"), ["pmid", "gene_id", "comment_id"]).select("comment_id", "gene_id", "pmid", "error", "seconds")


def evaluation_columns(answer: Column, keys: Sequence[str]) -> list[Column]:
    """The values at ``keys`` of an evaluation (a variant) as columns of text: lists and objects as JSON, null where it has none."""
    value = lambda k: J.field(answer, k)
    return [F.when(J.kind(value(k)) != "null", J.text(value(k))).alias(k) for k in keys]


def raw_response(payload: Column) -> Column:
    """The raw answer of a payload: its own, or its evaluation's; '' where neither is text."""
    own, nested = J.field(payload, "raw_response"), J.field(J.field(payload, "evaluation"), "raw_response")
    return F.when(J.kind(own) == "string", J.text(own)).when(J.kind(nested) == "string", J.text(nested)).otherwise("")


def parsed_answer(payload: Column) -> Column:
    """The parsed answer of a payload: its own, its evaluation's, or the evaluation itself where it is one; null otherwise."""
    own, nested = J.field(payload, "parsed"), J.field(payload, "evaluation")
    inner = J.field(nested, "parsed")
    return F.when(J.kind(own) == "object", own).when(J.kind(inner) == "object", inner).when(J.has(nested, "assessment_possible"), nested)


def made_up(parsed: Column) -> Column:
    """An answer that says there was nothing to assess and scores zero throughout."""
    no = (J.kind(J.field(parsed, "assessment_possible")) == "boolean") & ~F.try_variant_get(parsed, "$.assessment_possible", "boolean")
    says = J.text(J.field(parsed, "assessment_limitations")) == MADE_UP_TEXT
    zero = lambda f: (J.kind(J.field(parsed, f)) == "number") & (F.try_variant_get(parsed, f"$.{f}", "double") == 0)
    out = no & says
    for f in MADE_UP_SCORES:
        out = out & zero(f)
    return F.coalesce(out, F.lit(False))


def invalid_reason(payload: Column) -> Column:
    """Why a saved evaluation does not count, null if it does: its answer is empty or cut off at the first bracket, or made up."""
    short = lambda raw: F.when(raw.isin("", "{", "["), F.concat(F.lit("truncated_raw_response:'"), raw, F.lit("'")))
    cut = J.let(F.regexp_replace(raw_response(payload), r"(?U)^\s+|\s+$", ""), short)
    return F.coalesce(cut, J.let(parsed_answer(payload), lambda a: F.when(made_up(a), "known_fake_no_data_formatter_payload")))


def invalid_report(results: DataFrame, stage: str, dry_run: bool = True) -> DataFrame:
    """Evaluations that do not count: pmid, gene_id, model, comment_id, action, reason."""
    d = comment_payloads(results, stage).withColumn("reason", invalid_reason(F.col("payload"))).filter("reason is not null")
    return d.select("pmid", "gene_id", "model", "comment_id", F.lit("would_patch" if dry_run else "patched").alias("action"), "reason")


def repaired(results: DataFrame, stage: str) -> DataFrame:
    """``results`` (pmid, stage, gene_id, model, success, data, usage, seconds) in which evaluations that do not count are marked failed,
    to be written by the atomic upsert.

    The old evaluation is kept beside, once; a nested evaluation fails too, and keeps an error it has.  Counts and seconds of a changed
    block are taken anew, and the block itself counts as saved.  Other rows pass unchanged."""
    json_map = "map<string,variant>"
    held = J.entries(J.field(F.try_parse_json("data"), "comment_results"))
    d = results.withColumn("_held", F.when(F.col("stage") == stage, held)).withColumn("_bad", F.exists(F.map_values("_held"), lambda p: (J.kind(p) == "object") & invalid_reason(p).isNotNull()))
    quiet = d.filter(~F.coalesce("_bad", F.lit(False))).drop("_held", "_bad")
    json_of = lambda c: F.parse_json(F.to_json(c))

    def mended(p: Column, own: Column, nested: Column, reason: Column) -> Column:
        said = F.concat(F.lit("Legacy invalid STEP 4 evaluation ("), reason, F.lit(")"))
        error = F.try_variant_get(json_of(F.struct(said.alias("x"))), "$.x", "variant")
        no = F.parse_json(F.lit("false"))
        inside = F.map_concat(F.map_filter(J.entries(nested), lambda k, v: (k != "success") & ((k != "error") | J.truthy(v))), F.map_from_arrays(F.array(F.lit("success")), F.array(no)), F.when(J.truthy(J.field(nested, "error")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))).otherwise(F.map_from_arrays(F.array(F.lit("error")), F.array(error))))
        new = F.map_from_arrays(F.array(F.lit("success"), F.lit("error")), F.array(no, error))
        old = F.when(J.has(p, "legacy_invalid_saved_payload"), F.map_filter(own, lambda k, v: k == "legacy_invalid_saved_payload")).otherwise(F.map_from_arrays(F.array(F.lit("legacy_invalid_saved_payload")), F.array(F.coalesce(nested, F.parse_json(F.lit("null"))))))
        rest = F.map_filter(own, lambda k, v: ~k.isin("success", "error", "legacy_invalid_saved_payload", "evaluation"))
        body = F.when(J.kind(nested) == "object", F.map_from_arrays(F.array(F.lit("evaluation")), F.array(json_of(inside)))).otherwise(F.map_filter(own, lambda k, v: k == "evaluation"))
        return json_of(F.map_concat(rest, new, old, body))

    whole = lambda p, r: J.let(J.entries(p), lambda own: J.let(J.field(p, "evaluation"), lambda nested: mended(p, own, nested, r)))
    why = lambda p: F.when(J.kind(p) == "object", invalid_reason(p))
    fix = F.transform_values("_held", lambda k, p: J.let(why(p), lambda r: F.when(r.isNotNull(), whole(p, r)).otherwise(p)))
    m = d.filter("_bad").withColumn("_held", fix)
    items = F.filter(F.map_values("_held"), lambda p: J.kind(p) == "object")
    done = F.size(F.filter(items, lambda p: J.has(p, "success") & F.coalesce(F.try_variant_get(p, "$.success", "boolean"), F.lit(False))))
    spent = F.aggregate(items, F.lit(0.0), lambda s, p: s + F.coalesce(F.try_variant_get(p, "$.seconds", "double"), F.lit(0.0)))
    use = F.to_json(F.struct(F.size(F.map_keys("_held")).alias("comment_count"), done.alias("successful_comment_count"), (F.size(items) - done).alias("failed_comment_count")))
    other = F.map_filter(F.try_variant_get(F.try_parse_json("data"), "$", json_map), lambda k, v: k != "comment_results")
    data = F.to_json(F.map_concat(other, F.map_from_arrays(F.array(F.lit("comment_results")), F.array(json_of(F.col("_held"))))))
    m = m.withColumn("data", data).withColumn("usage", use).withColumn("seconds", F.round(spent, 3)).withColumn("success", F.lit(True))
    return quiet.unionByName(m.select(quiet.columns))
