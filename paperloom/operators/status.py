"""Nested status documents: stage -> entity -> model -> result, and the tables they flatten to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import variants as J

MAPS = "map<string,map<string,map<string,string>>>"
PD_FIELDS = ["description", "verification_status", "evidence_code", "code_reason", "audit_status", "audit_reason"]
#: Stage key fragments and the variation they tell, in order of test.
VARIATIONS = [
    "Option_1_baseline",
    "Option_2_verify_summary",
    "Option_3_verify_pds",
    "Option_4_select_pd",
    "Option_2+3_combined",
    "Option_2+4_combined",
]


def explode_status(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Results of documents (pmid, JSON text): pmid, stage, gene_id, model, success, data, usage, seconds; bad JSON yields none.

    The entity id is the sibling ``gene_ID`` where there is one, else the key."""
    d = docs.select("pmid", F.from_json(raw, MAPS).alias("_m")).select("pmid", F.explode("_m").alias("stage", "_g"))
    d = d.select("pmid", "stage", F.explode("_g").alias("_key", "_models"))
    d = d.select("pmid", "stage", F.coalesce(F.element_at("_models", "gene_ID"), F.col("_key")).alias("gene_id"), F.explode("_models").alias("model", "_leaf")).filter("model <> 'gene_ID'")
    leaf = F.from_json("_leaf", "success boolean, data string, usage string, seconds double, error string")
    d = d.select("pmid", "stage", "gene_id", "model", leaf.alias("_l"))
    return d.select("pmid", "stage", "gene_id", "model", F.coalesce("_l.success", F.lit(False)).alias("success"), "_l.data", "_l.usage", "_l.seconds", "_l.error")


def build_status(rows: DataFrame) -> DataFrame:
    """The inverse: one document per pmid from (pmid, stage, gene_id, model, leaf JSON text).  Leaves are parsed once; the levels above
    are put together as text.  A document holds all results of its paper."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)

    def level(d: DataFrame, keys: Sequence[str], name: str, body: Column) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.concat(quoted(F.col(name)), F.lit(":"), body).alias("j"))))
        return d.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("}")).alias("_j"))

    d = level(rows, ["pmid", "stage", "gene_id"], "model", F.coalesce(F.to_json(F.try_parse_json("leaf")), F.lit("null")))
    d = level(d, ["pmid", "stage"], "gene_id", F.col("_j"))
    return level(d, ["pmid"], "stage", F.col("_j")).select("pmid", F.col("_j").alias("raw"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Union in which the highest version of a key stays, new rows before old ones of the same version."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return every.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def is_ok(success: Column, data: Column) -> Column:
    """Succeeded with an object that has no key ``error``."""
    keys = F.json_object_keys(data)
    return F.coalesce(success & keys.isNotNull() & ~F.array_contains(keys, "error"), F.lit(False))


def has_error(data: Column) -> Column:
    """An object with a key error, message or text, whatever the value."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(data), F.array(F.lit("error"), F.lit("message"), F.lit("text"))), F.lit(False))


def variation(stage: Column) -> Column:
    """The first of ``VARIATIONS`` that a stage key holds; baseline for none."""
    out = F.lit("baseline")
    for v in reversed(VARIATIONS):
        out = F.when(F.contains(stage, F.lit(v)), v).otherwise(out)
    return out


def step_log(results: DataFrame, keys: Sequence[str], stages: Sequence[str], any_model: Sequence[str], model: str) -> DataFrame:
    """Per key a flag for each stage: done by any model for stages in ``any_model``, by ``model`` for the others."""
    ok = lambda s: F.bool_or((F.col("stage") == s) & F.col("success") & (F.lit(True) if s in any_model else F.col("model") == model))
    return results.groupBy(*keys).agg(*[ok(s).alias(s) for s in stages])


def completeness(results: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """keys, flex (each stage done by some model), strict (one model did all stages)."""
    done = results.filter("success").filter(F.col("stage").isin(list(stages)))
    per_model = done.groupBy(*keys, "model").agg(F.countDistinct("stage").alias("_n"))
    strict = per_model.groupBy(*keys).agg((F.max("_n") == len(stages)).alias("strict"))
    flex = done.groupBy(*keys).agg((F.countDistinct("stage") == len(stages)).alias("flex"))
    out = results.select(*keys).distinct().join(flex, list(keys), "left").join(strict, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("flex", "strict")})


def first_success(results: DataFrame, keys: Sequence[str], position: str, preferred: str) -> DataFrame:
    """The preferred model's successful result, else the first successful one: keys, model, data."""
    good = results.filter("success").withColumn("_r", F.struct((F.col("model") != preferred).alias("a"), F.col(position).alias("b")))
    return good.groupBy(*keys).agg(F.min_by("model", "_r").alias("model"), F.min_by("data", "_r").alias("data"))


#: What an error of a blocked answer says.
BLOCKED = ["content_filter", "refus", "json parsing failed after retries"]


def guardrail(raw: Column, tokens: Column, error: Column) -> Column:
    """Whether an answer was blocked: it is there but empty, has at most two tokens, or an error says so.  A missing answer alone
    is not blocked."""
    e = F.lower(F.coalesce(error, F.lit("")))
    out = F.coalesce(raw == "", F.lit(False)) | F.coalesce(tokens <= 2, F.lit(False))
    for said in BLOCKED:
        out = out | e.contains(said)
    return out


def guardrail_signature(raw: Column, tokens: Column, error: Column) -> Column:
    """How it was blocked, the first sign that applies."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e.contains("content_filter"), "content_filter").when(raw == "", "empty_response").when(tokens <= 2, "zero_output_tokens").when(e.contains("json parsing failed after retries"), "parse_fail_after_retries").otherwise("other")


def stage_states(results: DataFrame, keys: Sequence[str], order: str = "model") -> DataFrame:
    """State of each stage of each key from results (stage, success, data, usage, error): keys, stage, state, in_passing.

    'success' if some result succeeded with data, else 'guardrail' if some failed one was blocked, else 'fail' if some failed; null
    if none did either.  ``in_passing`` is what the first success by ``order`` says."""
    v = F.try_parse_json("data")
    of = lambda path: F.try_variant_get(v, path, "string")
    use = F.try_parse_json("usage")
    tokens = F.coalesce(F.try_variant_get(use, "$.completion_tokens", "long"), F.try_variant_get(use, "$.output_tokens", "long"), F.try_variant_get(use, "$.output", "long"))
    error = F.concat_ws(" ", of("$.error"), F.col("error"))
    good = F.col("success") & J.truthy(v)
    failed = F.coalesce(~F.col("success"), F.lit(False))
    passing = F.when(good, F.coalesce(of("$.only_in_passing") == "true", F.lit(False)))
    d = results.withColumns({"_good": F.coalesce(good, F.lit(False)), "_failed": failed, "_hit": failed & guardrail(of("$.raw_response"), tokens, error), "_pass": passing})
    state = F.when(F.bool_or("_good"), "success").when(F.bool_or("_hit"), "guardrail").when(F.bool_or("_failed"), "fail")
    return d.groupBy(*keys, "stage").agg(state.alias("state"), F.coalesce(F.min_by("_pass", F.when(F.col("_good"), F.col(order))), F.lit(False)).alias("in_passing"))


def pair_outcome(summary: Column, generated: Column, verified: Column, in_passing: Column) -> tuple[Column, Column]:
    """Outcome of a pair from the states of its three stages, and the step that failed ('' for none)."""
    is_ = lambda c, state: F.coalesce(c == state, F.lit(False))
    done = is_(summary, "success")
    outcome = (
        F.when(is_(verified, "success"), "completed")
        .when(is_(generated, "success"), "pds_no_verify")
        .when(done & F.coalesce(in_passing, F.lit(False)), "in_passing")
        .when(is_(generated, "guardrail") & done | is_(summary, "guardrail"), "guardrail_failed")
        .when(is_(generated, "fail") & done | is_(summary, "fail"), "other_failed")
        .when(done, "summary_only")
        .otherwise("not_processed")
    )
    step = F.when(outcome.isin("guardrail_failed", "other_failed"), F.when(done, "generatePDs").otherwise("getGeneSummary")).otherwise("")
    return outcome, step


def pair_outcomes(results: DataFrame, keys: Sequence[str], stages: Sequence[str] = ("getGeneSummary", "generatePDs", "verifyPDs"), order: str = "model") -> DataFrame:
    """keys, outcome, step for each key with results; ``stages`` names summary, generation and verification."""
    states = stage_states(results.filter(F.col("stage").isin(list(stages))), keys, order)
    of = lambda s: F.max(F.when(F.col("stage") == s, F.col("state")))
    d = states.groupBy(*keys).agg(*[of(s).alias(f"_{i}") for i, s in enumerate(stages)], F.bool_or(F.when(F.col("stage") == stages[0], F.col("in_passing"))).alias("_p"))
    d = results.select(*keys).distinct().join(d, list(keys), "left")
    outcome, step = pair_outcome(F.col("_0"), F.col("_1"), F.col("_2"), F.col("_p"))
    return d.select(*keys, outcome.alias("outcome"), step.alias("step"))


def changed(before: Column, after: Column) -> Column:
    return F.trim(F.coalesce(before, F.lit(""))) != F.trim(F.coalesce(after, F.lit("")))


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named by their path; arrays of scalars joined by '; ', arrays of structs as JSON with a count beside."""
    from pyspark.sql import types as T

    def walk(path: list[str], kind: T.DataType):
        c = F.col(".".join(f"`{p}`" for p in path))
        name = sep.join(path)
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk([*path, f.name], f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield (F.to_json(c) if isinstance(kind.elementType, T.StructType) else F.array_join(c.cast("array<string>"), "; ")).alias(name)
            if isinstance(kind.elementType, T.StructType):
                yield F.size(c).alias(f"{name}{sep}count")
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema.fields for x in walk([f.name], f.dataType)])
