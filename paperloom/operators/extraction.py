"""Stage results to tables: descriptions, bullets, candidates for selection, summaries as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import variants as J
from paperloom.operators.status import PD_FIELDS, variation

BULLET_FIELDS = ["bullet_point", "evidence_location", "supporting_quotes", "verification_status", "reason"]
ERROR_KEYS = ("error", "message", "text")


def _flagged(e: Column, followed: Column) -> Column:
    return F.struct(e.alias("e"), followed.alias("schema_followed"))


def _description(e: Column) -> list[Column]:
    """The fields of a description: of an object, of the first element of a list, or the text of a scalar alone."""
    value = F.when(J.kind(e) == "list", F.get(J.elements(e), F.lit(0))).otherwise(e)
    scalar = F.when(J.kind(e).isin("string", "number", "boolean"), J.text(e))
    return [F.when(J.kind(value) == "object", J.text(J.field(value, f))).otherwise(F.coalesce(scalar, F.lit("")) if f == "description" else F.lit("")).alias(f) for f in PD_FIELDS]


def _is_object(e: Column) -> Column:
    return J.kind(e) == "object"


def verified_descriptions(v: Column) -> Column:
    """Array of (PD_type, e, schema_followed) of a verification: the RPD if the key is there, then the APDs, which may be a list, one
    description, an object of descriptions, or a scalar."""
    tagged = lambda kind, items: F.transform(F.coalesce(items, F.array().cast("array<struct<e:variant,schema_followed:boolean>>")), lambda x: F.struct(F.lit(kind).alias("PD_type"), x["e"].alias("e"), x["schema_followed"].alias("schema_followed")))
    rpd, apds = J.field(v, "RPD"), J.field(v, "APDs")
    one = F.when(J.has(v, "RPD"), F.array(_flagged(rpd, _is_object(rpd))))
    no = F.lit(False)
    several = (
        F.when(~J.truthy(apds), None)
        .when(J.kind(apds) == "list", F.transform(J.elements(apds), lambda e: _flagged(e, _is_object(e))))
        .when(J.has(apds, "description", "verification_status"), F.array(_flagged(apds, no)))
        .when(J.kind(apds) == "object", F.transform(F.filter(F.map_values(J.entries(apds)), _is_object), lambda e: _flagged(e, no)))
        .otherwise(F.array(_flagged(apds, no)))
    )
    return F.concat(tagged("RPD", one), tagged("APD", several))


def selected_description(v: Column) -> Column:
    """The same of a selection: the first of its three keys that holds something."""
    picked = J.first_truthy(J.field(v, "recommended_product"), J.field(v, "selected_PD"), J.field(v, "selectedPD"))
    return F.when(picked.isNotNull(), F.array(F.struct(F.lit("selected_PD").alias("PD_type"), picked.alias("e"), _is_object(picked).alias("schema_followed"))))


def raw_descriptions(v: Column) -> Column:
    """The same of generated descriptions: a list, or one description that should have been in one."""
    pds = J.field(v, "PDs")
    row = lambda e, ok: F.struct(F.lit("raw_PD").alias("PD_type"), e.alias("e"), ok.alias("schema_followed"))
    return F.when(J.kind(pds) == "list", F.transform(J.elements(pds), lambda e: row(e, _is_object(e)))).when(_is_object(pds), F.array(row(pds, F.lit(False))))


#: Stages and the descriptions that they hold.
DESCRIPTIONS = {"verifyPDs": verified_descriptions, "selectPD": selected_description, "selectPDs": selected_description, "generatePDs": raw_descriptions}


def _usable(results: DataFrame) -> DataFrame:
    """Successful results with ``_v``, their data as a variant, but for objects that report an error."""
    d = results.filter("success").withColumn("_v", F.try_parse_json("data"))
    return d.filter(~J.has(F.col("_v"), *ERROR_KEYS))


def description_rows(results: DataFrame, subset: DataFrame | None = None, with_variation: bool = False) -> DataFrame:
    """One row per description of results (pmid, stage, gene_id, model, success, data): pmid, gene_id, model, variation where asked
    for, PD_type, the description's fields, schema_followed.

    ``subset`` (pmid) restricts the papers.  With ``with_variation`` a stage may carry a variation behind its name."""
    d = results if subset is None else results.join(subset.select("pmid").distinct(), "pmid", "left_semi")
    name = F.regexp_extract("stage", "^(verifyPDs|selectPDs|selectPD|generatePDs)", 1) if with_variation else F.col("stage")
    d = _usable(d.withColumn("_stage", name).filter(F.col("_stage").isin(list(DESCRIPTIONS))))
    v = F.col("_v")
    rows = F.when(F.col("_stage") == "verifyPDs", F.when(_is_object(v), verified_descriptions(v))).when(F.col("_stage") == "generatePDs", raw_descriptions(v)).otherwise(selected_description(v))
    tag = [variation(F.col("stage")).alias("variation")] if with_variation else []
    d = d.select("pmid", "gene_id", "model", *tag, F.explode(rows).alias("x"))
    keep = ["pmid", "gene_id", "model", *["variation"] * with_variation]
    return d.select(*keep, "x.PD_type", *_description(F.col("x.e")), F.col("x.schema_followed").alias("schema_followed"))


def bullet_rows(results: DataFrame) -> DataFrame:
    """One row per bullet of summaries and verified summaries: pmid, gene_id, model, the bullet's fields, schema_followed.

    A list gives a row per element, a single object one row that is flagged, anything else none.  A verified summary stands at its
    key or is the data itself."""
    d = _usable(results.filter(F.col("stage").isin("getGeneSummary", "verifyGeneSummary")))
    v = F.col("_v")
    checked = F.coalesce(J.first_truthy(J.field(v, "VerifiedSummary")), v)
    body = F.when(F.col("stage") == "getGeneSummary", J.field(v, "GeneSummary")).otherwise(F.when(_is_object(v), checked).otherwise(v))
    d = d.withColumn("_b", body)
    b = F.col("_b")
    each = F.when(J.kind(b) == "list", F.transform(J.elements(b), lambda e: _flagged(e, _is_object(e)))).when(_is_object(b), F.array(_flagged(b, F.lit(False))))
    d = d.select("pmid", "gene_id", "model", F.explode(each).alias("x"))
    e = F.col("x.e")
    quotes = F.array_join(F.transform(F.coalesce(J.elements(J.field(e, "supporting_quotes")), F.array().cast("array<variant>")), J.text), ";;;;;")
    of = lambda f: F.when(_is_object(e), quotes if f == "supporting_quotes" else J.text(J.field(e, f))).otherwise("").alias(f)
    return d.select("pmid", "gene_id", "model", *[of(f) for f in BULLET_FIELDS], F.col("x.schema_followed").alias("schema_followed"))


def collected_bullets(v: Column) -> Column:
    """The bullet texts of a summary (a variant) as an array: of the elements that are objects and have one; empty for anything else."""
    items = F.filter(F.coalesce(J.elements(J.field(v, "GeneSummary")), F.array().cast("array<variant>")), lambda e: J.has(e, "bullet_point"))
    return F.transform(items, lambda e: J.text(J.field(e, "bullet_point")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _candidate(e: Column) -> Column:
    """(description, evidence_code, code_reason) under any of the keys they come with; null without a description in words."""
    pick = lambda *names: J.first_truthy(*[J.field(e, n) for n in names])
    row = lambda said: F.struct(J.text(said).alias("description"), J.text(pick("evidence_code", "evidenceCode", "evidence")).alias("evidence_code"), J.text(pick("code_reason", "reason", "evidence_reason")).alias("code_reason"))
    return F.when(_is_object(e), J.let(pick("description", "Description"), lambda said: F.when((J.kind(said) == "string") & (_strip(J.text(said)) != ""), row(said))))


def distinct_candidates(items: Column) -> Column:
    """Candidates without nulls and without repeats by stripped, lower-cased description; the first stays.  Sorted once, so the work
    stays near the length of the list."""
    keyed = F.array_sort(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x, i: F.struct(F.lower(_strip(x["description"])).alias("k"), i.alias("i"), x.alias("x"))))
    nobody = F.array(F.lit(None)).cast("array<struct<k:string,i:int,x:struct<description:string,evidence_code:string,code_reason:string>>>")
    beside = J.let(keyed, lambda k: F.arrays_zip(k.alias("a"), F.concat(nobody, k).alias("b")))
    firsts = F.filter(beside, lambda z: z["a"].isNotNull() & ~z["a"]["k"].eqNullSafe(z["b"]["k"]))
    return F.transform(F.array_sort(F.transform(firsts, lambda z: F.struct(z["a"]["i"].alias("i"), z["a"]["x"].alias("x")))), lambda y: y["x"])


def generated_candidates(v: Column) -> Column:
    """What a selection may choose from, of generated descriptions (a variant)."""
    items = F.when(_is_object(v), J.elements(J.field(v, "PDs")))
    return distinct_candidates(F.transform(F.coalesce(items, F.array().cast("array<variant>")), _candidate))


def verified_candidates(v: Column) -> Column:
    """The same of a verification: the RPD, then the APDs (a list or one), and the PDs where these give none."""
    none = F.array().cast("array<variant>")
    apds = J.field(v, "APDs")
    own = F.concat(F.array(J.field(v, "RPD")), F.coalesce(J.elements(apds), F.array(apds)))
    own = F.filter(F.transform(F.when(_is_object(v), own).otherwise(none), _candidate), lambda x: x.isNotNull())
    echo = F.transform(F.coalesce(F.when(_is_object(v), J.elements(J.field(v, "PDs"))), none), _candidate)
    return distinct_candidates(J.let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(echo)))


def summary_text(verified: Column, summary: Column) -> Column:
    """A summary as lines, from data as JSON text: the verified bullets that did not fail, if there are any; else all bullets of the
    summary, and its additional inferences below a heading."""
    none = F.array().cast("array<variant>")
    lines = lambda items: F.transform(items, lambda e: F.concat(F.lit("- "), J.text(e)))
    said = lambda e: _is_object(e) & J.truthy(J.field(e, "bullet_point"))
    good = F.filter(F.coalesce(J.elements(J.field(F.try_parse_json(verified), "VerifiedSummary")), none), lambda e: said(e) & (J.text(J.field(e, "verification_status")) != "FAIL"))
    s = F.try_parse_json(summary)
    bullets = F.filter(F.coalesce(J.elements(J.field(s, "GeneSummary")), none), said)
    extra = F.coalesce(J.elements(J.field(s, "AdditionalInferences")), none)
    block = F.when(F.size(extra) > 0, F.concat(F.array(F.lit("Additional inferences:")), lines(F.filter(extra, J.truthy)))).otherwise(F.array().cast("array<string>"))
    of = lambda items: lines(F.transform(items, lambda e: J.field(e, "bullet_point")))
    return F.when(F.size(good) > 0, F.array_join(of(good), "\n")).otherwise(F.array_join(F.concat(of(bullets), block), "\n"))


def rpd_status(data: Column) -> list[Column]:
    """Upper-cased verification status and the description of a verification's RPD, '' where it has none."""
    rpd = J.field(F.try_parse_json(data), "RPD")
    of = lambda f: F.when(_is_object(rpd) & J.has(rpd, f), F.when(J.kind(J.field(rpd, f)) == "null", "None").otherwise(J.text(J.field(rpd, f)))).otherwise("")
    return [F.upper(of("verification_status")).alias("rpd_status"), of("description").alias("rpd_description")]


def existing_summary(results: DataFrame, models: Sequence[str], legacy: DataFrame | None = None, repair=None) -> DataFrame:
    """The saved summary of each pair, by the first model of ``models`` that has one: pmid, gene_id, data, origin.

    A result counts if it succeeded with an object that reports no error; else its ``raw_response`` is repaired (``repair`` maps a
    text column to JSON, by default the repair of cut texts).  Pairs without either take ``legacy`` (pmid, gene_id, data)."""
    from paperloom.functions.llmjson import repair_json

    order = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    v = F.try_parse_json("data")
    d = results.filter((F.col("stage") == "getGeneSummary") & F.col("model").isin(list(models))).withColumn("_o", order).withColumn("_v", v)
    good = F.col("success") & _is_object(F.col("_v")) & ~J.has(F.col("_v"), "error")
    raw = F.try_variant_get("_v", "$.raw_response", "string")  # no lambda may stand around or below what Python computes
    said = (F.schema_of_variant(J.field(F.col("_v"), "raw_response")) == "STRING") & (_strip(raw) != "")
    d = d.withColumn("_raw", F.when(~F.col("success") & said, raw))
    fixed = d.filter("_raw is not null").select("pmid", "gene_id", "_o", (repair or repair_json)(F.col("_raw")).alias("data"), F.lit("repaired").alias("origin"))
    fixed = fixed.filter(F.json_object_keys("data").isNotNull())
    every = d.filter(good).select("pmid", "gene_id", "_o", "data", F.lit("saved").alias("origin")).unionByName(fixed)
    if legacy is not None:
        every = every.unionByName(legacy.filter(J.kind(F.try_parse_json("data")) == "object").select("pmid", "gene_id", F.lit(len(models) + 1).alias("_o"), "data", F.lit("legacy").alias("origin")))
    return every.groupBy("pmid", "gene_id").agg(F.min_by("data", "_o").alias("data"), F.min_by("origin", "_o").alias("origin"))


def pairs_per_paper(pairs: DataFrame) -> DataFrame:
    """Distinct entities of each paper as one list, sorted: pmid, genes (gene_id, database in lower case)."""
    return pairs.groupBy("pmid").agg(F.array_sort(F.collect_set(F.struct("gene_id", F.lower("database").alias("database")))).alias("genes"))


def priority_pairs(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to process first, from comments (comment_id, gene_id, pmid, database): gene_id, pmid, comment_ids, database; and how many
    comments were dropped as their pmid is no number (one row, dropped)."""
    from paperloom.functions.values import clean_pmid

    d = comments.withColumn("pmid", clean_pmid(F.col("pmid")))
    ids = F.array_join(F.array_sort(F.collect_set(F.col("comment_id").cast("string"))), ";")
    good = d.filter("pmid is not null").groupBy("gene_id", "pmid").agg(ids.alias("comment_ids"), F.min("database").alias("database"))
    return good, d.agg(F.count_if(F.col("pmid").isNull()).alias("dropped"))


def is_model_family(model: Column, *spellings: str) -> Column:
    """Whether a model key holds one of the spellings, in any case."""
    low = F.lower(F.coalesce(model, F.lit("")))
    out = F.lit(False)
    for s in spellings:
        out = out | low.contains(s.lower())
    return out


def override_aliases(live: DataFrame, saved: DataFrame) -> DataFrame:
    """Aliases of an entity from the live list (gene_id, database, aliases) or, where that is empty, from the saved one (gene_id,
    aliases): gene_id, database, aliases, source ('live' or 'saved'), n."""
    one = saved.groupBy("gene_id").agg(F.first("aliases").alias("_saved"))
    d = live.join(one, "gene_id", "left").withColumn("_live", F.coalesce(F.size("aliases") > 0, F.lit(False)))
    picked = F.when(F.col("_live"), F.col("aliases")).otherwise(F.coalesce("_saved", F.array().cast("array<string>")))
    return d.select("gene_id", "database", picked.alias("aliases"), F.when(F.col("_live"), "live").otherwise("saved").alias("source"), F.size(picked).alias("n"))
