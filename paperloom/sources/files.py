"""File sources: delimited tables, status documents, articles, line lists, debug dumps, binaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.values import MISSING, from_millis

ARTICLE = "array<struct<documents:array<struct<passages:array<struct<infons:map<string,string>,text:string>>>>>>"


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """A table with a header and quoted cells that may span lines.

    With a schema columns are typed, else inferred; ids should be given as strings.  ``columns`` prunes at the reader."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select(*columns) if columns else df


def all_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Every column as text, with the usual spellings of a missing value as null."""
    df = delimited(spark, path, strings(columns), sep)
    return df.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in columns])


def status_documents(spark: SparkSession, path: str) -> DataFrame:
    """Status documents of a folder: pmid (file name before the first dot), raw; malformed files are left out."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_f"), F.col("value").alias("raw"))
    return d.filter(F.try_parse_json("raw").isNotNull()).select(F.split_part("_f", F.lit("."), F.lit(1)).alias("pmid"), "raw")


def point_lookup(docs: DataFrame, pmid: str, stage: str, gene: str, model: str) -> DataFrame:
    """The one result of a slot, no row if it is missing."""
    from paperloom.operators.status import explode_status

    return explode_status(docs.filter(F.col("pmid") == pmid)).filter((F.col("stage") == stage) & (F.col("gene_id") == gene) & (F.col("model") == model))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Article JSON files: pmid, passages (section_type, text)."""
    d = spark.read.text(path, wholetext=True).select(F.split_part("_metadata.file_name", F.lit("."), F.lit(1)).alias("pmid"), F.from_json("value", ARTICLE).alias("a"))
    passage = F.flatten(F.transform(F.flatten(F.transform("a", lambda c: c["documents"])), lambda x: x["passages"]))
    return d.select("pmid", F.transform(passage, lambda p: F.struct(F.element_at(p["infons"], "section_type").alias("section_type"), p["text"].alias("text"))).alias("passages"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def debug_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Raw model output kept in dump files: file, content (between the markers 'Original content:' and 'Schema:')."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", r"(?s)Original content:\n(.*?)\n\nSchema:", 1).alias("content")).filter("content <> ''")


def binaries(spark: SparkSession, path: str, largest: int, pattern: str = "*") -> DataFrame:
    """Files up to ``largest`` bytes: path, length, content; the limit is checked before contents are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter(F.col("length") <= largest).select("path", "length", "content")


def comments(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Comment objects, one JSON per line, as flat columns; lists joined by '; ', epoch milliseconds as timestamps."""
    schema = "id string, organism string, primary_id string, pubmed_ids array<string>, related_ids array<string>, headline string, content string, created long"
    d = spark.read.schema(schema).json(path)
    d = d if wanted is None else d.join(wanted.select("id").distinct(), "id", "left_semi")
    join = lambda c: F.array_join(c, "; ")
    return d.select("id", "organism", "primary_id", join("pubmed_ids").alias("pubmed_ids"), join("related_ids").alias("related_ids"), "headline", "content", from_millis(F.col("created")).alias("created"))


#: The columns of a comment table, in order, and where a comment object has them.  A list is joined by '; ', or by what
#: stands behind it.
COMMENT_COLUMNS = {
    "Comment ID": "id",
    "Gene ID": "target.id",
    "Database": "project.name",
    "Organism": "organism",
    "Headline": "headline",
    "Content": "content",
    "Comment Date": "commentDate",
    "Categories": "categories",
    "Author First Name": "author.firstName",
    "Author Last Name": "author.lastName",
    "Author Organization": "author.organization",
    "Author User ID": "author.userId",
    "Review Status": "reviewStatus",
    "Conceptual": "conceptual",
    "PubMed IDs": "pubMedRefs.id",
    "PubMed Titles": "pubMedRefs.title",
    "PubMed Journals": "pubMedRefs.journal",
    "PubMed Authors": "pubMedRefs.author",
    "Related Stable IDs": "relatedStableIds",
    "Digital Object IDs": "digitalObjectIds",
    "Project Name": "project.name",
    "Project Version": "project.version",
    "External Database": "externalDatabase.name",
    "External Database Version": "externalDatabase.version",
    "Location Reverse": "location.reverse",
    "Location Coordinate Type": "location.coordinateType",
    "GenBank Accessions": "genBankAccessions",
    "Target ID": "target.id",
    "Target Type": "target.type",
    "Location Start": "location.ranges.start",
    "Location End": "location.ranges.end",
}
_REF, _NAMED = "array<struct<id:string,title:string,journal:string,author:string>>", "struct<name:string,version:string>"
COMMENT_SCHEMA = f"""id string, organism string, headline string, content string, commentDate long, reviewStatus string, conceptual string,
categories array<string>, relatedStableIds array<string>, digitalObjectIds array<string>, genBankAccessions array<string>, pubMedRefs {_REF},
target struct<id:string,type:string>, project {_NAMED}, externalDatabase {_NAMED}, author struct<firstName:string,lastName:string,organization:string,userId:string>,
location struct<reverse:string,coordinateType:string,ranges:array<struct<start:long,end:long>>>"""


def comment_table(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Comment objects (JSON text) as the columns of ``COMMENT_COLUMNS``: lists joined without blank entries, the first range of a
    location, the date as a timestamp."""
    d = raw.select(F.from_json(text, COMMENT_SCHEMA).alias("c"))

    def cell(name: str, path: str):
        c = F.col(f"c.{path}")
        if path == "commentDate":
            return from_millis(c)
        if path.startswith("location.ranges"):
            return F.get(c, F.lit(0))
        if path.startswith("pubMedRefs") or path in ("categories", "relatedStableIds", "digitalObjectIds", "genBankAccessions"):
            held = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
            return F.array_join(held, "; " if path.count(".") == 0 or path.endswith(".id") else " | ")
        return c

    return d.select(*[cell(n, p).alias(n) for n, p in COMMENT_COLUMNS.items()])


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Call events, one JSON per line: ts, provider, step, model, elapsed, tokens, cost."""
    d = spark.read.schema("ts double, provider string, step string, model string, elapsed_s double, metrics map<string,double>").json(path)
    return d.select("ts", "provider", "step", "model", F.col("elapsed_s").alias("elapsed"), F.element_at("metrics", "total_tokens").cast("long").alias("tokens"), F.element_at("metrics", "cost").alias("cost"))


def eav_table(spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Entity-attribute-value rows over JDBC."""
    return spark.read.jdbc(url, name, properties=properties or {}).select("id", "column", "content")
