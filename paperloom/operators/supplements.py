"""Supplement archives: bounded unpacking, text lines by format, mention counts and context blocks."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import batched
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pandas._libs.parsers import STR_NA_VALUES
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import any_term_pattern
from paperloom.functions.values import extension, file_name, stem, truncated
from paperloom.operators.relational import null_safe_join
from paperloom.sources import workbook

#: ``fileno`` is a file's place in its archive; kinds without lines: image, other (not read: unknown, broken or beyond the caps), error.
LINE_SCHEMA = "pmid string, fileno int, file string, kind string, pos int, is_header boolean, line string"
HEADER = "\0"  # marks a reader's header lines
BATCH_LINES = 10_000  # lines that leave Python at once


@dataclass(frozen=True)
class Caps:
    """Bounds on what one archive may hold, and on what a block shows of it."""

    files: int = 200
    file_bytes: int = 25 * 1024 * 1024
    total_bytes: int = 150 * 1024 * 1024
    depth: int = 1
    matches: int = 40
    headers: int = 6
    preview: int = 2
    file_chars: int = 8000
    block_chars: int = 24000


def _decode(raw: bytes) -> str:
    for code in ("utf-8-sig", "utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def _markup(raw: bytes) -> list[str]:
    p = _Text()
    p.feed(_decode(raw))
    return [s for x in p.parts for s in (re.sub(r"\s+", " ", y).strip() for y in x.splitlines()) if s]


def _delimiter(text: str, ext: str) -> str:
    """The delimiter that a look at the text, else the extension, else the first line tells."""
    try:
        return csv.Sniffer().sniff(text[:8192], ",\t;|").delimiter
    except csv.Error:
        first = (text[:8192].splitlines() or [""])[0]
        return {".tsv": "\t", ".tab": "\t", ".csv": ","}.get(ext) or max(",\t;|", key=first.count)


def _even(text: str, sep: str) -> list[list[str]] | None:
    """Cells of a text in which no quote or odd character matters, all names differ and all rows are as long as the header, as pandas
    reads it; None for any other text."""
    if any(c in text for c in '"\r\0\ufeff'):
        return None
    lines = [x for x in text.split("\n") if x]
    rows = [x.split(sep) for x in lines]
    width = len(rows[0]) if rows else 0
    if width < 2 or not all(rows[0]) or len(set(rows[0])) < width or any(len(r) != width for r in rows) or max(map(len, lines)) > csv.field_size_limit():
        return None
    return [rows[0], *(["" if c in STR_NA_VALUES else c for c in r] for r in rows[1:])]


def _delimited(raw: bytes, ext: str) -> list[str]:
    """Columns as a header line, then rows; missing values are blank, rows with too many cells are skipped.  A text that is no table
    gives its lines."""
    text = _decode(raw)
    try:
        sep = _delimiter(text, ext)
        even = _even(text, sep)  # pandas takes a millisecond for a table of any size
        if even:
            return [f"{HEADER}columns: " + " | ".join(even[0]), *map(" | ".join, even[1:])]
        rows = pd.read_csv(io.StringIO(text), sep=sep, dtype=str, engine="python", on_bad_lines="skip").fillna("")
    except (ValueError, csv.Error, pd.errors.ParserError):
        lines = [x for x in text.splitlines() if x.strip()]
        return [f"{HEADER}header: {lines[0]}", *lines[1:]] if lines else []
    return [f"{HEADER}columns: " + " | ".join(map(str, rows.columns)), *(" | ".join(map(str, r)) for r in rows.itertuples(index=False))]


def _docx(raw: bytes) -> list[str]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    rows = {id(p) for t in root.iter(f"{w}tbl") for p in t.iter(f"{w}p")}
    out = ["".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.iter(f"{w}p") if id(p) not in rows]
    out += [" | ".join("".join(t.text or "" for t in c.iter(f"{w}t")).strip() for c in r.iter(f"{w}tc")) for r in root.iter(f"{w}tr")]
    return [x for x in out if x]


def _column(reference: str | None, after: int) -> int:
    """The column number, from 0, of a cell reference such as C5; the next one where there is none."""
    n = 0
    for c in re.match("[A-Za-z]*", reference or "").group().upper():
        n = n * 26 + ord(c) - 64
    return n - 1 if n else after + 1


def _sheet(name: str, rows: list[list[str]]) -> list[str]:
    """A sheet's lines: the first row names the columns."""
    if not rows:
        return [f"{HEADER}[sheet {name}] columns: "]
    width = max(map(len, rows))
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    names = [c or f"Unnamed: {i}" for i, c in enumerate(full[0])]
    return [f"{HEADER}[sheet {name}] columns: " + " | ".join(names), *(f"[{name}] " + " | ".join(r) for r in full[1:])]


def _xlsx(raw: bytes) -> list[str]:
    """All sheets in their order; cells stand in the columns that their references name."""
    s, link = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    headers, out = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        read = lambda n: ElementTree.fromstring(z.read(n)) if n in names else ElementTree.Element("none")
        shared = ["".join(t.text or "" for t in i.iter(f"{s}t")) for i in read("xl/sharedStrings.xml")]
        target = {r.get("Id"): "xl/" + r.get("Target", "").removeprefix("/xl/") for r in read("xl/_rels/workbook.xml.rels")}
        sheets = [(x.get("name"), target.get(x.get(link))) for x in read("xl/workbook.xml").iter(f"{s}sheet")]
        if not sheets:
            sheets = [(n.rsplit("/", 1)[1][:-4], n) for n in sorted(names) if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        for title, part in sheets:
            rows = []
            for row in read(part).iter(f"{s}row"):
                cells, at = {}, -1
                for c in row.iter(f"{s}c"):
                    at = _column(c.get("r"), at)
                    v = c.find(f"{s}v")
                    value = "".join(t.text or "" for t in c.iter(f"{s}t")) if v is None else (v.text or "")
                    cells[at] = shared[int(value)] if c.get("t") == "s" and v is not None else value
                if any(cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            got = _sheet(title, rows)
            headers.append(got[0])
            out += got[1:]
    return headers + out


def _xls(raw: bytes) -> list[str]:
    """Cells of the older workbook format; runs of printable characters of what claims to be one and is not."""
    try:
        got = [_sheet(name, rows) for name, rows in workbook.sheets(raw)]
    except (ValueError, IndexError, struct.error):
        return _printable(raw)
    return [g[0] for g in got] + [line for g in got for line in g[1:]]


def _printable(raw: bytes, least: int = 4) -> list[str]:
    """Runs of printable characters in legacy documents, 16-bit and 8-bit, each once."""
    wide = [m.group().decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e]\x00){%d,}" % least, raw)]
    narrow = [m.group().decode("ascii") for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, raw)]
    return list(dict.fromkeys(x.strip() for x in wide + narrow if x.strip()))


def _pdf(raw: bytes) -> list[str]:
    import pdfplumber  # optional

    out = []
    with pdfplumber.open(io.BytesIO(raw)) as doc:
        for n, page in enumerate(doc.pages, 1):
            out += [f"[p{n}] {x}" for x in (page.extract_text() or "").splitlines() if x.strip()]
            out += [f"[p{n} table] " + " | ".join(c or "" for c in row) for t in page.extract_tables() for row in t]
    return out


def _image(raw: bytes) -> list[str]:
    import pytesseract  # optional
    from PIL import Image

    picture = Image.open(io.BytesIO(raw))
    if min(picture.size) < 300 or picture.size[0] * picture.size[1] > 60_000_000:
        return []
    return [x.strip() for x in pytesseract.image_to_string(picture).splitlines() if x.strip()]


#: How each extension is read, as (kind, reader).
READERS = {
    ".txt": ("text", lambda r: [x.strip() for x in _decode(r).splitlines() if x.strip()]),
    ".csv": ("table", lambda r: _delimited(r, ".csv")), ".tsv": ("table", lambda r: _delimited(r, ".tsv")), ".tab": ("table", lambda r: _delimited(r, ".tab")),
    ".xlsx": ("table", _xlsx), ".docx": ("text", _docx), ".doc": ("text", _printable), ".xls": ("table", _xls),
    ".xml": ("text", _markup), ".html": ("text", _markup), ".htm": ("text", _markup), ".pdf": ("text", _pdf),
}
IMAGES = {".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif"}


def walk(raw: bytes, caps: Caps = Caps()) -> Iterator[tuple[str, bytes | None]]:
    """(name, contents) of the files in an archive, nested ones up to a depth; the name says why where there are no contents.

    A file that cannot be read, or a nested archive that is none, is listed and the walk goes on; beyond the caps on number and
    bytes it ends."""
    left = {"files": caps.files, "bytes": caps.total_bytes}

    def inside(z: zipfile.ZipFile, depth: int):
        for info in z.infolist():
            if left["files"] <= 0 or left["bytes"] <= 0:
                return
            name = info.filename.rsplit("/", 1)[-1]
            if info.is_dir() or not name or info.filename.startswith("__MACOSX/"):
                continue
            left["files"] -= 1
            if info.file_size > caps.file_bytes:
                yield f"{name} (too large, skipped)", None
                continue
            most = min(caps.file_bytes, left["bytes"])
            try:
                with z.open(info) as f:
                    got = f.read(most + 1)  # the declared size may lie
            except Exception:  # encrypted, broken or of an unknown method: foreign files must not end the job  # noqa: BLE001
                yield name, None
                continue
            if len(got) > most:
                yield f"{name} (over size cap)", None
                continue
            left["bytes"] -= len(got)
            if not name.lower().endswith(".zip"):
                yield name, got
            elif depth >= caps.depth:
                yield f"{name} (nested zip, depth limit)", None
            else:
                try:
                    nested = zipfile.ZipFile(io.BytesIO(got))
                except zipfile.BadZipFile:
                    yield name, None
                    continue
                with nested:
                    yield from inside(nested, depth + 1)

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        yield from inside(z, 0)


def files(raw: bytes, caps: Caps = Caps(), ocr: bool = False) -> Iterator[tuple[str, str, list[str]]]:
    """(name, kind, lines) of each file of an archive as it is read, so a caller may stop early."""
    for name, data in walk(raw, caps):
        ext = re.search(r"(\.[^./]*)?$", name.lower()).group() or ""
        kind, reader = READERS.get(ext, ("other", None))
        if ext in IMAGES:
            kind, reader = "image", _image if ocr else None
        if data is None or reader is None:
            yield name, "image" if kind == "image" and data is not None else "other", []
            continue
        try:
            yield name, kind, reader(data)
        except Exception:  # a reader of foreign files must not end the job  # noqa: BLE001
            yield name, "other", []


def records(pmid: str, raw: bytes | None, caps: Caps = Caps(), ocr: bool = False) -> Iterator[tuple]:
    """Rows of ``LINE_SCHEMA`` for one archive; null or broken contents are one row of kind error."""
    try:
        every = list(enumerate(files(raw or b"", caps, ocr)))
    except (zipfile.BadZipFile, ValueError, OSError):
        yield pmid, 0, "", "error", 0, False, "bad archive"
        return
    for n, (name, kind, lines) in every:
        if kind in ("image", "other") and not lines:
            yield pmid, n, name, kind, 0, False, None
        for i, line in enumerate(lines):
            yield pmid, n, name, kind, i, line.startswith(HEADER), line.removeprefix(HEADER)


def archive_lines(archives: DataFrame, caps: Caps = Caps(), ocr: bool = False) -> DataFrame:
    """Lines of archives (pmid, content): one row per line, see ``records``."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, LINE_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for pmid, content in zip(*b.columns, strict=True) for r in records(pmid.as_py(), content.as_py(), caps, ocr))
        for some in batched(rows, BATCH_LINES):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select(F.col("pmid").cast("string"), "content").mapInArrow(run, LINE_SCHEMA)


def _nodes(xml: str | None) -> Iterator[ElementTree.Element]:
    try:
        yield from ElementTree.fromstring(xml or "").iter()
    except ElementTree.ParseError:
        return


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _said(e: ElementTree.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _href(e: ElementTree.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "href"), None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("caption", T.StringType())])))
def _captions(xml: pd.Series) -> pd.Series:
    def of(text):
        out = {}
        for node in _nodes(text):
            if _local(node) != "supplementary-material":
                continue
            file, label, caption = _href(node), "", ""
            for e in node.iter():
                name = _local(e)
                if name == "media":
                    file = file or _href(e)
                elif name == "label":
                    label = label or _said(e)
                elif name == "caption":
                    caption = caption or _said(e)
            if file:
                out[file.rsplit("/", 1)[-1]] = " — ".join(x for x in (label, caption) if x)[:500]
        return [{"file": k, "caption": v} for k, v in out.items()]

    return xml.map(of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _legends(xml: pd.Series) -> pd.Series:
    return xml.map(lambda t: [x for x in (_said(e) for e in _nodes(t) if _local(e) in ("caption", "label", "title")) if x])


def captions(articles: DataFrame) -> DataFrame:
    """Captions of supplementary files in article XML (pmid, xml): pmid, pos, file, caption (label — text, 500 characters).

    Each file takes label and caption from its own node; the last of nodes that name one file counts.  Broken XML has none."""
    d = articles.select("pmid", F.posexplode(_captions("xml")).alias("pos", "x"))
    return d.select("pmid", "pos", "x.file", "x.caption")


def legend_lines(articles: DataFrame) -> DataFrame:
    """Captions, labels and titles of article XML (pmid, xml) as lines of one more file behind an archive's own (``LINE_SCHEMA``)."""
    d = articles.select(F.col("pmid").cast("string").alias("pmid"), F.posexplode(_legends("xml")).alias("pos", "line"))
    return d.select("pmid", F.lit(1 << 30).alias("fileno"), F.lit("[figure/table legends]").alias("file"), F.lit("text").alias("kind"), "pos", F.lit(False).alias("is_header"), "line")


def match_captions(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``files`` (pmid, file) with ``caption``: of the same name, else the first of the same name without extension in any case; ''
    for none."""
    first = lambda by: texts.groupBy("pmid", by).agg(F.min_by("caption", "pos"))
    exact = first(F.col("file").alias("_f")).toDF("pmid", "_f", "_a")
    loose = first(F.lower(stem(F.col("file"))).alias("_s")).toDF("pmid", "_s", "_b")
    d = files.withColumn("_f", file_name(F.col("file"))).withColumn("_s", F.lower(stem(F.col("file"))))
    return d.join(exact.hint("merge"), ["pmid", "_f"], "left").join(loose.hint("merge"), ["pmid", "_s"], "left").withColumn("caption", F.coalesce("_a", "_b", F.lit(""))).drop("_f", "_s", "_a", "_b")


def _patterns(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("_p", any_term_pattern(F.col("terms")))


def mention_counts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Mentions of each pair's terms (pmid, gene_id, terms array) in its paper's files: pmid, gene_id, available (an archive was
    read), found, mentions, files (file, n, in the archive's order).

    The lines of a file are searched as one text, as a name may go on in the next line.  Terms are alternatives of one
    pattern, so overlapping names do not count twice.  Lines are read once, as an archive may stand behind them, and dealt out by
    paper; the optimiser knows nothing of their size, so joins say how they are done."""
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda x: x["line"])
    texts = lines.filter("kind <> 'error'").repartition("pmid").groupBy("pmid", "fileno", "file").agg(F.array_join(held, "\n").alias("_t"))
    hit = _patterns(pairs).join(texts.hint("merge"), "pmid").withColumn("n", F.when(F.col("gene_id").isNotNull(), F.coalesce(F.regexp_count("_t", F.col("_p")), F.lit(0))).cast("long"))
    some = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("fileno", "file", "n"))))
    found = hit.groupBy("pmid", "gene_id").agg(F.sum("n").alias("mentions"), F.transform(some, lambda x: F.struct(x["file"].alias("file"), x["n"].alias("n"))).alias("files"), F.lit(True).alias("available"))
    d = null_safe_join(pairs.select("pmid", "gene_id"), found.hint("merge"), ["pmid", "gene_id"])
    none = F.array().cast("array<struct<file:string,n:bigint>>")
    return d.select("pmid", "gene_id", F.coalesce("available", F.lit(False)).alias("available"), (F.coalesce("mentions", F.lit(0)) > 0).alias("found"), F.coalesce("mentions", F.lit(0).cast("long")).alias("mentions"), F.coalesce("files", none).alias("files"))


def context_blocks(pairs: DataFrame, lines: DataFrame, captions: DataFrame | None = None, caps: Caps = Caps()) -> DataFrame:
    """What a prompt shows of a pair's supplement: pmid, gene_id, block ('' where no file has text).

    ``pairs``: pmid, gene_id, pmcid, aliases, terms.  Per file a line with its name and caption, its first header lines, and the
    lines that mention a term; a text without mention shows its first lines, a table its header alone.  Files follow in
    the archive's order until one would exceed the budget.  Images and files that were not read are counted below."""
    text = Window.partitionBy("pmid", "fileno", "is_header").orderBy("pos")
    numbered = lines.filter("line is not null and kind <> 'error'").repartition("pmid").withColumn("_n", F.row_number().over(text))
    hit = _patterns(pairs.select("pmid", "gene_id", "terms")).drop("terms").join(numbered.hint("merge"), "pmid")
    hit = hit.withColumn("_m", ~F.col("is_header") & F.coalesce(F.regexp_like("line", F.col("_p")), F.lit(False)))
    order = Window.partitionBy("pmid", "gene_id", "fileno", "_m").orderBy("pos")
    hit = hit.withColumn("_rn", F.row_number().over(order))
    hit = hit.filter((F.col("is_header") & (F.col("_n") <= caps.headers)) | (F.col("_m") & (F.col("_rn") <= caps.matches)) | (~F.col("is_header") & (F.col("_n") <= caps.preview)))
    held = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "line")))), lambda x: x["line"])
    part = hit.groupBy("pmid", "gene_id", "fileno", "file", "kind").agg(held(F.col("is_header")).alias("_h"), held(F.col("_m")).alias("_hit"), held(~F.col("is_header") & (F.col("_n") <= caps.preview)).alias("_first"))
    note = F.array(F.lit("(gene not found in this file; first lines:)"))
    body = F.when(F.size("_hit") > 0, F.concat("_h", "_hit")).when((F.col("kind") == "table") | (F.size("_first") == 0), F.col("_h")).otherwise(F.concat("_h", note, "_first"))
    part = part.withColumn("_body", body).filter(F.size("_body") > 0)
    part = part.withColumn("caption", F.lit("")) if captions is None else match_captions(part, captions)
    whole = F.concat(F.lit("["), "file", F.lit("]"), F.when(F.col("caption") != "", F.concat(F.lit(" — "), "caption")).otherwise(""), F.lit("\n"), F.array_join("_body", "\n"))
    part = part.withColumn("_t", truncated(whole, caps.file_chars, " …[truncated]"))
    used = F.sum(F.length("_t")).over(Window.partitionBy("pmid", "gene_id").orderBy("fileno").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("_fits", used <= caps.block_chars)
    block = part.groupBy("pmid", "gene_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("fileno", "_t")))), lambda x: x["_t"]).alias("_blocks"), F.bool_or(~F.col("_fits")).alias("_cut")).filter(F.size("_blocks") > 0)
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "other", F.struct("fileno", "file")))), lambda x: x["file"])
    rest = lines.filter("line is null and kind in ('image', 'other')").groupBy("pmid").agg(F.count_if(F.col("kind") == "image").alias("_images"), others.alias("_others"))
    more = F.size("_others") - 8
    images = F.when(F.col("_images") > 0, F.concat(F.lit("["), F.col("_images").cast("string"), F.lit(" figure/image file(s) present — image extraction deferred]")))
    unread = F.when(F.size("_others") > 0, F.concat(F.lit("["), F.size("_others").cast("string"), F.lit(" non-text file(s) not parsed: "), F.array_join(F.slice("_others", 1, 8), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""), F.lit("]")))
    extras = F.concat_ws("\n", images, unread)
    names = F.array_join(F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 5), ", ")
    head = F.concat(F.lit("=== SUPPLEMENTARY MATERIALS (gene "), "gene_id", F.when(names != "", F.concat(F.lit(" / "), names)).otherwise(""), F.lit("; PMCID "), F.coalesce("pmcid", F.lit("")), F.lit(") ==="))
    tail = F.when(F.col("_cut"), "\n[supplementary truncated: character budget reached]").otherwise("")
    blocks = F.concat("_blocks", F.when(extras != "", F.array(extras)).otherwise(F.array().cast("array<string>")))
    d = pairs.select("pmid", "gene_id", "pmcid", "aliases").join(block.hint("merge"), ["pmid", "gene_id"], "left").join(rest.hint("merge"), "pmid", "left")
    text = F.concat(head, F.lit("\n"), F.array_join(blocks, "\n\n"), tail, F.lit("\n=== END SUPPLEMENTARY MATERIALS ===\n"))
    return d.select("pmid", "gene_id", F.when(F.col("_blocks").isNotNull(), text).otherwise("").alias("block"))


def by_file_type(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Mentions and pairs hit for each extension: ext, mentions, pairs_hit, share in percent."""
    hits = mention_counts(pairs, lines).select("pmid", "gene_id", F.explode("files").alias("f")).select(extension(F.col("f.file")).alias("ext"), "pmid", "gene_id", F.col("f.n").alias("n"))
    by = hits.groupBy("ext").agg(F.sum("n").alias("mentions"), F.countDistinct("pmid", "gene_id").alias("pairs_hit"))
    total = F.sum("mentions").over(Window.partitionBy(F.lit(1)))  # a row per extension: all that precedes is done once
    return by.withColumn("_t", F.greatest(total, F.lit(1))).select("ext", "mentions", "pairs_hit", F.bround(F.lit(100.0) * F.col("mentions") / F.col("_t"), 1).alias("share"))


def attribution(in_legend: str, ocr_files: str, files: str):
    """Where a mention was found: legend before ocr_image before file, '' for nowhere."""
    return F.when(F.coalesce(F.col(in_legend), F.lit(False)), "legend").when(F.size(ocr_files) > 0, "ocr_image").when(F.size(files) > 0, "file").otherwise("")
