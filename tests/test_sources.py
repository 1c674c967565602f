"""Sources, sinks, archives, stages and streams on small fixtures."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import clients, relational, reports, stages, status, supplements
from paperloom.sources import files, remote, sinks, workbook
from paperloom.streaming import resume


def test_delimited(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text('id\ttext\tflag\n"7"\t"two\nlines ""q"""\tTRUE\n8\tNA\t\n')
    df = files.all_strings(spark, str(p), ["id", "text", "flag"], "\t")
    assert [tuple(r) for r in df.collect()] == [("7", 'two\nlines "q"', "TRUE"), ("8", None, None)]
    assert files.delimited(spark, str(p), files.strings(["id", "text", "flag"]), "\t", ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="gone"):
        relational.require_columns(df, ["id", "gone"])


def test_status_folder(spark, tmp_path):
    doc = {"getSummary": {"G1": {"gene_ID": "G-1", "m": {"model": "m", "success": True, "data": {"a": 1}, "seconds": 1.5}}}}
    (tmp_path / "11.json").write_text(json.dumps(doc))
    (tmp_path / "12.json").write_text("{broken")
    d = files.status_documents(spark, str(tmp_path))
    assert [r.pmid for r in d.collect()] == ["11"]
    row = files.point_lookup(d, "11", "getSummary", "G-1", "m").collect()[0]
    assert row.success and json.loads(row.data) == {"a": 1} and row.seconds == 1.5
    assert files.point_lookup(d, "11", "x", "G-1", "m").count() == 0


def test_other_files(spark, tmp_path):
    for n in ("art", "dump", "jsonl", "bin"):
        (tmp_path / n).mkdir()
    art = [{"documents": [{"passages": [{"infons": {"section_type": "results"}, "text": "T"}, {"infons": {"section_type": "REF"}, "text": "no"}]}]}]
    (tmp_path / "art" / "5.json").write_text(json.dumps(art))
    a = files.articles(spark, str(tmp_path / "art"))
    assert a.select("pmid", text.article_text(F.col("passages"))).collect()[0][1] == "T\n"
    (tmp_path / "dump" / "d.txt").write_text('x\nOriginal content:\n{"a":\n1}\n\nSchema:\n{}')
    assert files.debug_dumps(spark, str(tmp_path / "dump")).collect()[0].content == '{"a":\n1}'
    (tmp_path / "jsonl" / "c.json").write_text(json.dumps({"id": "1", "pubmed_ids": ["2", "3"], "created": 1000}) + "\n" + json.dumps({"id": "9"}))
    c = files.comments(spark, str(tmp_path / "jsonl"), spark.createDataFrame([("1",)], "id string")).collect()
    assert len(c) == 1 and c[0].pubmed_ids == "2; 3" and c[0].created.timestamp() == 1.0
    (tmp_path / "jsonl" / "l.json").write_text(json.dumps({"ts": 1, "provider": "p", "step": "s", "model": "m", "elapsed_s": 2.0, "metrics": {"total_tokens": 5, "cost": 0.5}}))
    log = files.call_log(spark, str(tmp_path / "jsonl" / "l.json"))
    assert reports.call_rollup(log).collect()[0].tokens == 5
    (tmp_path / "bin" / "a.zip").write_bytes(b"12345")
    (tmp_path / "bin" / "b.zip").write_bytes(b"1")
    assert files.binaries(spark, str(tmp_path / "bin"), 3).count() == 1


def test_remote_retry_and_kinds(spark):
    waits = []
    answers = iter([remote.Response(503), remote.Response(429, retry_after=7), remote.Response(200, '{"a":1}')])
    assert remote.fetch("k", lambda k: next(answers), sleep=waits.append, jitter=lambda: 0.0) == {"a": 1} and waits == [1.5, 7]
    with pytest.raises(remote.NotAvailable):
        remote.fetch("k", lambda k: remote.Response(200, "<html>"))
    with pytest.raises(remote.FetchFailed):
        remote.fetch("k", lambda k: remote.Response(500), retries=1, sleep=lambda s: None)
    with pytest.raises(remote.Unauthorized):
        remote.fetch("k", lambda k: remote.Response(401))
    keys = spark.createDataFrame([("1",), ("2",), ("1",)], "pmid string")
    got = remote.fetch_all(keys, "pmid", lambda k: remote.Response(200, '{"x":2}') if k == "1" else remote.Response(404))
    assert sorted(tuple(r) for r in got.collect()) == [("1", '{"x": 2}', ""), ("2", None, "not_available")]
    ids = remote.resolve_ids(spark.createDataFrame([("pmc7",), ("5",), ("6",)], "id string"), "id", spark.createDataFrame([("5", "pmc5")], "id string, pmcid string"))
    assert sorted((r.id, r.pmcid) for r in ids.collect()) == [("5", "PMC5"), ("6", None), ("pmc7", "PMC7")]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive():
    doc = zipped({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>para ABC1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>"})
    sheet = zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Genes" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>gene</t></si><si><t>abc-1</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>',
    })
    inner = zipped({"deep.txt": "ABC1 inside\nABC\n1 over two lines\n", "more.zip": zipped({"x.txt": "ABC1"})})
    return zipped({
        "t.csv": "gene;n\nABC1;1\nother;NA\nABC1 ABC1;3\n",
        "u.tsv": "a\tb\nx\ty\nq\tr\ts\nv;w\tNA\n",
        "a.docx": doc,
        "b.xlsx": sheet,
        "n.zip": inner,
        "broken.zip": b"PK no archive",
        "p.html": "<p>ABC1 <b>x</b></p>",
        "old.doc": b"\x00\x01ABC1 word\x01\x01" + "wide text".encode("utf-16-le"),
        "sub/pic.png": b"\x89PNG",
        "notes.txt": "first\nsecond\nthird\n",
        "slides.pptx": b"x",
        "big.txt": "y" * 5000,
    })


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def old_workbook(sheet, strings):
    """A compound file with one sheet of the given records and shared strings, the last of them cut by a continuation."""
    text = lambda s, wide=0: struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")
    whole = b"".join(text(s, int(not s.isascii())) for s in strings[:-1]) + text(strings[-1])
    cut = len(whole) - 3
    sst = record(workbook.SST, struct.pack("<II", len(strings), len(strings)) + whole[:cut]) + record(workbook.CONTINUE, b"\x00" + whole[cut:])
    begin = record(workbook.BOF, b"\0" * 16)
    bound = lambda at: record(workbook.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + b"\x05\x00Genes")
    head = len(begin + bound(0) + sst) + 4
    data = (begin + bound(head) + sst + record(workbook.EOF, b"") + begin + sheet + record(workbook.EOF, b"")).ljust(4096, b"\0")
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + b"\0" * 49 + struct.pack("<II", start, size) + b"\0" * 4
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, *range(3, 10), 0xFFFFFFFE, *[0xFFFFFFFF] * 118)
    header = workbook.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header + fat + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(data))).ljust(512, b"\0") + data


def test_older_workbooks():
    cell = lambda r, c: struct.pack("<HHH", r, c, 0)
    rows = [
        record(workbook.LABELSST, cell(0, 0) + struct.pack("<I", 0)), record(workbook.LABELSST, cell(0, 2) + struct.pack("<I", 1)),
        record(workbook.LABELSST, cell(1, 0) + struct.pack("<I", 2)), record(workbook.NUMBER, cell(1, 1) + struct.pack("<d", 2.5)), record(workbook.RK, cell(1, 2) + struct.pack("<I", 7 << 2 | 2)),
        record(workbook.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, 5 << 2 | 2, 0, 150 << 2 | 3) + struct.pack("<H", 1)),
        record(workbook.FORMULA, cell(2, 2) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8), record(workbook.STRING, struct.pack("<HB", 2, 0) + b"ok"),
        record(workbook.FORMULA, cell(3, 0) + struct.pack("<d", 12.0) + b"\0" * 8), record(workbook.BOOLERR, cell(3, 1) + b"\x01\x00"), record(workbook.LABEL, cell(3, 2) + struct.pack("<HB", 3, 0) + b"old"),
    ]
    raw = old_workbook(b"".join(rows), ["gene", "n\u03b2", "continued text"])
    assert list(workbook.sheets(raw)) == [("Genes", [["gene", "", "n\u03b2"], ["continued text", "2.5", "7"], ["5", "1.5", "ok"], ["12", "True", "old"]])]
    assert supplements._xls(raw)[:2] == ["\0[sheet Genes] columns: gene | Unnamed: 1 | n\u03b2", "[Genes] continued text | 2.5 | 7"]
    assert supplements._xls(b"plain words only") == ["plain words only"] and supplements._xls(raw[:600]) is not None
    assert [f[:2] for f in supplements.files(zipped({"a.xls": raw}))] == [("a.xls", "table")]


def encrypted(raw):
    """The archive with its first file marked as encrypted."""
    raw = bytearray(raw)
    raw[6] |= 1
    raw[raw.index(b"PK\x01\x02") + 8] |= 1
    return bytes(raw)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("1", bytearray(archive())), ("2", bytearray(b"no zip")), ("3", None), ("4", bytearray(encrypted(zipped({"k.txt": "ABC1", "good.txt": "ABC1 here"}))))]
    return supplements.archive_lines(spark.createDataFrame(rows, "pmid string, content binary"), supplements.Caps(file_bytes=4000)).cache()


def test_archive_lines(lines):
    rows = lines.collect()
    kinds = {r.file: r.kind for r in rows if r.pmid == "1"}
    assert kinds == {"t.csv": "table", "u.tsv": "table", "a.docx": "text", "b.xlsx": "table", "deep.txt": "text", "more.zip (nested zip, depth limit)": "other", "broken.zip": "other", "p.html": "text", "old.doc": "text", "pic.png": "image", "notes.txt": "text", "slides.pptx": "other", "big.txt (too large, skipped)": "other"}
    of = lambda f: [r.line for r in rows if r.file == f]
    assert of("t.csv") == ["columns: gene | n", "ABC1 | 1", "other | ", "ABC1 ABC1 | 3"]
    assert of("u.tsv") == ["columns: a | b", "x | y", "v;w | "]
    assert of("a.docx") == ["para ABC1", "c1 | c2"] and of("b.xlsx") == ["[sheet Genes] columns: gene | Unnamed: 1 | n", "[Genes] abc-1 |  | 5"] and of("old.doc") == ["wide text", "ABC1 word"]
    assert [r.is_header for r in rows if r.file == "b.xlsx"] == [True, False]
    assert [(r.pmid, r.kind) for r in rows if r.pmid in "23"] == [("2", "error"), ("3", "error")]
    assert [(r.file, r.kind, r.line) for r in rows if r.pmid == "4"] == [("k.txt", "other", None), ("good.txt", "text", "ABC1 here")]
    assert next(supplements.files(archive()))[0] == "t.csv"  # a caller may stop early
    assert supplements._delimiter("a", ".tab") == "\t" and supplements._delimiter("a|b|c", ".x") == "|"


def test_archive_counts_and_context(spark, lines):
    rows = [("1", "G1", ["ABC1"], ["G1", "ABC1", "x"], "PMC1"), ("1", "G2", [], ["nothing"], "PMC1"), ("9", "G1", [], ["ABC1"], None), ("4", "G1", [], ["G1"], "PMC4")]
    pairs = spark.createDataFrame(rows, "pmid string, gene_id string, aliases array<string>, terms array<string>, pmcid string")
    got = {(r.pmid, r.gene_id): r for r in supplements.mention_counts(pairs, lines).collect()}
    one = got[("1", "G1")]
    assert one.mentions == 8 and one.found and one.available and [f.file for f in one.files] == ["t.csv", "a.docx", "b.xlsx", "deep.txt", "p.html", "old.doc"]
    assert {f.file: f.n for f in one.files}["t.csv"] == 3 and {f.file: f.n for f in one.files}["deep.txt"] == 1
    assert (got[("1", "G2")].mentions, got[("1", "G2")].found, got[("1", "G2")].available) == (0, False, True) and not got[("9", "G1")].available
    articles = spark.createDataFrame([("1", '<a xmlns:x="http://www.w3.org/1999/xlink"><supplementary-material x:href="T.CSV"><label>S1</label></supplementary-material></a>')], "pmid string, xml string")
    block = {(r.pmid, r.gene_id): r.block for r in supplements.context_blocks(pairs, lines, supplements.captions(articles), supplements.Caps(matches=1)).collect()}
    text = block[("1", "G1")]
    assert text.startswith("=== SUPPLEMENTARY MATERIALS (gene G1 / ABC1; PMCID PMC1) ===\n[t.csv] — S1\ncolumns: gene | n\nABC1 | 1\n\n[u.tsv]\ncolumns: a | b\n\n[a.docx]\npara ABC1\n\n")
    assert "[notes.txt]\n(gene not found in this file; first lines:)\nfirst\nsecond\n\n[1 figure/image file(s) present — image extraction deferred]\n[4 non-text file(s) not parsed: more.zip (nested zip, depth limit), broken.zip, slides.pptx, big.txt (too large, skipped)]\n=== END SUPPLEMENTARY MATERIALS ===\n" in text
    assert "ABC1 ABC1" not in text and block[("9", "G1")] == ""
    assert "[t.csv] — S1\ncolumns: gene | n\n\n" in block[("1", "G2")]  # a table without mention shows its header alone
    small = {(r.pmid, r.gene_id): r.block for r in supplements.context_blocks(pairs, lines, caps=supplements.Caps(block_chars=40, file_chars=20)).collect()}
    assert small[("1", "G1")].split("\n", 1)[1].startswith("[t.csv]\ncolumns: gen …[truncated]\n") and "[supplementary truncated: character budget reached]" in small[("1", "G1")]
    shares = {r.ext: r.mentions for r in supplements.by_file_type(pairs, lines).collect()}
    assert shares[".csv"] == 3 and shares[".txt"] == 1


def test_captions(spark):
    link = 'xmlns:xlink="http://www.w3.org/1999/xlink"'
    xml = f"""<article {link}><fig><label>Fig 1</label><caption><title>A title</title></caption></fig><supplementary-material><media xlink:href="A.pdf"/></supplementary-material>
<supplementary-material><label>S2</label><caption><p>two <i>parts</i></p><p>more</p></caption><media xlink:href="dir/B.PDF"/></supplementary-material></article>"""
    d = spark.createDataFrame([("1", xml), ("2", "<broken"), ("3", None)], "pmid string, xml string")
    c = supplements.captions(d)
    assert sorted((r.pmid, r.file, r.caption) for r in c.collect()) == [("1", "A.pdf", ""), ("1", "B.PDF", "S2 — two partsmore")]
    f = spark.createDataFrame([("1", "dir/B.PDF"), ("1", "b.docx"), ("1", "z.txt")], "pmid string, file string")
    assert {r.file: r.caption for r in supplements.match_captions(f, c.unionByName(c)).collect()} == {"dir/B.PDF": "S2 — two partsmore", "b.docx": "S2 — two partsmore", "z.txt": ""}
    assert supplements.match_captions(f, c.unionByName(c)).count() == 3
    assert [r.line for r in supplements.legend_lines(d).collect()] == ["Fig 1", "A title", "A title", "S2", "two partsmore"]


def test_stages(spark):
    pairs = spark.createDataFrame([("1", f"G{i}") for i in range(6)] + [("2", "G9")], "pmid string, gene_id string")
    papers = spark.createDataFrame([("1", "text one"), ("2", "text two")], "pmid string, text string")
    calls = {"summary": F.concat("text", "gene_id"), "describe": F.concat(F.lit("d"), "gene_id")}
    out = stages.curate(pairs, papers, calls, done=spark.createDataFrame([("2", "G9")], "pmid string, gene_id string"))
    rows = out.collect()
    assert {r.pmid for r in rows} == {"1"} and all(r.success for r in rows)
    first = {r.gene_id for r in rows if r.stage == "summary" and '"only_in_passing":false' in r.data}
    assert {r.gene_id for r in rows if r.stage == "describe"} == first
    broken = stages.run_stage(pairs, stages.Stage("s", F.col("gene_id"), retries=1), lambda s, p, m: ("no json", {}, 1.0))
    assert {(r.success, r.error, r.seconds) for r in broken.collect()} == {(False, "json parsing failed after retries", 2.0)}
    assert stages.parse_answer('{"a": [1', None) == '{"a":[1]}' and stages.parse_answer("", lambda t: "{}") is None and stages.parse_answer("x", lambda t: '{"k":1}') == '{"k":1}'
    once = stages.run_distinct(spark.createDataFrame([("aa",), ("aa",), (None,)], "t string"), "t", "n", lambda s: s.str.len(), "long")
    assert sorted(r.n or 0 for r in once.collect()) == [0, 2, 2]


def leaf(n):
    return json.dumps({"success": True, "data": {"n": n}})


def test_upsert_and_stream(spark, tmp_path):
    kind = "pmid string, stage string, gene_id string, model string, leaf string"
    store = str(tmp_path / "store")
    sinks.upsert_status(spark, store, spark.createDataFrame([("1", "s", "g", "m", leaf(1)), ("1", "s", "h", "m", leaf(2))], kind), 0)
    docs = sinks.upsert_status(spark, store, spark.createDataFrame([("1", "s", "g", "m", leaf(3))], kind), 1)
    got = {r.gene_id: json.loads(r.data)["n"] for r in status.explode_status(docs).collect()}
    assert got == {"g": 3, "h": 2}
    assert sinks.compact_status(spark, store, 2) == 2
    assert sorted((r.gene_id, json.loads(r.leaf)["data"]["n"], r.version) for r in sinks.latest_status(spark, store).collect()) == [("g", 3, 2), ("h", 2, 2)]
    with pytest.raises(ValueError, match="above"):
        sinks.compact_status(spark, store, 2)
    (tmp_path / "in").mkdir()
    rows = [{"pmid": "1", "stage": "s", "gene_id": "g", "model": "m", "leaf": leaf(n)} for n in (5, 6)]
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(r))
        resume.upsert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [json.loads(r.leaf)["data"]["n"] for r in sinks.latest_status(spark, str(tmp_path / "out")).collect()] == [6]


def test_calls_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls = [("2026-01-01T00:01:00", "a"), ("2026-01-01T00:02:00", "a"), ("2026-01-01T05:00:00", "b")]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"ts": t, "step": s, "elapsed": 1.0}) for t, s in calls))
    resume.calls_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.step, r.calls) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb", 2)], "id string, t string, n int")
    assert sinks.write_table(df, str(tmp_path / "o"), ["n", "t", "gone"]) and not sinks.write_table(df.limit(0), str(tmp_path / "p"), ["n"])
    assert files.delimited(spark, str(tmp_path / "o"), files.strings(["n", "t"])).collect()[0].t == "a\nb"
    sinks.append_events(df, str(tmp_path / "e"))
    sinks.append_events(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    sinks.write_side_texts(df, str(tmp_path / "s"), "t", "id")
    assert (tmp_path / "s" / "id=1").is_dir()
    both = sinks.before_after(df, df.withColumn("n", F.lit(3)), ["id"]).collect()[0]
    assert (both.before.n, both.after.n) == (2, 3)
    assert reports.text_report(spark.range(7), "t", 5).endswith("(2 more rows)\n")
    assert "title" in reports.text_report(df, "title") and "id" in reports.text_report(df, "title")


def test_comment_tables(spark, tmp_path):
    c = {"id": 5, "organism": "O", "commentDate": 1000, "categories": ["a", None, "b"], "pubMedRefs": [{"id": "1", "title": "x"}, {"id": "2", "title": "y"}], "target": {"id": "G", "type": "gene"}, "location": {"reverse": True, "ranges": [{"start": 3, "end": 9}, {"start": 10}]}, "project": {"name": "P", "version": 6}}
    d = files.comment_table(spark.createDataFrame([(json.dumps(c),), ("{}",)], "raw string"))
    r = d.head()
    assert len(d.columns) == 31 and (r["Comment ID"], r["PubMed IDs"], r["PubMed Titles"], r["Categories"], r["Location Start"], r["Location End"], r["Gene ID"], r["Project Version"]) == ("5", "1; 2", "x | y", "a; b", 3, 9, "G", "6")
    assert r["Comment Date"].timestamp() == 1.0 and d.collect()[1]["PubMed IDs"] == ""


def test_tables_by_key_with_progress(spark, tmp_path):
    seen, folder = str(tmp_path / "asked"), str(tmp_path / "f")

    def backend(key):
        with open(seen, "a") as f:
            f.write(key + "\n")
        return {"a": remote.Response(200, "h1\th2\n1\t2\n3\t4\n"), "b": remote.Response(200, "h1\th2\n"), "c": remote.Response(422, "unknown"), "d": remote.Response(500, "later")}[key]

    keys = spark.createDataFrame([(k,) for k in "abcd"], "organism string")
    for _ in range(2):
        got = remote.fetch_tables(spark, keys, "organism", backend, folder)
    assert sorted((r.organism, r.line) for r in got.collect()) == [("a", "1\t2"), ("a", "3\t4")]
    assert sorted(open(seen).read().split()) == ["a", "b", "c", "d", "d"]
    log = spark.read.parquet(f"{folder}/log")
    assert sorted((r.key, r.code, r.detail) for r in log.filter("code <> 200").collect()) == [("c", 422, "unknown"), ("d", 500, "later"), ("d", 500, "later")]


def test_aliases_of_a_service(spark):
    def backend(gene, path):
        if gene == "G2":
            raise OSError("down")
        return remote.Response(200, json.dumps({"attributes": {"name": "nm"}, "tables": {"Alias": [{"alias": "z"}, {"alias": gene}, {"alias": "b"}, {"alias": "z"}]}})) if path == "p1" else remote.Response(500)

    genes = spark.createDataFrame([("G1", " DB1 "), ("G2", "db1"), ("G3", "db2"), ("G4", "other"), ("G5", None)], "gene_id string, database string")
    got = {r.gene_id: r.aliases for r in remote.fetch_aliases(genes, backend, {"db1": "p1", "db2": "p2"}).collect()}
    assert got == {"G1": ["b", "nm", "z"], "G2": [], "G3": [], "G4": [], "G5": []}


class Service:
    """A batch service that ends at the second look."""

    def __init__(self):
        self.looks = 0

    def submit(self, requests):
        self.requests = requests
        return "b1"

    def state(self, batch):
        self.looks += 1
        return "ended" if self.looks > 1 else "in_progress"

    def answers(self, batch):
        for r in self.requests:
            yield (r["custom_id"], None, "errored") if r["prompt"] == "bad" else (r["custom_id"], '{"p": "' + r["prompt"] + '"}', None)


def refused():
    raise OSError("no batches")


def test_batches_and_their_fallback(spark):
    pairs = spark.createDataFrame([("1", "G_1", "x"), ("1", "G_1", "x"), ("2", "G2", "bad")], "pmid string, gene_id string, prompt string")
    stage = stages.Stage("getGeneSummary", F.col("prompt"))
    got = {(r.pmid, r.gene_id): r for r in stages.run_batch(pairs, stage, Service, sleep=lambda s: None).collect()}
    assert got[("1", "G_1")].data == '{"p":"x"}' and len(got) == 2 and (got[("2", "G2")].success, got[("2", "G2")].error) == (False, "errored")
    plain = stages.run_batch(pairs, stage, refused).collect()
    assert len(plain) == 2 and all(r.success and "digest" in r.data for r in plain)


def test_client_settings():
    assert clients.timeout(env={"OPENAI_HTTP_TIMEOUT": "7"}) == 7 and clients.timeout(env={"OPENAI_HTTP_TIMEOUT": "x"}) == 180
    assert clients.takes_responses("gpt-5-mini") and not clients.takes_temperature("gpt-5") and clients.takes_temperature("gpt-4.1")
    assert clients.omits_sampling("anthropic/claude-opus-4.7") and not clients.omits_sampling("claude-sonnet-4-5") and not clients.omits_sampling(None)
    assert clients.caches_prompts("claude-x") and not clients.caches_prompts("gpt") and clients.takes_schema("openrouter", "claude-Sonnet-4-5") and not clients.takes_schema("other", "sonnet-4-5")
    assert clients.schema_format("n", {"a": 1})["json_schema"] == {"name": "n", "strict": True, "schema": {"a": 1}}
    assert clients.as_list(None) == [] and clients.as_list("x") == ["x"] and clients.as_list(("a", "b")) == ["a", "b"]
    blocks = clients.input_blocks([{"content": "t"}, {"role": "r", "content": [{"type": "text", "text": "u"}, {"type": "image_url", "image_url": {"url": "v"}}, {"type": "x"}]}, {"content": 5}])
    assert blocks == [{"role": "user", "content": [{"type": "input_text", "text": "t"}]}, {"role": "r", "content": [{"type": "input_text", "text": "u"}, {"type": "input_image", "image_url": "v"}]}, {"role": "user", "content": [{"type": "input_text", "text": "5"}]}]
    assert clients.RunConfig().max_retry == 5


def test_entity_attribute_rows_over_jdbc(spark):
    url, driver = "jdbc:derby:memory:paperloom;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(1, 1, "G1"), (1, 4, "abc"), (1, 4, "xyz"), (2, 1, "G2"), (2, 5, "no")], "id int, `column` int, content string")
    try:
        rows.write.jdbc(url, "records", mode="overwrite", properties=driver)
    except Exception as e:  # the embedded database may be missing  # noqa: BLE001
        pytest.skip(str(e)[:80])
    got = relational.eav_aliases(files.eav_table(spark, url, "records", driver)).collect()
    assert [(r.name, r.aliases) for r in got] == [("G1", ["abc", "xyz"])]
