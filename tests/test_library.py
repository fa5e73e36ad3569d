from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tessera.operators import chunking, library, rounds, structure
from tessera.sources import files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'


def docx(body, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


def p(text, style="", run=""):
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{style}<w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def tc(inner, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"


def test_docx_tables_merged_cells_and_emphasis(spark):
    table = (
        "<w:tbl><w:tr>" + tc(p("wide") + p("second"), '<w:gridSpan w:val="2"/>') + tc(p("tall", run="<w:b/>"), '<w:vMerge w:val="restart"/>') + "</w:tr>"
        + "<w:tr>" + tc(p("a")) + tc(p("b", "H2")) + tc("<w:p/>", "<w:vMerge/>") + "</w:tr></w:tbl>"
    )
    link = "<w:p><w:r><w:t>see</w:t><w:tab/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
    data = docx(p("Top", "H2") + p("not bold", run='<w:b w:val="0"/><w:u w:val="single"/>') + table + link + p("x", run='<w:highlight w:val="yellow"/><w:i/>'))
    rows = spark.createDataFrame([("f/a.docx", data), ("f/b.docx", docx("")), ("f/c.docx", docx(p("One", "Heading1"), None)), ("f/d.docx", b"no zip"), ("f/e.pdf", b"1"), ("f/f.pdf", b"2"), ("f/g.pdf", b"0"), ("f/h.pdf", b"3"), ("f/i.txt", b"")], "path string, content binary")
    pages = {b"1": [("  a b ", None)], b"2": [("a page of words that say enough", None), (None, None)], b"0": [], b"3": [("a page of words that say enough", None)]}
    got = files.parsed(rows, {"pdf": lambda d: pages[bytes(d)]}).collect()
    a = [r for r in got if r["path"] == "f/a.docx"]
    assert [(r["text"], r["style_level"], r["block_type"], r["table_index"], r["row_index"], r["column_index"]) for r in a] == [
        ("Top", 2, "paragraph", None, None, None), ("not bold", None, "paragraph", None, None, None), ("wide\nsecond", None, "table_cell", 0, 0, 0), ("tall", None, "table_cell", 0, 0, 2),
        ("a", None, "table_cell", 0, 1, 0), ("b", 2, "table_cell", 0, 1, 1), ("tall", None, "table_cell", 0, 1, 2), ("see\tlink", None, "paragraph", None, None, None), ("x", None, "paragraph", None, None, None),
    ]
    assert [(r["bold"], r["italic"], r["underline"], r["highlight"]) for r in a] == [(False,) * 4, (False, False, True, False), (False,) * 4, (True, False, False, False), (False,) * 4, (False,) * 4, (True, False, False, False), (False,) * 4, (False, True, False, True)]
    status = {r["path"][2]: (r["status"], r["warning"]) for r in got}
    assert status["a"] == ("ok", None) and status["b"] == ("partial", "no text") and status["d"][0] == "failed" and status["i"][0] == "partial"
    assert (status["e"], status["f"][0], status["g"], status["h"]) == (("needs_ocr", files.NEEDS_OCR), "partial", ("partial", "PDF contains no pages."), ("ok", None))
    assert [r["style_level"] for r in got if r["path"] == "f/c.docx"] == [1]


def test_fallback_only_without_sections_and_document_rows(spark):
    rows = [(1, 0, "Advantage 1: Growth", None), (1, 1, "Growth is low now and that is a sentence.", None), (2, 0, "plain words " * 300, None), (2, 1, "more plain text without any sign of a heading in it at all, really.", None), (3, 0, "  ", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, text string, style_level int")
    got = library.chunked(blocks, chunking.Settings(200, 20)).collect()
    levels = {}
    for r in got:
        levels.setdefault(r["doc_id"], set()).add(r["chunk_level"])
    assert levels == {1: {"argument"}, 2: {"fallback"}} and len({r["chunk_id"] for r in got}) == len(got)
    found = structure.detected(blocks)
    forest = structure.sections(found.where("heading is not null"))
    docs = spark.createDataFrame([(1, "/x/Past Cases/gov brief.docx", "t", None, None), (2, "/x/Personal/Case Notes.md", "u", 2021, "kritik"), (3, "/x/y/MASTER one.docx", None, None, None)], "doc_id long, full_path string, raw_text string, year int, document_type string")
    d = {r["doc_id"]: r for r in library.document_rows(docs, forest, structure.outlines(blocks, found, forest), ("master one",)).collect()}
    assert [(d[k]["source_group"], d[k]["document_type"], d[k]["side"], d[k]["year"], d[k]["title"], d[k]["priority_weight"], d[k]["special_name"]) for k in (1, 2, 3)] == [
        ("past_case", "case", "gov", None, "gov brief", 1.05, None), ("personal", "kritik", "unknown", 2021, "Case Notes", 1.1, None), ("personal", "masterfile", "unknown", None, "MASTER one", 1.15, "MASTER one"),
    ]


def test_groups_listed(spark):
    g = spark.createDataFrame([("dup_b", "near", "c1"), ("dup_a", "exact", "c2"), ("dup_c", "exact", "c1")], "duplicate_group_id string, duplicate_type string, representative_chunk_id string")
    ids = lambda df: [r["duplicate_group_id"] for r in df.collect()]
    assert ids(library.groups_listed(g)) == ["dup_a", "dup_b", "dup_c"]
    assert ids(library.groups_listed(g, "exact")) == ["dup_a", "dup_c"] and ids(library.groups_listed(g, "exact", "c1")) == ["dup_c"]
    assert ids(library.groups_listed(g, limit=1, offset=1)) == ["dup_b"] and ids(library.groups_listed(g, offset=1)) == ["dup_a", "dup_b", "dup_c"]


def test_plans(spark):
    cols = "request_id long, motion string, side string, round_type string, judge string, exclude_theory boolean, exclude_kritiks boolean, include_theory boolean, include_kritiks boolean, desired_top_k int, desired_arguments int, desired_submodules int, profile string, internet boolean"
    rows = [
        (1, "THW act", "gov", None, "flay", True, False, True, None, None, None, None, "general", True), (2, "THR x", None, None, None, True, True, None, None, 8, None, None, "general", False),
        (3, "THBT y", "opp", "fact", None, False, True, True, True, None, 0, 0, "nypdl", None),
    ]
    got = {r["request_id"]: r for r in rounds.planned(spark.createDataFrame(rows, cols)).collect()}
    assert [(got[k]["round_type"], got[k]["include_theory"], got[k]["include_kritiks"], got[k]["desired_arguments"], got[k]["desired_submodules"], got[k]["research_status"], got[k]["problem"]) for k in (1, 2, 3)] == [
        ("policy", True, None, 5, 18, "missing_credentials", None), ("value", False, False, None, None, "disabled_by_prep_rules", None), ("fact", False, False, 0, 0, "disabled_by_prep_rules", "Request at least one argument or submodule."),
    ]
    assert got[1]["notes"] == [rounds.NOTES["policy"], "Explicit include_theory=true overrides the judge's exclusion preference.", rounds.NOTES["prep"]]
    assert got[2]["notes"] == [rounds.NOTES["value"], rounds.NOTES["side"], rounds.NOTES["prep"]] and got[3]["notes"] == [rounds.NOTES["league"], rounds.NOTES["prep"]]
    ready = rounds.planned(spark.createDataFrame(rows, cols), provider=True).where(F.col("request_id") == 1).first()
    assert ready["research_status"] == "ready"
