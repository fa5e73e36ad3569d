"""Files as rows: discovery with an audit of what is left out, text with encoding fallback, DOCX blocks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Readable extensions, folders passed over, and folder names that tell a source.
EXTENSIONS = ("doc", "docx", "md", "pdf", "txt")
IGNORED = ("__pycache__", "node_modules")
GROUPS = (("other", "other non personal research"), ("past_case", "past previous"), ("personal", "personal"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, length, modified, status): every file below root; status ok, or why it is left out.

    Reasons go in this order: hidden, lock_file, ignored_folder, unsupported.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    parts = F.split(relative, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    status = F.when(F.exists(parts, lambda p: p.startswith(".")), "hidden").when(name.startswith("~$"), "lock_file").when(F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))), "ignored_folder").when(~ext.isin(*EXTENSIONS), "unsupported").otherwise("ok")
    return files.select("path", relative.alias("relative"), "length", F.col("modificationTime").alias("modified"), status.alias("status"))


def source_group(folders: Column) -> Column:
    """The nearest folder that names a group decides; none: other. folders: outermost first."""
    norm = F.transform(F.reverse(folders), lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))
    told = F.transform(norm, lambda p: F.coalesce(F.when(p.startswith("non personal") | p.startswith("other"), "other"), F.when(p.startswith("past"), "past_case"), F.when(p.startswith("personal"), "personal")))
    return F.coalesce(F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), F.lit("other"))


def decode(data: bytes | None) -> tuple[str | None, str, str | None]:
    """(text, status, warning) of a text file: UTF-8 with or without a mark, else Windows-1252."""
    if data is None:
        return None, "failed", "no content"
    if b"\0" in data:
        return None, "failed", "binary content"
    try:
        text, warning = data.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        text, warning = data.decode("cp1252", "replace"), "decoded as windows-1252"
    return text, "ok" if text.strip() else "partial", warning


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Words that fewer visible characters than this on all pages of a PDF hide in pictures.
SCANNED = 20
NEEDS_OCR = "PDF has pages but almost no extractable text; it is likely scanned or image-only and requires OCR."


def _said(p: ElementTree.Element) -> str:
    """A paragraph's text: runs, also within links, with their tabs and line breaks."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for r in p.iter(f"{W}r") for x in r)


def _on(run: ElementTree.Element, name: str) -> bool:
    """Whether a run's own properties switch an emphasis on."""
    x = run.find(f"{W}rPr/{W}{name}")
    return x is not None and (x.get(f"{W}val") or "true").lower() not in ("0", "false", "off", "none")


def docx_blocks(data: bytes) -> list[dict]:
    """Blocks of a DOCX body in order: paragraphs, and table cells row by row, with style, level and emphasis.

    A cell is one block, its paragraphs on lines of their own. A cell over several columns is given once in a row, at
    its first column; one over several rows once in each.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val") for s in styles.iter(f"{W}style") if s.find(f"{W}name") is not None} if styles is not None else {}
    usual = next((names.get(s.get(f"{W}styleId")) for s in (styles.iter(f"{W}style") if styles is not None else ()) if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true")), None)

    def style_of(p: ElementTree.Element) -> str | None:
        x = p.find(f"{W}pPr/{W}pStyle")
        own = x.get(f"{W}val") if x is not None else None
        return usual if own is None else names.get(own) or re.sub(r"(?<=[a-z])(?=\d)", " ", own)

    def block(ps: list[ElementTree.Element], **place: object) -> dict:
        runs, found = [r for p in ps for r in p.findall(f"{W}r")], {style_of(p) for p in ps} - {None}
        style = found.pop() if len(found) == 1 else None
        level = re.fullmatch(r"(?i)heading\s+(\d+)", (style or "").strip())
        emphasis = {k: any(_on(r, x) for r in runs) for k, x in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("highlight", "highlight"))}
        return {"text": "\n".join(map(_said, ps)), "style_level": int(level[1]) if level else None, "style_name": style, "block_type": "paragraph"} | emphasis | place

    out: list[dict] = []
    table = -1
    for item in body if body is not None else ():
        if item.tag == f"{W}p":
            out.append(block([item]))
        elif item.tag == f"{W}tbl":
            table += 1
            above: dict[int, ElementTree.Element] = {}
            for row, tr in enumerate(item.findall(f"{W}tr")):
                column = 0
                for tc in tr.findall(f"{W}tc"):
                    span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                    goes_on = merge is not None and (merge.get(f"{W}val") or "continue") == "continue"
                    cell = above.get(column, tc) if goes_on else tc
                    out.append(block(cell.findall(f"{W}p"), block_type="table_cell", table_index=table, row_index=row, column_index=column))
                    width = int(span.get(f"{W}val") or 1) if span is not None else 1
                    above |= dict.fromkeys(range(column, column + width), cell)
                    column += width
    return out


def pdf_status(pages: list[str | None]) -> tuple[str, str | None]:
    """(status, warning) of a PDF by its pages' texts; null: the page could not be read."""
    if not pages:
        return "partial", "PDF contains no pages."
    if sum(len(re.sub(r"\s+", "", t or "")) for t in pages) < SCANNED:
        return "needs_ocr", NEEDS_OCR
    lost = [f"Page {k} could not be extracted" for k, t in enumerate(pages, 1) if t is None]
    return ("partial", "; ".join(lost)) if lost else ("ok", None)


BLOCK = {"style_level": "int", "style_name": "string", "block_type": "string", "bold": "boolean", "italic": "boolean", "underline": "boolean", "highlight": "boolean", "table_index": "int", "row_index": "int", "column_index": "int"}


def parsed(files: DataFrame, extra: dict[str, Callable[[bytes], list[tuple[str | None, int | None]]]] | None = None) -> DataFrame:
    """(path, status, warning, pos, text, and BLOCK): blocks of each file of (path, content); a failure is a row.

    extra: readers of further extensions, which give (text, heading level) rows; a pdf reader gives its pages, null
    where one can't be read. Files without a reader are unsupported.
    """
    own = dict(extra or {})

    def one(path: str, data: bytes | None) -> list[dict]:
        row = lambda status, warning=None, pos=-1, **b: {"path": path, "status": status, "warning": warning, "pos": pos} | b
        ext = path.rpartition(".")[2].lower()
        try:
            if ext in ("txt", "md"):
                text, status, warning = decode(data)
                lines = [] if text is None else text.splitlines()
                return [row(status, warning, i, text=t, block_type="line") for i, t in enumerate(lines)] or [row(status, warning)]
            if ext == "docx" and ext not in own:
                blocks = docx_blocks(data or b"")
                empty = not any(b["text"].strip() for b in blocks)
                return [row(*(("partial", "no text") if empty else ("ok", None)), i, **b) for i, b in enumerate(blocks)] or [row("partial", "no text")]
            if ext not in own:
                return [row("unsupported")]
            got = own[ext](data or b"")
            status, warning = pdf_status([t for t, _ in got]) if ext == "pdf" else ("ok", None) if got else ("partial", "no text")
            return [row(status, warning, i, text=t or "", style_level=level, block_type="page" if ext == "pdf" else "paragraph") for i, (t, level) in enumerate(got)] or [row(status, warning)]
        except Exception as e:  # a bad file is a row of its own and stops no other
            return [row("failed", f"{type(e).__name__}: {e}"[:300])]

    columns = {"path": "string", "status": "string", "warning": "string", "pos": "int", "text": "string"} | BLOCK
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c, kinds[t]) for c, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(one(path, data), schema)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns.items()))
