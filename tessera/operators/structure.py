"""Headings in streams of text blocks, sections, and chunks.

Detection is a Column expression per block. The fold over open sections goes through a document's
headings in order; a task streams sorted rows and holds the open sections only. Bodies attach to
the last heading before them by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section types and their labels, in order of precedence.
LABELS = (
    ("counter_interpretation", "counter interpretation|counter-interpretation|counter interp|counter-interp"),
    ("competing_interpretations", "competing interpretations"), ("counter_standards", "counter standards|counter-standards"),
    ("internal_link", "internal links|internal link|il"), ("value_criterion", "value criterion|criterion|vc"),
    ("weighing_mechanism", "weighing mechanism"), ("threshold_of_truth", "threshold of truth"),
    ("role_of_the_ballot", "role of the ballot|rob"), ("drop_the_argument", "drop the argument"), ("drop_the_team", "drop the team"),
    ("theory_shell", "theory shell"), ("advantage", "advantage|ad"), ("disadvantage", "disadvantage|da"), ("contention", "contention"),
    ("uniqueness", "uniqueness|uq"), ("link", "links|link|l"), ("impact", "impacts|impact|impx"), ("harms", "harms|harm"),
    ("solvency", "solvency"), ("inherency", "inherency"), ("counterplan", "counterplan|counter plan|cp"), ("plan", "plan text|plan"),
    ("claim", "claims|claim"), ("warrant", "warrants|warrant"), ("value", "value"), ("problem", "problem"), ("mechanism", "mechanism"),
    ("comparative", "comparative"), ("offense", "offense|offence"), ("defense", "defense|defence"), ("framework", "framework"),
    ("framing", "framing"), ("impact_calculus", "impact calculus"), ("observation", "observation"),
    ("definition", "definitions|definition"), ("interpretation", "interpretation|interp"), ("standards", "standards|standard"),
    ("voters", "voters|voter"), ("violation", "violations|violation"), ("reasonability", "reasonability"),
    ("alternative", "alternative|alt"), ("permutation", "permutation|perm"), ("root_cause", "root cause"), ("thesis", "thesis"),
    ("answer", "responses|response|answers|answer|at|a2"), ("turn", "turns|turn"),
)
CONFIDENCE = {"style": 0.98, "keyword": 0.88, "numbered": 0.80, "formatted": 0.68, "uppercase": 0.62, "colon": 0.58}
MAX_WORDS, MAX_CHARS = 12, 120
CONTAINERS = ("advantage", "disadvantage", "contention", "theory_shell", "kritik")
THEORY_CHILDREN = ("answer", "competing_interpretations", "counter_interpretation", "counter_standards", "drop_the_argument", "drop_the_team", "interpretation", "reasonability", "standards", "violation", "voters", "weighing_mechanism")
KRITIK_CHILDREN = ("alternative", "framework", "impact", "internal_link", "link", "permutation", "role_of_the_ballot", "root_cause", "thesis")
CASE_CHILDREN = ("claim", "comparative", "counterplan", "defense", "framework", "harms", "impact", "inherency", "internal_link", "link", "mechanism", "offense", "plan", "problem", "solvency", "uniqueness", "warrant")
STRONG = ("advantage", "answer", "contention", "disadvantage", "kritik", "theory_shell")
INHERITED = ("alternative", "answer", "claim", "counter_interpretation", "counter_standards", "framework", "framing", "harms", "impact", "impact_calculus", "inherency", "internal_link", "interpretation", "link", "solvency", "standards", "uniqueness", "value", "value_criterion", "voters", "warrant")
OUTLINE = r"^(\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)]\s+(.+)$"


def short(text: Column) -> Column:
    """One line of at most 12 words and 120 characters, and not blank."""
    t = F.trim(text)
    return (t != "") & ~t.contains("\n") & (F.length(t) <= MAX_CHARS) & (F.size(F.split(t, r"\s+")) <= MAX_WORDS)


def outline_depth(label: Column) -> Column:
    return F.when(label == "", None).when(label.rlike(r"^\d+$"), 1).when(label.rlike(r"^[ivxlcdmIVXLCDM]+$"), 3).otherwise(2)


#: Any label, the first of LABELS that fits, with a number, a title and a colon as they may follow.
LABEL = "(?i)^(" + "|".join(a.replace(" ", r"\s+") for _, aliases in LABELS for a in aliases.split("|")) + r")(?:\s*\d+)?(?:\s*[:\-–—]\s*.+?)?\s*:?\s*$"
TYPE_OF = {a: name for name, aliases in reversed(LABELS) for a in reversed(aliases.split("|"))}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once for each row, not again wherever it is named; generated code stays small."""
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def typed(blocks: DataFrame) -> DataFrame:
    """Adds outline_label and kind, the type that a heading's words name or null, to blocks with body."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    out = blocks.withColumn("outline_label", F.regexp_extract("body", OUTLINE, 1))
    out = _once(out, "inner", F.when(F.col("outline_label") != "", F.regexp_extract("body", OUTLINE, 2)).otherwise(F.col("body")))
    inner = F.col("inner")
    kind = F.when(inner.rlike(r"(?i)^(?:at|a2|answer\s+to)(?:\s*[:\-–—]\s*|\s+).+$"), "answer")
    kind = kind.when(inner.rlike(r"(?i)^(?:kritik|k)(?:\s*[:\-–—]\s*.+)?\s*:?\s*$|^.+\s+(?:kritik|k)\s*:?\s*$"), "kritik")
    kind = kind.when(inner.rlike(r"(?i)^.+\s+theory(?:\s+shell)?\s*:?\s*$") & (F.lower(inner) != "theory shell"), "theory_shell")
    out = _once(out, "label", F.lower(F.regexp_extract(inner, LABEL, 1)))
    return _once(out, "kind", kind.otherwise(F.coalesce(F.try_element_at(names, "label"), F.when(F.col("outline_label") != "", "subpoint")))).drop("inner", "label")


def detected(blocks: DataFrame) -> DataFrame:
    """Adds heading, method, detection, confidence, level, section_type and outline to blocks (doc_id, pos, text, style_level).

    Not a heading: null heading. Markdown marks and styles give a level; words or an outline's number give a type;
    emphasis (columns bold, underline, highlight, where there are any), letters in capitals or a closing colon make
    a heading of a short line, the first two only without end punctuation. method is the strongest sign,
    detection all of them, joined by a plus.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    marks = F.regexp_extract(t, r"^(#{1,6})\s+\S", 1)
    plain = F.when(marks != "", F.regexp_replace(t, r"^#{1,6}\s+|\s*#*$", "")).otherwise(t)
    b = _once(blocks, "body", F.regexp_replace(plain, r"\s+", " ")).withColumn("level", F.coalesce("style_level", F.when(marks != "", F.length(marks))).cast("int"))
    b = b.withColumn("_style", F.when(F.col("style_level").isNotNull(), "docx_heading_style").when(marks != "", "markdown_heading"))
    # only short lines are looked at further
    b = typed(_once(b, "body", F.when(short(F.col("body")), F.col("body"))))
    body, kind = F.col("body"), F.col("kind")
    ended = body.rlike(r"[.!?;]\z")
    capitals = body.rlike(r"\p{Lu}") & ~body.rlike(r"\p{Ll}")
    stressed = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("bold", "underline", "highlight") if c in blocks.columns] or [F.lit(None).cast("string")]))
    keyword, numbered = kind.isNotNull() & (kind != "subpoint"), F.col("outline_label") != ""
    method = F.when(body.isNull(), None).when(F.col("level").isNotNull(), "style").when(keyword, "keyword").when(numbered, "numbered").when((F.size(stressed) > 0) & ~ended, "formatted").when(capitals & ~ended, "uppercase").when(body.endswith(":"), "colon")
    b = _once(b, "method", method).withColumn("outline", F.when(kind.isNotNull(), outline_depth(F.col("outline_label"))).cast("int"))
    found = F.col("method")
    single = F.when(found == "formatted", F.concat(F.lit("formatted_short_line:"), F.array_join(stressed, "+"))).when(found == "uppercase", "uppercase_short_line").when(found == "colon", "short_colon_line")
    detection = F.coalesce(single, F.array_join(F.array_compact(F.array("_style", F.when(keyword, "debate_keyword"), F.when(kind.isNotNull() & numbered, "numbering"))), "+"))
    confidence = F.coalesce(*[F.when(found == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    is_heading = found.isNotNull()
    return b.select(*blocks.columns, F.when(is_heading, body).alias("heading"), "method", F.when(is_heading, detection).alias("detection"), confidence.alias("confidence"), "level", F.when(is_heading, F.coalesce("kind", F.lit("heading"))).alias("section_type"), "outline")


def wanted_parent(kind: str, open_sections: list[dict]) -> int | None:
    """Place among the open sections of the nearest container that takes a kind as its child; a kind of theory belongs to theory alone."""
    if kind in THEORY_CHILDREN:
        takers: tuple[str, ...] = ("theory_shell",)
    elif kind in KRITIK_CHILDREN or kind in CASE_CHILDREN:
        takers = ("kritik", "advantage", "disadvantage", "contention")
    else:
        return None
    return next((at for at in range(len(open_sections) - 1, -1, -1) if open_sections[at]["kind"] in takers), None)


def wanted_level(kind: str, style: int | None, outline: int | None, stack: list[dict]) -> tuple[int, int | None]:
    """(level, place of the parent that its type asks for, if any) of a heading under the open sections.

    An outline's number counts from the innermost open section that is no subpoint; then the container that the type
    belongs to, then a stated level, then one below an open typed section, else the top.
    """
    if outline is not None:
        return next((s["level"] for s in reversed(stack) if s["kind"] != "subpoint"), 0) + outline, None
    if (at := wanted_parent(kind, stack)) is not None:
        return stack[at]["level"] + 1, at
    if style is not None:
        return style, None
    if kind == "heading" and stack and stack[-1]["kind"] != "heading":
        return stack[-1]["level"] + 1, len(stack) - 1
    return 1, None


FOREST = ("section_id", "string"), ("parent_id", "string"), ("level", "int"), ("wanted", "int"), ("path", "array<string>")


def sections(headings: DataFrame) -> DataFrame:
    """(doc_id, pos, section_id, parent_id, level, wanted, path, section_type, heading): the section forest.

    headings: detected() rows with a heading. The rows of a document come in order through one task,
    which holds the sections open at that point. No level is skipped below an open section: wanted is
    the level that the heading asked for, level what it got. A heading with nothing above it keeps its level as a root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, n, stack = None, 0, []
        for b in batches:
            out: list[list] = [[] for _ in FOREST]
            for did, style, kind, outline in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 5)), strict=True):
                if did != doc:
                    doc, n, stack = did, 0, []
                n += 1
                want, at = wanted_level(kind, style, outline, stack)
                if at is not None:
                    del stack[at + 1 :]
                while stack and stack[-1]["level"] >= want:
                    stack.pop()
                level = min(want, stack[-1]["level"] + 1) if stack else want
                sid = f"{did}:section:{n:04d}"
                parent = stack[-1]["id"] if stack else None
                stack.append({"id": sid, "level": level, "kind": kind})
                for o, x in zip(out, (sid, parent, level, want, [s["id"] for s in stack]), strict=True):
                    o.append(x)
            cols = [pa.array(o, t) for o, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, b.column(3), b.column(4)], ["doc_id", "pos", *[c for c, _ in FOREST], "section_type", "heading"])

    kind = headings.schema["doc_id"].dataType.simpleString()
    ordered = headings.repartition("doc_id").sortWithinPartitions("doc_id", "pos").select("doc_id", F.col("pos").cast("int").alias("pos"), "level", "section_type", "heading", "outline")
    return ordered.mapInArrow(run, f"doc_id {kind}, pos int, {', '.join(f'{c} {t}' for c, t in FOREST)}, section_type string, heading string")


def outlines(blocks: DataFrame, found: DataFrame, forest: DataFrame, stem: Column | None = None) -> DataFrame:
    """(doc_id, title, sections, orphans, confidence, remarks): one row for each document of blocks.

    found: detected() rows of the blocks. The title is the first heading of style level 1 or with Markdown marks, else stem (of the document's columns
    in blocks; null without). orphans counts blocks with text before the first section; confidence is the mean over
    sections. remarks, in order: levels that were skipped, roots that begin below the top, orphans, no section at all.
    """
    kept = found.where("heading is not null")
    marked = (F.col("level") == 1) & (F.col("style_level").isNotNull() | F.col("detection").startswith("markdown")) | F.col("detection").startswith("markdown_heading")
    title = F.min_by(F.regexp_replace("heading", r":+$", ""), F.when(marked, F.col("pos")))
    heads = kept.groupBy("doc_id").agg(F.when(F.max(marked), title).alias("title"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("sections"), F.min("pos").alias("_first"))
    below = forest.where("wanted > level or parent_id is null and level > 1")
    jump = F.when(F.col("parent_id").isNotNull(), F.format_string("Heading at source block %d jumped from level %d to %d; normalized to level %d.", F.col("pos"), F.col("level") - 1, F.col("wanted"), F.col("level")))
    said = F.coalesce(jump, F.format_string("Heading at source block %d begins at level %d without a detected parent; preserved as a root.", F.col("pos"), F.col("level")))
    jumps = below.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("_jumps"))
    docs = blocks.groupBy("doc_id").agg((F.min(stem) if stem is not None else F.lit(None).cast("string")).alias("_stem"))
    before = blocks.join(heads.select("doc_id", "_first"), "doc_id", "left").where(F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
    orphans = before.where(F.trim("text") != "").groupBy("doc_id").agg(F.count("*").alias("orphans"))
    all_ = docs.join(heads, "doc_id", "left").join(jumps, "doc_id", "left").join(orphans, "doc_id", "left").fillna(0, ["sections", "orphans"]).fillna(0.0, ["confidence"])
    remarks = F.concat(
        F.coalesce(F.transform("_jumps", lambda j: j["said"]), F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(F.col("orphans") > 0, F.format_string("%d non-empty source block(s) precede any detected heading.", F.col("orphans"))),
            F.when(F.col("sections") == 0, "No reliable debate structure was detected; all source blocks remain unstructured."),
        )),
    )
    return all_.select("doc_id", F.coalesce("title", "_stem").alias("title"), "sections", "orphans", "confidence", remarks.alias("remarks"))


def bodies(blocks: DataFrame, forest: DataFrame) -> DataFrame:
    """(doc_id, section_id, body, places): the text under each section's own heading and where it stands; section_id null before the first."""
    marked = blocks.join(forest.select("doc_id", "pos", "section_id"), ["doc_id", "pos"], "left")
    under = F.last("section_id", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    text = marked.withColumn("under", under).where(F.col("section_id").isNull() & (F.trim("text") != ""))
    lines = text.groupBy("doc_id", F.col("under").alias("section_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("lines"))
    return lines.select("doc_id", "section_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("body"), F.transform("lines", lambda x: x["pos"]).alias("places"))


def argument_chunks(forest: DataFrame, body: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, chunk_level, section_type, heading, argument_heading, parent_heading, heading_path, parent_chunk_id, text, places).

    Arguments: the topmost strong sections of a tree; in a tree without any, the root, or its
    children where it only organises them (no text of its own, and it or a child is a plain
    heading). Submodules: all below an argument but plain organisers, and arguments that are plain
    headings of an inherited type. A plain heading takes the type of its nearest ancestor whose type
    carries over. text: the headings above, then headings and bodies of the whole subtree in order,
    a blank line between; places: the blocks of these, rising. forest: (doc_id, pos, section_id,
    parent_id, path, section_type, heading), body: (section_id, body, places). Subtrees and
    ancestors come from path prefixes, so no join recurses.
    """
    plain = lambda c: F.col(c) == "heading"
    said = F.when(F.trim("heading") != "", F.col("heading"))
    text = F.when(F.trim("body") != "", F.col("body"))
    node = forest.join(body.select("section_id", "body", "places"), "section_id", "left").select("doc_id", "section_id", "parent_id", "path", "pos", "section_type", said.alias("heading"), text.alias("body"), "places")
    up = node.select("section_id", F.posexplode("path").alias("k", "above"))
    facts = node.select(F.col("section_id").alias("above"), F.col("section_type").alias("t"), F.col("heading").alias("h"), F.col("pos").alias("p"))
    lines = up.join(facts, "above").groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("k", "above", "t", "h", "p"))).alias("line"))
    below = node.where("parent_id is not null").groupBy(F.col("parent_id").alias("section_id")).agg(F.max(plain("section_type")).alias("plain_child"))
    roots = node.groupBy(F.element_at("path", 1).alias("root")).agg(F.max(F.col("section_type").isin(*STRONG)).alias("root_strong"))
    n = node.join(lines, "section_id").join(below, "section_id", "left").withColumn("root", F.element_at("path", 1)).join(roots, "root")
    organises = F.col("body").isNull() & F.col("plain_child").isNotNull() & (plain("section_type") | F.col("plain_child"))
    tops = n.where(F.size("path") == 1).select(F.col("section_id").alias("root"), organises.alias("root_organises"))
    n = n.join(tops, "root")
    strong = F.try_element_at(F.filter("line", lambda x: x["t"].isin(*STRONG)), F.lit(1))["above"]
    argument = F.when(F.col("root_strong"), strong).when(F.col("root_organises"), F.try_element_at("path", F.lit(2))).otherwise(F.col("root"))
    carried = F.element_at(F.concat(F.array(F.lit("heading")), F.transform(F.filter(F.slice("line", 1, F.size("line") - 1), lambda x: x["t"].isin(*INHERITED)), lambda x: x["t"])), -1)
    n = n.withColumn("argument", argument).where("argument is not null").withColumn("kind", F.when(plain("section_type"), carried).otherwise(F.col("section_type")))
    own = F.col("argument") == F.col("section_id")
    organiser = F.col("body").isNull() & F.coalesce("plain_child", F.lit(False))
    promoted = plain("section_type") & (F.size("path") > 1) & (F.col("kind") != "heading")
    levels = F.filter(F.array(F.when(own, "argument"), F.when(own & promoted | ~own & ~organiser, "submodule")), lambda x: x.isNotNull())
    n = n.withColumn("chunk_level", F.explode(levels))

    # what lies in each chunk's subtree, in order
    parts = node.select("path", "pos", F.concat_ws("\n\n", "heading", "body").alias("text"), F.concat(F.array("pos"), F.coalesce("places", F.expr("slice(array(pos), 1, 0)"))).alias("places"))
    inside = parts.select(F.explode("path").alias("top"), F.struct("pos", "text", "places").alias("part")).join(n.select(F.col("section_id").alias("top")).distinct(), "top", "left_semi")
    trees = inside.groupBy(F.col("top").alias("section_id")).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    heads = node.select(F.col("section_id").alias("argument"), F.col("heading").alias("argument_heading"))
    n = n.join(trees, "section_id").join(heads, "argument")
    above = F.slice("line", 1, F.size("line") - 1)
    named = lambda line: F.filter(F.transform(line, lambda x: x["h"]), lambda h: h.isNotNull())
    texts = F.filter(F.concat(named(above), F.transform("parts", lambda x: x["text"])), lambda x: x != "")
    places = F.array_sort(F.array_distinct(F.concat(F.transform(above, lambda x: x["p"]), F.flatten(F.transform("parts", lambda x: x["places"])))))
    chunk = lambda level, sid: F.concat_ws(":", F.col("doc_id").cast("string"), level, F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), level, sid), 256), 1, 24))
    return n.select(
        chunk(F.col("chunk_level"), F.col("section_id")).alias("chunk_id"), "doc_id", "chunk_level", F.col("kind").alias("section_type"), "heading", "argument_heading",
        F.try_element_at(F.transform(above, lambda x: x["h"]), F.lit(-1)).alias("parent_heading"), named(F.col("line")).alias("heading_path"),
        F.when(F.col("chunk_level") == "submodule", chunk(F.lit("argument"), F.col("argument"))).alias("parent_chunk_id"), F.array_join(texts, "\n\n").alias("text"), places.alias("places"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, text, style_level): headings, paragraphs and list items of web pages, in order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:/?(?:h[1-6]|p|li|ul|ol|div|article|body))\b)"), F.lit(0))
    b = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("pos", "raw"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    for coded, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(coded), F.lit(char))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    return b.select("doc_id", "pos", plain.alias("text"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("style_level")).where("text != ''")


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, style_level): the lines of documents; blank ones are no blocks."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("pos", "text"), F.lit(None).cast("int").alias("style_level")).where(F.trim("text") != "")


def inspected(sections: DataFrame, depth: int | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Sections of a depth (the top is 1) and of any of the types; None and () ask for nothing."""
    out = sections if depth is None else sections.where(F.size("path") == depth)
    return out.where(F.col("section_type").isin(*types)) if types else out
