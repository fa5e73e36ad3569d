"""Documents of an archive as rows, and their chunks: arguments and submodules where sections were found, packed blocks elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunking, reports, retrieval, structure
from tessera.sources.files import source_group
from tessera.tables import materialize


def document_rows(docs: DataFrame, forest: DataFrame, outlines: DataFrame, masterfiles: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, filename, full_path, source_group, document_type, side, round_type, year, title, raw_text, priority_weight, is_special, special_name).

    docs: doc_id, full_path, raw_text, and where it is stated source_group, document_type, side, round_type, year, priority_weight:
    what is stated wins over what path and sections tell. masterfiles: stems of files that are special whatever their folder.
    """
    said = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), other) if c in docs.columns else other
    parts = F.split("full_path", "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    kinds = forest.groupBy("doc_id").agg(F.collect_set("section_type").alias("_kinds"), F.collect_list(F.when(F.col("parent_id").isNull(), F.col("section_type"))).alias("_roots"))
    d = docs.join(kinds, "doc_id", "left").join(outlines.select("doc_id", "title"), "doc_id", "left")
    none = F.array().cast("array<string>")
    found, roots = F.coalesce("_kinds", none), F.coalesce("_roots", none)
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    special = F.lower(stem).isin(*[m.lower() for m in masterfiles]) if masterfiles else F.lit(False)
    group = said("source_group", "string", F.when(special, "personal").otherwise(source_group(folders)))
    weight = F.when(special, retrieval.Settings.masterfile_weight).otherwise(F.coalesce(*[F.when(group == k, F.lit(v)) for k, v in retrieval.SOURCE_WEIGHT.items()], F.lit(retrieval.SOURCE_WEIGHT["other"])))
    return d.select(
        "doc_id", name.alias("filename"), "full_path", group.alias("source_group"), said("document_type", "string", reports.document_type(name, folders, found, roots, special)).alias("document_type"),
        said("side", "string", chunking.side(F.col("full_path"))).alias("side"), said("round_type", "string", reports.round_type(found)).alias("round_type"), said("year", "int", F.lit(None).cast("int")).alias("year"),
        F.coalesce("title", stem).alias("title"), "raw_text", said("priority_weight", "double", weight).alias("priority_weight"), special.alias("is_special"), F.when(special, stem).alias("special_name"),
    )


def chunked(blocks: DataFrame, settings: chunking.Settings = chunking.Settings()) -> DataFrame:
    """(chunk_id, doc_id, chunk_level, section_type, heading, argument_heading, parent_heading, heading_path, parent_chunk_id, text, places).

    blocks: doc_id, pos, text, style_level. Documents with a section give arguments and submodules; the others, and only those,
    are packed by size, as chunks of level fallback and type unknown.
    """
    found = materialize(structure.detected(blocks), "found")
    forest = materialize(structure.sections(found.where("heading is not null")), "sections")
    semantic = structure.argument_chunks(forest, structure.bodies(blocks, forest))
    loose = blocks.join(forest.select("doc_id").distinct(), "doc_id", "left_anti").where(F.trim("text") != "")
    p = chunking.packed(loose, settings)
    none = F.lit(None).cast("string")
    cid = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("fallback"), F.lpad(F.col("chunk").cast("string"), 4, "0"))
    fallback = p.select(cid.alias("chunk_id"), "doc_id", F.lit("fallback").alias("chunk_level"), F.lit("unknown").alias("section_type"), none.alias("heading"), none.alias("argument_heading"), none.alias("parent_heading"), F.array().cast("array<string>").alias("heading_path"), none.alias("parent_chunk_id"), "text", F.sequence("first_block", "last_block").alias("places"))
    return semantic.unionByName(fallback)


def groups_listed(groups: DataFrame, duplicate_type: str | None = None, representative: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Duplicate groups of a type and with a representative (None asks for nothing), in order of their ids; offset counts only with a limit."""
    conditions = [F.col(c) == v for c, v in (("duplicate_type", duplicate_type), ("representative_chunk_id", representative)) if v is not None]
    rows = groups.where(reduce(Column.__and__, conditions, F.lit(True))).orderBy("duplicate_group_id")
    return rows if limit is None else rows.offset(offset).limit(limit)
