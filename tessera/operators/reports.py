"""Categories, notes, statuses, counts and reports over retrieved or generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.groups import ordinals
from tessera.operators.retrieval import EMPIRICAL, is_kritik, is_theory

# The knowledge category of each section type.
CATEGORIES = {
    "uniqueness": ("uniqueness", "uq", "harms"), "links": ("link", "l"), "internal_links": ("internal_link", "il"), "warrants": ("warrant", "claim"),
    "solvency": ("solvency",), "impacts": ("impact", "impx"), "preempts": ("preempt", "answer", "response", "rebuttal"),
    "frameworks": ("framework", "framing", "impact_calculus", "value", "value_criterion"),
}
RUBRIC = ("clarity", "mechanism", "impact", "evidence", "comparison", "defensibility", "judge_fit", "originality")
POLICY_SECTIONS = ("advantage", "counterplan", "disadvantage", "inherency", "internal_link", "plan", "uniqueness")


def category(level: Column, section: Column, document_type: Column) -> Column:
    """Theory and kritiks first, then whole arguments, then what a submodule's section is for."""
    out = F.when(is_theory(section, document_type) | is_kritik(section, document_type), "theory_k_options").when(level == "argument", "related_arguments")
    for name, kinds in CATEGORIES.items():
        out = out.when(F.lower(section).isin(*kinds), name)
    return out.otherwise("other_modules")


def verification_notes(freshness: Column, section: Column, year: Column, support_level: Column, current_year: int) -> Column:
    """What to check before use, in order."""
    empirical = F.lower(section).isin(*EMPIRICAL, "uq")
    notes = (
        (freshness.isin("possibly_stale", "stale_empirics"), "flagged as possibly out of date"),
        (empirical & (year.isNull() | (year < current_year)), "empirical and undated or of an earlier year"),
        (year > current_year, "dated later than the round"),
        (support_level == "low", "low support"),
    )
    return F.filter(F.array(*[F.when(c, t) for c, t in notes]), lambda x: x.isNotNull())


def document_type(filename: Column, folders: Column, sections: Column, roots: Column, special: Column) -> Column:
    """The first rule that fits: file name, folders, then the section types found."""
    name = F.lower(filename)
    norm = F.transform(folders, lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))
    has = lambda *kinds: F.arrays_overlap(sections, F.array(*map(F.lit, kinds)))
    return (
        F.when(special | name.contains("case file") | name.contains("theory file"), "masterfile")
        .when(name.contains("fact sheet"), "fact_sheet")
        .when(F.exists(norm, lambda p: (p == "theory") | p.startswith("theory ")), "theory")
        .when(F.exists(norm, lambda p: p.isin("k", "ks", "kritik", "kritiks") | p.startswith("kritik ")), "kritik")
        .when(has("theory_shell"), "theory")
        .when(has("kritik"), "kritik")
        .when((F.size(roots) > 0) & F.forall(roots, lambda r: r == "answer"), "block")
        .when(has("advantage", "contention", "disadvantage"), "case")
        .otherwise("unknown")
    )


def round_type(sections: Column) -> Column:
    has = lambda *kinds: F.size(F.array_intersect(sections, F.array(*map(F.lit, kinds))))
    return F.when(has("value", "value_criterion") == 2, "value").when(has("threshold_of_truth") > 0, "fact").when(has(*POLICY_SECTIONS) > 0, "policy").otherwise("unknown")


def batch_status(attempts: Column, failures: Column, invalid: Column, kept: Column) -> Column:
    return F.when(failures == attempts, "failed").when((failures > 0) | (invalid > 0), "partial").when(kept > 0, "completed").otherwise("no_results")


def failure_kind(status: Column, extension: Column) -> Column:
    return F.when(status == "needs_ocr", "needs_ocr").when(extension == "doc", "legacy_doc").when(status == "unsupported", "unsupported").otherwise("parse")


def failure_code(message: Column) -> Column:
    """What a command's diagnostics say went wrong, by the first group of words that occurs."""
    t = F.lower(message)
    some = lambda *words: t.rlike("|".join(words))
    return (
        F.when(some("usage limit", "rate limit", "quota", "usage_limit", "429"), "rate_limit_or_quota")
        .when(some("not logged in", "unauthorized", "authentication", "401"), "cli_login")
        .when(some("unexpected argument", "unknown option", "unrecognized"), "cli_incompatible")
        .when(t.contains("model") & some("not found", "not supported", "unavailable"), "model_unavailable")
        .otherwise("provider_error")
    )


def token_usage(response: Column) -> Column:
    """Input, output and total tokens of a JSON response in either of two vocabularies."""
    get = lambda a, b: F.coalesce(F.get_json_object(response, f"$.usage.{a}"), F.get_json_object(response, f"$.usageMetadata.{b}")).cast("long")
    return F.struct(get("input_tokens", "promptTokenCount").alias("input_tokens"), get("output_tokens", "candidatesTokenCount").alias("output_tokens"), get("total_tokens", "totalTokenCount").alias("total_tokens"))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, total) for each of values, absent ones included."""
    spark = SparkSession.active()
    named = spark.createDataFrame([(v,) for v in values], "value string")
    return named.join(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("total")), "value", "left").select("value", F.coalesce("total", F.lit(0)).alias("total"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; aggregated on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], time: str, name: str) -> DataFrame:
    """The newest row of each key, of equal times the one of greatest name."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, name)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def exactly_once(df: DataFrame, key: str, value: str, expected: int) -> DataFrame:
    """(key, complete): whether the values 1 to expected occur once each and no other does."""
    ok = (F.count("*") == expected) & (F.countDistinct(value) == expected) & (F.min(value) == 1) & (F.max(value) == expected)
    return df.groupBy(key).agg(ok.alias("complete"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ordinal, from 0 within each group."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def rubric_total() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in RUBRIC[1:]), F.coalesce(F.col(RUBRIC[0]), F.lit(0)))


def result_limits(desired: int | None, arguments: int = 5, submodules: int = 18) -> tuple[int, int]:
    """How many arguments and submodules a request returns: a quarter are arguments, at most the usual number."""
    if desired is None:
        return arguments, submodules
    most = min(arguments, max(1, desired // 4))
    return most, max(0, desired - most)


def markdown(sections: DataFrame) -> DataFrame:
    """(case_id, document): headed sections in order, blank ones left out; sections: case_id, position, title, body."""
    said = sections.where(F.trim(F.coalesce("body", F.lit(""))) != "")
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.trim("body"))
    ordered = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))
    return said.groupBy("case_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("document"))


def research_queries(motion: Column, concept: Column, year: int) -> Column:
    """Up to three searches for a motion: its evidence gap, official figures, studies."""
    own = F.when(F.trim(F.coalesce(concept, F.lit(""))) != "", F.concat_ws(" ", motion, F.substring(concept, 1, 300), F.lit(f"{year} evidence outcomes limitations")))
    rest = (F.concat(motion, F.lit(f" {year} official statistics government data")), F.concat(motion, F.lit(" peer reviewed study evidence outcomes limitations")), F.concat(motion, F.lit(f" {year} recent developments evidence risks")))
    return F.slice(F.array_distinct(F.filter(F.array(own, *rest), lambda x: x.isNotNull())), 1, 3)


def category_lists(items: DataFrame, category: str, key: str, position: str) -> DataFrame:
    """(category, key, ordinal): items in order of their first occurrence in a category, from 0; repeats are left out."""
    first = items.groupBy(category, key).agg(F.min(position).alias("_at"))
    place = F.struct(F.col("_at"), F.col(key)).alias("_place")
    return ordinals(first.select(category, key, place), category, "_place", "ordinal").drop("_place")


def provenance_lines(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, line) of each cited chunk once: its id, source file and heading path; missing chunks have no line."""
    once = cited.select("chunk_id").distinct().join(chunks.select("chunk_id", "source_file", "heading_path"), "chunk_id")
    return once.select("chunk_id", F.concat(F.lit("- Archive "), "chunk_id", F.lit(": "), F.coalesce("source_file", F.lit("")), F.lit(" \u2014 "), F.coalesce(F.array_join("heading_path", " > "), F.lit(""))).alias("line"))
