"""Many retrieval requests in one plan, keyed by request: queries, searches, pools, scores, choice, parents and children, counters."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lexical, postings, retrieval
from tessera.tables import materialize


@dataclass(frozen=True)
class Limits:
    arguments: int = 5
    submodules: int = 18
    per_semantic: int = 18
    per_lexical: int = 10
    query_terms: int = 8
    children: int = 3


#: Optional columns of a request.
OPTIONAL = {
    "infoslide": "string", "side": "string", "round_type": "string", "judge": "string", "source_group": "string", "include_theory": "boolean",
    "include_kritiks": "boolean", "explicit_concepts": "array<string>", "user_queries": "array<string>", "desired_top_k": "int", "desired_arguments": "int", "desired_submodules": "int",
}
COUNTERS = ("semantic_hits", "lexical_hits", "merged_candidates", "hydrated_candidates", "ineligible_candidates", "duplicate_candidates_suppressed", "redundant_candidates_suppressed", "below_relevance_threshold", "full_arguments_returned", "submodules_returned")


@dataclass(frozen=True)
class Result:
    """selected: request_id, doc_id, level, pick, score, adjusted, support, support_level, parent, children; statistics: a row for each request."""

    queries: DataFrame
    selected: DataFrame
    statistics: DataFrame


def completed(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Requests with all columns, the terms and intents that their own words name, and how many results they ask for."""
    r = requests.select("request_id", "motion", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])
    own = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    said = F.concat_ws(" ", F.coalesce("motion", F.lit("")), own("explicit_concepts"), own("user_queries"))
    about = F.concat_ws(" ", T.clean_motion(F.coalesce("motion", F.lit(""))), own("explicit_concepts"))
    whole = F.col("desired_top_k").isNotNull() & F.col("desired_arguments").isNull() & F.col("desired_submodules").isNull()
    arguments = F.coalesce("desired_arguments", F.lit(limits.arguments))
    arguments = F.when(whole, F.least(arguments, F.greatest(F.lit(1), F.floor(F.col("desired_top_k") / 4)))).otherwise(arguments).cast("int")
    r = r.withColumn("intents", retrieval.intents(T.concepts(said))).withColumn("concepts", T.concepts(about)).withColumn("n_arguments", arguments)
    rest = F.when(whole, F.greatest(F.lit(0), F.col("desired_top_k") - F.col("n_arguments"))).otherwise(F.coalesce("desired_submodules", F.lit(limits.submodules)))
    return r.withColumn("n_submodules", rest.cast("int"))


def evidence(hits: DataFrame, representatives: DataFrame, name: str, pool: int) -> DataFrame:
    """(request_id, doc_id, <name>_score, <name>_matches) of the pool best documents of each request; hits: request_id, text, doc_id, score.

    Hits count for the document that stands for them; matches are distinct query texts. Ties by doc_id.
    """
    c = retrieval.canonical(hits, representatives)
    e = c.groupBy("request_id", "doc_id").agg(F.max("score").alias(f"{name}_score"), F.countDistinct("text").alias(f"{name}_matches"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(f"{name}_score"), "doc_id"))
    return e.withColumn("_at", place).where(F.col("_at") <= pool).drop("_at")


def lexical_hits(queries: DataFrame, docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(request_id, text, doc_id, score): documents that hold the first terms of a query, all of them, by rank. Equal texts are searched once."""
    texts = queries.select("text").distinct().withColumn("words", F.array_join(F.slice(T.concepts(F.col("text")), 1, limits.query_terms), " "))
    asked = texts.select(F.col("text").alias("query_id"), F.explode(F.array_distinct(lexical.terms(F.col("words")))).alias("term"))
    found = postings.top(docs, asked, limits.per_lexical, all_terms=True)
    return queries.select("request_id", "text").join(found.withColumnRenamed("query_id", "text"), "text").select("request_id", "text", "doc_id", lexical.rank_score(F.col("rank")).alias("score"))


def retrieve(requests: DataFrame, chunks: DataFrame, semantic: DataFrame, representatives: DataFrame, settings: retrieval.Settings = retrieval.Settings(), limits: Limits = Limits()) -> Result:
    """The whole retrieval of every request.

    requests: request_id (long), motion and any of OPTIONAL. chunks: doc_id (long), text, heading, chunk_level, section_type,
    document_type, source_group, is_special, side, round_type, freshness, parent (doc_id of the argument), document. semantic: request_id,
    ordinal of a generated query, doc_id, score, at most limits.per_semantic for each query: the answers of a vector search.
    representatives: member, representative. Each request's candidates are at most the two pools, so what a request's greedy
    choice holds is bounded; nothing goes through the driver.
    """
    r = materialize(completed(requests, limits), "requests")
    queries = materialize(retrieval.generated_queries(r, settings), "queries")
    near = Window.partitionBy("request_id", "ordinal").orderBy(F.desc("score"), "doc_id")
    hits = semantic.withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= limits.per_semantic).join(queries.select("request_id", "ordinal", "text"), ["request_id", "ordinal"])
    hits = materialize(hits.select("request_id", "text", "doc_id", F.col("score").cast("double").alias("score")), "semantic_hits")
    words = materialize(lexical_hits(queries, chunks.select("doc_id", "text"), limits), "lexical_hits")
    both = evidence(hits, representatives, "semantic", settings.semantic_pool).join(evidence(words, representatives, "lexical", settings.lexical_pool), ["request_id", "doc_id"], "full_outer")
    both = materialize(both.fillna(0.0, ["semantic_score", "lexical_score"]).fillna(0, ["semantic_matches", "lexical_matches"]), "evidence")

    named = r.select("request_id", "n_arguments", "n_submodules", *[F.col(f.name).alias(f"asked_{f.name}") for f in fields(retrieval.Asked)])
    asked = retrieval.Asked.columns()
    rows = both.join(chunks, "doc_id").join(named, "request_id")
    rows = retrieval.scored(rows, asked, settings).withColumn("eligible", retrieval.eligibility(asked) == "ok").withColumn("reaches", F.round("base", 6) >= settings.minimum_base)
    rows = materialize(rows, "candidates")
    left = rows.where("eligible and reaches")
    pool = lambda df, most: df.select(F.col("request_id").alias("query_id"), F.col(most).alias("most"), "doc_id", "score", "text", "section_type", "parent", "document")
    picked = lambda df, level: df.select(F.col("query_id").alias("request_id"), "doc_id", "adjusted", "pick", F.lit(level).alias("level"))
    arguments, submodules = retrieval.split_levels(left)
    full = materialize(picked(retrieval.diversified(pool(arguments, "n_arguments"), None, settings), "argument"), "arguments")
    said = full.join(left.select("request_id", "doc_id", "text"), ["request_id", "doc_id"]).select("request_id", "text")
    repeated = materialize(retrieval.repeating(submodules.select("request_id", "doc_id", "text"), said), "repeated")
    fresh = submodules.join(repeated, ["request_id", "doc_id"], "left_anti")
    subs = picked(retrieval.diversified(pool(fresh, "n_submodules"), None, settings), "submodule")
    chosen = materialize(full.unionByName(subs), "chosen")

    kids = chunks.where(F.col("parent").isNotNull()).select(F.col("parent").alias("doc_id"), F.col("doc_id").alias("child"))
    wanted = kids.join(chosen.where("level = 'argument'").select("doc_id").distinct(), "doc_id", "left_semi")
    first = wanted.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("child"))).where(F.col("_at") <= limits.children)
    children = first.groupBy("doc_id").agg(F.array_sort(F.collect_list("child")).alias("children"))
    selected = chosen.join(rows.select("request_id", "doc_id", "score", "support", "support_level", "parent"), ["request_id", "doc_id"]).join(children, "doc_id", "left")
    selected = selected.select("request_id", "doc_id", "level", "pick", "score", "adjusted", "support", "support_level", "parent", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))

    stood_for = hits.select("request_id", "doc_id").union(words.select("request_id", "doc_id")).distinct().join(representatives.where("member != representative").select(F.col("member").alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = {
        "semantic_hits": hits, "lexical_hits": words, "merged_candidates": both, "hydrated_candidates": rows, "ineligible_candidates": rows.where("not eligible"),
        "duplicate_candidates_suppressed": stood_for, "redundant_candidates_suppressed": repeated, "below_relevance_threshold": rows.where("eligible and not reaches"),
        "full_arguments_returned": chosen.where("level = 'argument'"), "submodules_returned": chosen.where("level = 'submodule'"),
    }
    # counters of all kinds meet in one aggregation
    counted = None
    for name in COUNTERS:
        part = parts[name].select("request_id", F.lit(name).alias("name"))
        counted = part if counted is None else counted.unionByName(part)
    table = counted.groupBy("request_id").agg(*[F.count_if(F.col("name") == n).alias(n) for n in COUNTERS])
    stats = r.select("request_id").join(table, "request_id", "left").fillna(0, list(COUNTERS))
    return Result(queries, selected, stats.withColumn("warnings", warnings()))


def warnings() -> Column:
    """What went missing in a request's counters."""
    lost = F.col("merged_candidates") - F.col("hydrated_candidates")
    nothing = F.col("full_arguments_returned") + F.col("submodules_returned") == 0
    return F.array_compact(F.array(F.when(lost > 0, F.format_string("%d candidate(s) are missing from the store.", lost)), F.when(nothing, "No archive material met the minimum relevance and eligibility rules.")))
