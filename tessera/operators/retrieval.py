"""Query generation, evidence fusion, eligibility, scoring, diversification and hydration."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.dedupe import similarity, similarity_of

# Vocabularies and weights of the scoring model.
INTENTS = {
    "uniqueness": "uniqueness status currently now trend",
    "link": "link links causes mechanism mechanisms leads",
    "internal_link": "internal investment confidence growth poverty productivity",
    "impact": "impact impacts harm harms welfare poverty security lives",
    "solvency": "solvency solve solves solution effective",
    "framework": "framework framing weighing calculus criterion",
    "answer": "answer answers response responses preempt rebuttal",
    "theory": "theory conditional advocacies interpretation violation standards voters skew",
    "kritik": "kritik critique capitalism ontology epistemology alternative ballot",
}
MECHANISMS = {
    "ban bans regulation regulations restriction restrictions": "regulation restrictions incentives compliance investment",
    "agriculture agricultural corn crop crops maize farming": "agricultural productivity crop yields farmer livelihoods",
    "trade tariff tariffs imports exports": "trade restrictions prices competition economic effects",
    "economy economic growth investment inflation currency": "investment productivity employment economic growth mechanism",
    "climate environment environmental emissions pollution": "environmental incentives emissions ecosystem mechanism",
    "military security war conflict power": "security deterrence conflict hard power soft power",
    "subsidy subsidies": "subsidies market incentives prices resource allocation",
}
IMPACTS = {
    "agriculture agricultural corn crop crops maize food": "agricultural productivity poverty food security",
    "economy economic growth investment trade jobs": "economic growth employment poverty human welfare",
    "climate environment environmental emissions pollution": "environmental destruction public health human welfare biodiversity",
    "military security war conflict": "conflict escalation lives stability security",
}
THEORY = ("theory_shell", "interpretation", "violation", "standards", "voters", "counter_interpretation", "counter_standards", "reasonability", "competing_interpretations")
KRITIK = ("kritik", "thesis", "framework", "role_of_the_ballot", "alternative")
AGE_NEUTRAL = (*THEORY, *KRITIK, "impact_calculus", "framing", "claim", "warrant")
EMPIRICAL = ("uniqueness", "harms", "solvency", "example", "empirics", "fact")
SECTION_FIT = {
    "uniqueness": ("uniqueness",), "link": ("link", "internal_link", "warrant"), "internal_link": ("internal_link", "link", "warrant", "impact"),
    "impact": ("impact", "internal_link", "impact_calculus", "framing"), "solvency": ("solvency", "harms"),
    "framework": ("framework", "framing", "impact_calculus", "value", "value_criterion"), "answer": ("answer", "response", "preempt", "rebuttal"),
    "theory": THEORY, "kritik": KRITIK,
}
SOURCE_WEIGHT = {"personal": 1.10, "past_case": 1.05, "other": 0.90}
SOURCE_QUALITY = {"personal": 1.0, "past_case": 0.8, "other": 0.55}
CASE_TOPICS = (
    "economy", "economic", "regulation", "subsidies", "subsidy", "inflation", "interest", "currency", "currencies", "development",
    "resources", "nationalization", "environment", "environmental", "investment", "poverty", "welfare", "power",
)
FRESHNESS = {"current": 1.0, "possibly_stale": -0.5, "stale_empirics": -1.0}


@dataclass(frozen=True)
class Settings:
    minimum_base: float = 0.18
    semantic: float = 0.60
    lexical: float = 0.14
    concept: float = 0.16
    heading: float = 0.10
    masterfile_weight: float = 1.15
    source_influence: float = 0.40
    masterfile_bonus: float = 0.06
    theory_masterfile_bonus: float = 0.08
    motion_similarity: float = 0.08
    section_fit: float = 0.08
    freshness: float = 0.04
    same_parent: float = 0.10
    same_document: float = 0.04
    repeated_function: float = 0.05
    text_redundancy: float = 0.12
    redundant_from: float = 0.82
    max_queries: int = 7
    semantic_pool: int = 72
    lexical_pool: int = 36


@dataclass(frozen=True)
class Request:
    motion: str
    side: str | None = None
    round_type: str | None = None
    judge: str | None = None
    source_group: str | None = None
    include_theory: bool | None = None
    include_kritiks: bool | None = None
    intents: tuple[str, ...] = ()
    concepts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Asked:
    """A request whose parts are columns, so that many requests are scored in one plan."""

    side: Column
    round_type: Column
    judge: Column
    source_group: Column
    include_theory: Column
    include_kritiks: Column
    intents: Column
    concepts: Column

    @classmethod
    def of(cls, request: Request | Asked) -> Asked:
        if isinstance(request, Asked):
            return request
        word = lambda x: F.lit(x).cast("string")
        flag = lambda x: F.lit(x).cast("boolean")
        many = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return cls(word(request.side), word(request.round_type), word(request.judge), word(request.source_group), flag(request.include_theory), flag(request.include_kritiks), many(request.intents), many(request.concepts))

    @classmethod
    def columns(cls, prefix: str = "asked_") -> Asked:
        return cls(*[F.col(prefix + name) for name in cls.__dataclass_fields__])


def _listed(words: str) -> Column:
    return F.array(*map(F.lit, words.split()))


def intents(tokens: Column) -> Column:
    """Names of the argumentative functions that a request's own words ask for."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, _listed(w)), k) for k, w in INTENTS.items()]), lambda x: x.isNotNull())


def themes(tokens: Column, table: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, _listed(k)), v) for k, v in table.items()]), lambda x: x.isNotNull())


def generated_queries(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(request_id, ordinal, family, text); requests: request_id, motion, side, and where there are any explicit_concepts, user_queries, infoslide.

    The core are the motion's terms, then those of the explicit concepts, then the first sixty of the infoslide. The user's own
    queries come right after the motion.
    """
    has = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)) if name in requests.columns else F.array().cast(kind)
    slide = F.slice(T.concepts(F.coalesce("infoslide", F.lit(""))), 1, 60) if "infoslide" in requests.columns else F.array().cast("array<string>")
    more_terms = F.flatten(F.transform(has("explicit_concepts", "array<string>"), T.concepts))
    cleaned = T.clean_motion(F.coalesce("motion", F.lit("")))
    r = requests.withColumn("cleaned", cleaned).withColumn("own", has("user_queries", "array<string>")).withColumn("tokens", F.array_distinct(F.concat(T.concepts(F.col("cleaned")), more_terms, slide))).withColumn("core", F.array_join("tokens", " "))
    some = lambda table, other: F.when(F.size(themes(F.col("tokens"), table)) > 0, F.slice(themes(F.col("tokens"), table), 1, 2)).otherwise(F.array(F.concat(F.col("core"), F.lit(other))))
    one = lambda family, text: F.struct(F.lit(family).alias("family"), text.alias("text"))
    more = lambda family, texts: F.transform(texts, lambda t: one(family, t))
    said = lambda *heads: F.array(*[F.concat(F.lit(h + " "), F.col("core")) for h in heads])
    sides = F.when(F.col("side").isin("aff", "gov"), said("benefits advantages reform change", "harms problems current policy status quo")).when(F.col("side").isin("neg", "opp"), said("harms risks disadvantages change", "benefits defenses current policy restrictions")).otherwise(F.array().cast("array<string>"))
    own = F.transform("own", lambda t: one("explicit", F.trim(F.regexp_replace(t, r"\s+", " "))))
    every = F.concat(F.array(one("full_motion", F.col("cleaned"))), own, F.array(one("core_concept", F.col("core"))), more("mechanism", some(MECHANISMS, " incentives mechanism effects")), more("impact", some(IMPACTS, " impacts harms benefits")), more("side_aware", sides))
    rows = r.select("request_id", F.posexplode(every).alias("at", "q")).where(F.trim("q.text") != "")
    first = rows.withColumn("same", F.row_number().over(Window.partitionBy("request_id", F.lower("q.text")).orderBy("at"))).where("same = 1")
    placed = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("request_id").orderBy("at")) - 1)
    return placed.where(F.col("ordinal") < settings.max_queries).select("request_id", "ordinal", "q.family", "q.text")


def canonical(hits: DataFrame, representatives: DataFrame) -> DataFrame:
    """hits with doc_id replaced by the one that stands for it; representatives: member, representative."""
    return hits.join(representatives, F.col("doc_id") == F.col("member"), "left").withColumn("doc_id", F.coalesce("representative", "doc_id")).drop("member", "representative")


def evidence(hits: DataFrame, name: str) -> DataFrame:
    """(doc_id, <name>_score, <name>_matches): best score, and how many queries found it; hits: query_id, doc_id, score."""
    return hits.groupBy("doc_id").agg(F.max("score").alias(f"{name}_score"), F.countDistinct("query_id").alias(f"{name}_matches"))


def fused(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    both = semantic.join(lexical, "doc_id", "full_outer")
    return both.fillna(0.0, ["semantic_score", "lexical_score"]).fillna(0, ["semantic_matches", "lexical_matches"])


def is_theory(section: Column, document_type: Column) -> Column:
    return (document_type == "theory") | F.lower(section).isin(*THEORY)


def is_kritik(section: Column, document_type: Column) -> Column:
    return (document_type == "kritik") | F.lower(section).isin(*KRITIK) & ~is_theory(section, document_type)


def eligibility(request: Request | Asked) -> Column:
    """The first rule that keeps a chunk out, or ok. Columns: source_group, section_type, document_type, is_special."""
    a = Asked.of(request)
    theory, kritik = is_theory(F.col("section_type"), F.col("document_type")), is_kritik(F.col("section_type"), F.col("document_type"))
    personal = (F.col("source_group") == "personal") | F.col("is_special")
    asked = F.array_contains(a.intents, "theory")
    yes, no = lambda c: F.coalesce(c, F.lit(False)), lambda c: F.coalesce(~c, F.lit(False))
    return (
        F.when(yes(F.col("source_group") != a.source_group), "source-group filter")
        .when(theory & ~personal, "non-personal theory excluded")
        .when(theory & no(a.include_theory), "theory explicitly excluded")
        .when(theory & ~yes(a.include_theory) & ~asked, "theory not requested")
        .when(theory, "ok")
        .when(asked, "non-theory material excluded from theory retrieval")
        .when(kritik & ~personal, "non-personal kritik excluded")
        .when(kritik & no(a.include_kritiks), "kritiks explicitly excluded")
        .when(kritik & ~yes(a.include_kritiks) & ~(yes(a.judge == "tech") & F.array_contains(a.intents, "kritik")), "kritik not eligible for judge/context")
        .otherwise("ok")
    )


def _table(values: dict, col: Column, default: float) -> Column:
    return F.coalesce(*[F.when(col == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def empirical() -> Column:
    section = F.lower(F.col("section_type"))
    out = is_theory(section, F.col("document_type")) | is_kritik(section, F.col("document_type")) | section.isin(*AGE_NEUTRAL)
    return ~out & (section.isin(*EMPIRICAL) | F.col("freshness").isin(*FRESHNESS) | F.col("text").rlike(r"\p{Nd}"))


def scored(candidates: DataFrame, request: Request | Asked, settings: Settings = Settings()) -> DataFrame:
    """Adds base and each part of the score, their sum, support and its level.

    Columns: semantic_score, lexical_score, their matches, text, heading, section_type,
    document_type, source_group, is_special, side, round_type, freshness.
    """
    s, a = settings, Asked.of(request)
    tokens = a.concepts
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    base = s.semantic * clamp(F.col("semantic_score")) + s.lexical * clamp(F.col("lexical_score")) + s.concept * T.overlap(tokens, T.concepts(F.col("text"))) + s.heading * T.overlap(tokens, T.concepts(F.col("heading")))
    out = candidates.withColumn("base", base)
    weight = F.when(F.col("is_special"), s.masterfile_weight).otherwise(_table(SOURCE_WEIGHT, F.col("source_group"), 0.90))
    context = T.overlap(tokens, T.concepts(F.concat_ws(" ", "heading", F.substring("text", 1, 500))))
    motion = F.when((F.col("source_group") == "past_case") & (context >= 0.20), F.least(F.lit(1.0), 0.7 * context + 0.3 * F.greatest(F.lit(0.0), F.col("semantic_score"))) * s.motion_similarity).otherwise(0.0)
    section = F.lower(F.col("section_type"))
    serves = lambda i, kinds: F.when(section == i, 1.0 if i in kinds else 0.0).when(section.isin(*kinds), 0.75).otherwise(0.0)
    fits = [F.when(F.array_contains(a.intents, i), serves(i, kinds)).otherwise(0.0) for i, kinds in SECTION_FIT.items()]
    lay = F.when(a.judge.isin("flay", "fully_lay") & section.isin("claim", "warrant", "impact", "harms", "solvency"), 0.35).otherwise(0.0)
    fit = F.greatest(*fits, lay)
    family = lambda c: F.when(c.isin("aff", "gov"), 1).when(c.isin("neg", "opp"), 2)
    mine, theirs = family(a.side), family(F.col("side"))
    sides = F.when(mine == theirs, 0.025).when(mine.isNotNull() & theirs.isNotNull(), -0.01).otherwise(0.0)
    stated = a.round_type.isNotNull() & (a.round_type != "unknown")
    rounds = F.when(stated & (F.col("round_type") == a.round_type), 0.015).when(stated & (F.coalesce("round_type", F.lit("unknown")) != "unknown"), -0.005).otherwise(0.0)
    out = out.select(
        "*",
        (F.col("base") * (weight - 1) * s.source_influence).alias("source_part"),
        motion.alias("motion_part"),
        (fit * s.section_fit).alias("section_part"),
        F.when(empirical(), _table(FRESHNESS, F.col("freshness"), 0.0) * s.freshness).otherwise(0.0).alias("freshness_part"),
        (sides + rounds).alias("compatibility_part"),
    )
    total = F.col("base") + F.col("source_part") + F.col("motion_part") + F.col("section_part") + F.col("freshness_part") + F.col("compatibility_part")
    support = 0.65 * F.greatest(F.lit(0.0), F.col("semantic_score")) + 0.15 * F.col("lexical_score") + 0.10 * _table(SOURCE_QUALITY, F.col("source_group"), 0.55) + 0.10 * F.least(F.lit(1.0), (F.col("semantic_matches") + F.col("lexical_matches")) / 4)
    support = clamp(support - F.when((F.col("freshness") == "stale_empirics") & empirical(), 0.10).otherwise(0.0))
    out = out.withColumn("score", total).withColumn("support", support)
    return out.withColumn("support_level", F.when(F.col("support") >= 0.72, "high").when(F.col("support") >= 0.42, "moderate").otherwise("low"))


def reasons() -> Column:
    """What speaks for a scored candidate, in order."""
    pairs = ((F.col("semantic_score") >= 0.5, "close in meaning"), (F.col("lexical_score") > 0, "shares the query's words"), (F.col("section_part") > 0, "serves the function asked for"), (F.col("source_part") > 0, "preferred source"), (F.col("motion_part") > 0, "like a past motion"), (F.col("freshness_part") < 0, "may be out of date"))
    return F.filter(F.array(*[F.when(c, t) for c, t in pairs]), lambda x: x.isNotNull())


def diversified(pool: DataFrame, k: int | None, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, adjusted, pick): greedy choice of k by score less redundancy with what is chosen.

    Without k each query takes as many as its rows' column most says.

    A pool is cut to settings.semantic_pool + settings.lexical_pool candidates by score first, so
    the fold over one query's pool is small whatever the table. pool: query_id, doc_id, score,
    text, section_type, parent, document.
    """
    s = settings
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    cut = pool.withColumn("at", F.row_number().over(w)).where(F.col("at") <= s.semantic_pool + s.lexical_pool)
    rows = cut.select("query_id", F.lit(k).cast("int").alias("most") if k is not None else F.col("most").cast("int"), "doc_id", "score", F.lower("section_type").alias("section_type"), "parent", "document", T.normalized(F.coalesce("text", F.lit(""))).alias("norm"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left = part.sort_values("doc_id").to_dict("records")
        chosen: list[dict] = []

        def like(a: str, b: str) -> float:
            # characters in order can't agree on more than the shorter text has
            if not a or not b or 0.7 * 2 * min(len(a), len(b)) / (len(a) + len(b)) + 0.3 < s.redundant_from:
                return float(a == b)
            return similarity(a, b)

        def penalty(r: dict, c: dict) -> float:
            """What r loses to a chosen c, but for its repeated function."""
            worst = s.same_parent if r["parent"] is not None and r["parent"] == c["parent"] else 0.0
            if r["document"] == c["document"]:
                worst = max(worst, s.same_document)
            above = like(r["norm"], c["norm"]) - s.redundant_from
            return max(worst, above / (1 - s.redundant_from) * s.text_redundancy) if above >= 0 else worst

        for r in left:
            r["worst"], r["same"] = 0.0, 0
        adjusted = lambda r: r["score"] - round(r["worst"] + s.repeated_function * min(2, r["same"]), 6)
        while left and len(chosen) < part["most"].iloc[0]:
            best = max(left, key=lambda r: (adjusted(r), -r["doc_id"]))
            best["adjusted"] = round(adjusted(best), 6)
            left.remove(best)
            chosen.append(best)
            for r in left:
                r["worst"] = max(r["worst"], penalty(r, best))
                r["same"] += r["section_type"] == best["section_type"]
        return pd.DataFrame([(c["query_id"], c["doc_id"], c["adjusted"], i + 1) for i, c in enumerate(chosen)], columns=["query_id", "doc_id", "adjusted", "pick"])

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, adjusted double, pick int")


def hydrated(parents: DataFrame, children: DataFrame, key: str, foreign: str, child_key: str, most: int = 3) -> DataFrame:
    """(key, children): ids of the first children of each parent; partial ranks keep a hot parent's shuffle small."""
    w = Window.partitionBy(foreign).orderBy(child_key)
    first = children.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    lists = first.groupBy(foreign).agg(F.array_join(F.array_sort(F.collect_list(child_key)), ",").alias("children"))
    return parents.join(lists, F.col(key) == F.col(foreign), "left").select(key, F.coalesce("children", F.lit("")).alias("children"))


def suppressed(hits: DataFrame, representatives: DataFrame) -> DataFrame:
    """Distinct doc_ids among hits that another document stands for; hits of several searches may be united first."""
    return hits.select("doc_id").distinct().join(representatives.select(F.col("member").alias("doc_id")).distinct(), "doc_id", "left_semi")


def split_levels(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arguments, fallback chunks and rows without a level among them, and submodules."""
    sub = F.coalesce(F.col("chunk_level") == "submodule", F.lit(False))
    return candidates.where(~sub), candidates.where(sub)


def with_parent(submodules: DataFrame, chunks: DataFrame, foreign: str, key: str, columns: list[str]) -> DataFrame:
    """Adds the parent's columns, as parent_<name>, null where a submodule has no parent."""
    parents = chunks.select(F.col(key).alias("_key"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return submodules.join(parents, F.col(foreign) == F.col("_key"), "left").drop("_key")


def statistics(candidates: DataFrame, minimum: float = Settings.minimum_base) -> DataFrame:
    """One row of counts of scored candidates: merged, ineligible, below the threshold, left; candidates: reason, base."""
    ok = F.coalesce(F.col("reason") == "ok", F.lit(False))
    low = F.coalesce(F.round("base", 6) < minimum, F.lit(True))
    return candidates.agg(F.count("*").alias("merged_candidates"), F.count_if(~ok).alias("ineligible_candidates"), F.count_if(ok & low).alias("below_relevance_threshold"), F.count_if(ok & ~low).alias("scored_candidates"))


def masterfile_weight(filename: Column, source_group: Column, names: tuple[str, ...], settings: Settings = Settings()) -> Column:
    """Priority of a file: that of masterfiles where its stem is one of the names in either case, else its group's."""
    stem = F.lower(F.regexp_replace(filename, r"\.[^./]*$", ""))
    return F.when(stem.isin(*[n.lower() for n in names]), settings.masterfile_weight).otherwise(_table(SOURCE_WEIGHT, source_group, SOURCE_WEIGHT["other"]))


def masterfile_part(base: Column, name: Column, concepts: tuple[str, ...], asked: tuple[str, ...], theory_file: str, case_file: str, settings: Settings = Settings()) -> Column:
    """What a masterfile adds: the theory file where theory is asked for, the case file where its topics or functions are.

    theory_file and case_file are the names that an archive gives these files.
    """
    relevant = bool(set(concepts) & set(CASE_TOPICS) or set(asked) & {"internal_link", "impact", "framework", "link"})
    special = F.lower(F.coalesce(name, F.lit("")))
    theory = special == theory_file.lower()
    return F.when(theory & F.lit("theory" in asked), base * settings.theory_masterfile_bonus).when((special == case_file.lower()) & F.lit(relevant), base * settings.masterfile_bonus).otherwise(0.0)


#: Text agreement from which a submodule only repeats an argument; what characters in order must then reach, and the lengths' ratio with it.
REPEATS = 0.98
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letter_counts(norm: Column) -> Column:
    return F.array(*[F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))) for c in LETTERS])


def repeating(submodules: DataFrame, arguments: DataFrame, threshold: float = REPEATS) -> DataFrame:
    """(request_id, doc_id) of submodules whose text is as good as that of an argument chosen for the same request.

    submodules: request_id, doc_id, text; arguments: request_id, text. Agreement is dedupe.similarity of the
    comparison texts. Texts that agree word for word meet by hash. Others are compared only where their lengths and
    letters allow the threshold: characters in order can't agree on more than the letters have in common.
    """
    side = lambda df, k, *keep: df.select("request_id", *keep, T.normalized_exact(F.coalesce("text", F.lit(""))).alias(k))
    subs, args = side(submodules, "a", "doc_id"), side(arguments, "b").distinct()
    equal = subs.join(args.withColumnRenamed("b", "a"), ["request_id", "a"], "left_semi").select("request_id", "doc_id")
    # with all words in common, characters in order must still reach this
    need = (threshold - 0.3) / 0.7
    la, lb = F.length("a"), F.length("b")
    rest = subs.join(equal, ["request_id", "doc_id"], "left_anti").withColumn("ca", _letter_counts(F.col("a")))
    pairs = rest.join(args.withColumn("cb", _letter_counts(F.col("b"))), "request_id").where((la > 0) & (lb > 0) & (2 * F.least(la, lb) >= need * (la + lb)))
    other = lambda n, counts: n - F.aggregate(counts, F.lit(0), lambda s, x: s + x)
    common = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x) + F.least(other(la, F.col("ca")), other(lb, F.col("cb")))
    near = pairs.where(2 * common >= need * (la + lb)).withColumn("s", similarity_of("a", "b", F.lit(threshold))).where(F.col("s") >= threshold)
    return equal.unionByName(near.select("request_id", "doc_id")).distinct()
