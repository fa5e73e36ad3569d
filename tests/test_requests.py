from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import requests, retrieval
from tessera.operators.dedupe import similarity

CHUNK = "doc_id long, text string, heading string, chunk_level string, section_type string, document_type string, source_group string, is_special boolean, side string, round_type string, freshness string, parent long, document long"
REQUEST = "request_id long, motion string, side string, judge string, source_group string, include_theory boolean, desired_arguments int, desired_submodules int, desired_top_k int, user_queries array<string>, explicit_concepts array<string>"


def chunk(i, text, level="argument", section="impact", group="personal", parent=None, document=None):
    return (i, text, text.split(".")[0], level, section, "case", group, False, "gov", "policy", "unknown", parent, document if document is not None else i)


def ask(i, motion, side=None, judge=None, group=None, theory=None, arguments=None, submodules=None, top=None, own=None, concepts=None):
    return (i, motion, side, judge, group, theory, arguments, submodules, top, own, concepts)


def run(spark, asked, chunks, semantic, reps=()):
    return requests.retrieve(
        spark.createDataFrame(asked, REQUEST), spark.createDataFrame(chunks, CHUNK),
        spark.createDataFrame(semantic, "request_id long, ordinal int, doc_id long, score double"), spark.createDataFrame(list(reps), "member long, representative long"),
    )


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def corpus(rng, n=60):
    words = "trade tariff growth poverty investment farm crop climate impact harm security war power economy jobs market price regulation ban school".split()
    out = []
    for i in range(n):
        level = "argument" if i % 3 == 0 else "submodule"
        text = ". ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() for _ in range(rng.randrange(1, 5))) + "."
        out.append(chunk(i, text, level, rng.choice(["impact", "link", "solvency", "standards", "kritik"]), rng.choice(["personal", "past_case", "other"]), i - i % 3 if i % 3 else None, i % 7))
    return out


def test_many_requests_equal_each_alone(spark):
    rng = random.Random(9)
    chunks = corpus(rng)
    asked = [
        ask(1, "THW regulate trade", "gov", "flay"), ask(2, "This House Would ban war", "neg", group="personal", arguments=2, submodules=3), ask(3, "theory interpretation of trade", theory=True),
        ask(4, "nothing known here zzz"), ask(5, "THP growth", "opp", top=6, own=["investment poverty"], concepts=["climate"]),
    ]
    semantic = [(a[0], o, rng.randrange(60), round(rng.uniform(0.1, 0.95), 3)) for a in asked[:3] + asked[4:] for o in range(4) for _ in range(25)]
    reps = [(m, m - m % 10) for m in range(60) if m % 10 in (3, 4)]
    whole = run(spark, asked, chunks, semantic, reps)
    got, stats, queries = whole.selected.cache(), whole.statistics.cache(), whole.queries.cache()
    assert got.count() > 20
    for a in asked[:2]:
        alone = run(spark, [a], chunks, [s for s in semantic if s[0] == a[0]], reps)
        assert rows(alone.selected) == rows(got.where(F.col("request_id") == a[0]))
        assert rows(alone.statistics) == rows(stats.where(F.col("request_id") == a[0]))
    s = {r["request_id"]: r.asDict() for r in stats.collect()}
    n = {(r["request_id"], r["level"]): r["n"] for r in got.groupBy("request_id", "level").agg(F.count("*").alias("n")).collect()}
    assert s[4]["merged_candidates"] == 0 and s[4]["warnings"] == ["No archive material met the minimum relevance and eligibility rules."]
    assert n[2, "argument"] <= 2 and n[2, "submodule"] <= 3 and n[5, "argument"] == 1 and n[5, "submodule"] <= 5
    for k, x in s.items():
        assert x["merged_candidates"] == x["hydrated_candidates"] >= x["ineligible_candidates"] + x["below_relevance_threshold"] + x["redundant_candidates_suppressed"]
        assert n.get((k, "argument"), 0) == x["full_arguments_returned"] and n.get((k, "submodule"), 0) == x["submodules_returned"]
        # at most 18 answers count for each of the request's queries
        assert x["semantic_hits"] <= 18 * 4
    members = {m for m, _ in reps}
    assert not members & {r["doc_id"] for r in got.collect()}
    five = [r["text"] for r in queries.where("request_id = 5").orderBy("ordinal").collect()]
    assert five[:3] == ["growth", "investment poverty", "growth climate"]
    for r in got.where("level = 'argument'").collect():
        assert r["children"] == [r["doc_id"] + 1, r["doc_id"] + 2]


def test_a_copy_is_returned_as_its_representative(spark):
    chunks = [chunk(1, "Trade lowers prices for all."), chunk(2, "Trade lowers prices for all!"), chunk(3, "Schools need books and teachers.")]
    got = run(spark, [ask(1, "THW trade")], chunks, [(1, 0, 2, 0.95), (1, 0, 1, 0.80), (1, 0, 3, 0.5)], [(2, 1), (1, 1)])
    assert [(r["doc_id"], r["pick"]) for r in got.selected.orderBy("pick").collect()][0] == (1, 1)
    s = got.statistics.first()
    assert s["duplicate_candidates_suppressed"] == 1 and s["merged_candidates"] == 2


def test_a_submodule_that_repeats_its_argument_is_suppressed(spark):
    text = "Trade lowers prices for poor families because imports compete with local goods."
    chunks = [chunk(1, text), chunk(2, text.upper(), "submodule", parent=1), chunk(3, "Prices fall when tariffs end, as a study of ten ports found.", "submodule", parent=1)]
    got = run(spark, [ask(1, "THW trade"), ask(2, "THW trade")], chunks, [(q, 0, d, 0.9) for q in (1, 2) for d in ((1, 2, 3) if q == 1 else (2, 3))])
    by = {(r["request_id"], r["doc_id"]): r["level"] for r in got.selected.collect()}
    # the second request's searches also find the argument by its words
    s = {r["request_id"]: r for r in got.statistics.collect()}
    assert by[1, 1] == "argument" and (1, 2) not in by and by[1, 3] == "submodule"
    assert s[1]["redundant_candidates_suppressed"] == 1


def test_repeating_equals_all_pairs(spark):
    rng = random.Random(2)
    base = "the plan lowers the price of corn for farmers in the south while it keeps food safe and cheap for all who live in towns"
    texts = [base, base + ".", base[:-1], base.replace("corn", "maize"), "", None, "short", "Short!", "ab", "ba", "other words entirely that say something else about war"]
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = rng.choice("abcdé xyz")
        texts.append("".join(t))
    subs = [(1, i, t) for i, t in enumerate(texts)] + [(2, i, t) for i, t in enumerate(texts)]
    args = [(1, base), (1, "short"), (2, "BA"), (2, texts[12]), (2, None)]
    got = {tuple(r) for r in retrieval.repeating(spark.createDataFrame(subs, "request_id long, doc_id long, text string"), spark.createDataFrame(args, "request_id long, text string")).collect()}
    norm = {t: r for t, r in ((x[0], x[1]) for x in spark.createDataFrame([(t,) for t in {*texts, *[a for _, a in args]} if t], "t string").select("t", T.normalized(F.col("t"))).collect())}
    of = lambda t: norm[t] if t else ""
    assert got == {(q, i) for q, i, t in subs if any(q == r and similarity(of(t), of(a)) >= 0.98 for r, a in args)}
    assert 2 < len(got) < len(subs) / 2


def test_repeating_takes_its_threshold(spark):
    subs = spark.createDataFrame([(1, 1, "taxes on corn fell"), (1, 2, "taxes on corn fall"), (1, 3, "ships sail")], "request_id long, doc_id long, text string")
    args = spark.createDataFrame([(1, "taxes on corn fell")], "request_id long, text string")
    near = similarity("taxes on corn fall", "taxes on corn fell")
    found = lambda threshold: {r["doc_id"] for r in retrieval.repeating(subs, args, threshold).collect()}
    assert found(near) == {1, 2} and found(near + 1e-6) == {1}
