from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dedupe, lexical, retrieval, rounds, store, structure, validation, vectors
from tessera.sources import files
from tessera.streaming import telemetry


def test_match_parser():
    m = lexical.parse_match('"free trade" econ* Café')
    assert (m.words, m.phrases, m.prefixes) == (("cafe",), (("free", "trade"),), ("econ",))
    with pytest.raises(ValueError):
        lexical.parse_match("!!! ''")


def test_bm25_ranks_the_rarer_and_denser_first(spark):
    docs = spark.createDataFrame([(1, "corn corn corn"), (2, "corn and wheat and rye"), (3, "rice"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "corn"), (0, "corn")], "query_id long, term string")
    got = [r["doc_id"] for r in lexical.top_k(lexical.bm25(docs, q), 5).orderBy("rank").collect()]
    assert got == [1, 2]


def test_snippet(spark):
    t = spark.createDataFrame([("one two three corn, four five",)], "t string")
    assert t.select(lexical.snippet(F.col("t"), "corn", 2)).first()[0] == "…two three [corn,] four…"


def test_filters_refuse_unknown_columns():
    with pytest.raises(ValueError):
        vectors.equal({"nope": 1}, ("label",))


def test_nearest_filters_before_the_limit(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 1), (3, [0.0, 1.0], 1), (4, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r["vec_id"] for r in vectors.nearest(q, v, 2, vectors.equal({"label": 1}, ("label",))).orderBy("rank").collect()] == [2, 3]


def test_sync_plan(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "id string, fingerprint string")
    b = spark.createDataFrame([("y", "2"), ("z", "0"), ("w", "9")], "id string, fingerprint string")
    assert dict(vectors.sync_plan(a, b).collect()) == {"x": "new", "y": "current", "z": "changed", "w": "stale"}


def test_upsert_keeps_times_of_unchanged_rows(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    old = spark.createDataFrame([(1, None, t(1), t(1)), (2, "a", t(1), t(1)), (3, "k", t(1), t(1))], "k long, v string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([(1, None), (2, None), (4, "n")], "k long, v string")
    got = {r["k"]: (r["v"], r["updated_at"].second, r["change"]) for r in store.upsert_changed(old, new, "k", F.lit(t(9))).collect()}
    assert got == {1: (None, 1, "unchanged"), 2: (None, 9, "updated"), 3: ("k", 1, "kept"), 4: ("n", 9, "inserted")}


def test_set_null_and_repeated_keys(spark):
    kids = spark.createDataFrame([(1, 10), (2, 20)], "k long, p long")
    parents = spark.createDataFrame([(10,)], "id long")
    assert sorted(store.set_null(kids, parents, "p", "id").select("k", "p").collect()) == [(1, 10), (2, None)]
    assert store.repeated_keys(spark.createDataFrame([(1,), (1,), (None,)], "k long"), "k").count() == 2


def test_contains_text_is_literal(spark):
    d = spark.createDataFrame([("a_b",), ("axb",), ("50%",)], "t string")
    assert [r["t"] for r in d.where(store.contains_text(F.col("t"), "A_B")).collect()] == ["a_b"]
    assert d.where(store.contains_text(F.col("t"), "%")).count() == 1


def test_competition_rank_shares_ties(spark):
    s = spark.createDataFrame([("a", 9), ("b", 7), ("c", 9), ("d", 1)], "id string, total int")
    assert {r["id"]: r["rank"] for r in validation.competition_rank(s, "total", "id").collect()} == {"a": 1, "c": 1, "b": 3, "d": 4}


def test_alike_equals_all_pairs(spark):
    texts = ["a b c d", "a b c e", "x y", "x y z", "q"]
    d = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert {(r["first_id"], r["second_id"]) for r in validation.alike(d, 0.6).collect()} == want


def test_quotes(spark):
    s = spark.createDataFrame([(1, "He said:  free\ntrade helps.")], "source_id long, text string")
    q = spark.createDataFrame([(1, "Free trade"), (1, "costs"), (2, "free")], "source_id long, quote string")
    assert sorted((r["quote"], r["held"]) for r in validation.quotes_within(q, s).collect()) == [("Free trade", True), ("costs", False), ("free", False)]


def test_judges(spark):
    notes = [(1, "I'm a flow judge. No theory please"), (2, "I am not a tech judge"), (3, "lay\nflow"), (4, "no theory unless abusive"), (5, None)]
    got = {r["note_id"]: (r["category"], r["source"], r["exclude_theory"]) for r in rounds.judged(spark.createDataFrame(notes, "note_id long, text string")).collect()}
    assert got == {1: ("flow", "notes", True), 2: (None, "none", False), 3: (None, "conflict", False), 4: (None, "none", False), 5: (None, "none", False)}


def test_canonical_urls(spark):
    urls = ["HTTPS://Ex.COM?utm_x=1&a=2#f", "http://localhost/x", "http://u:p@h.com/", "ftp://h.com", "http://10.0.0.1/", "http://h.com/a b", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(rounds.canonical_url(F.col("u"))).collect()]
    assert got == ["https://ex.com/?a=2", None, None, None, None, None, None]


def test_published(spark):
    d = spark.createDataFrame([("2024-05-06T01:00:00Z",), ("Mon, 06 May 2024 10:00:00 GMT",), ("soon",)], "v string")
    assert [str(r[0]) for r in d.select(rounds.published(F.col("v"))).collect()] == ["2024-05-06", "2024-05-06", "None"]


def test_headings_and_sections(spark):
    lines = ["Advantage 1: Growth", "Uniqueness", "Growth is low now.", "Link: Plan helps", "It raises investment.", "DISADVANTAGE", "a. first point", "Text that is a sentence."]
    blocks = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(lines)], "doc_id long, pos int, text string, style_level int")
    found = structure.detected(blocks).where("heading is not null")
    assert [(r["pos"], r["section_type"], r["method"]) for r in found.orderBy("pos").collect()] == [(0, "advantage", "keyword"), (1, "uniqueness", "keyword"), (3, "link", "keyword"), (5, "disadvantage", "keyword"), (6, "subpoint", "numbered")]
    forest = structure.sections(found)
    assert [(r["section_id"], r["parent_id"], r["level"]) for r in forest.orderBy("pos").collect()] == [
        ("1:section:0001", None, 1), ("1:section:0002", "1:section:0001", 2), ("1:section:0003", "1:section:0001", 2), ("1:section:0004", None, 1), ("1:section:0005", "1:section:0004", 2),
    ]
    body = structure.bodies(blocks, forest)
    got = structure.argument_chunks(forest, body).toPandas()
    assert sorted(got["chunk_level"]) == ["argument", "argument", "submodule", "submodule", "submodule"]
    link = got[got["section_type"] == "link"].iloc[0]
    assert link["text"] == "Advantage 1: Growth\n\nLink: Plan helps\n\nIt raises investment." and list(link["places"]) == [0, 3, 4]
    whole = got[(got["section_type"] == "advantage") & (got["chunk_level"] == "argument")].iloc[0]
    assert whole["text"] == "Advantage 1: Growth\n\nUniqueness\n\nGrowth is low now.\n\nLink: Plan helps\n\nIt raises investment."
    assert link["parent_chunk_id"] == whole["chunk_id"] and link["argument_heading"] == link["parent_heading"] == "Advantage 1: Growth"


def test_windows_and_packing(spark):
    d = spark.createDataFrame([(1, " ".join(["w"] * 1000)), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["first_token"], r["n_tokens"]) for r in chunking.windows(d).orderBy("doc_id", "window").collect()]
    assert got == [(1, 0, 450), (1, 405, 450), (1, 810, 190), (2, 0, 1)]
    with pytest.raises(ValueError):
        chunking.Settings(10, 10)
    blocks = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d"), (1, 2, "e f g h"), (2, 0, "x")], "doc_id long, pos int, text string")
    got = [(r["doc_id"], r["text"], r["tokens"]) for r in chunking.packed(blocks, chunking.Settings(5, 1)).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, "a b c\nd", 4), (1, "d\ne f g h", 5), (2, "x", 1)]


def test_diversity_prefers_another_section(spark):
    rows = [(0, 1, 0.9, "a b c", "link", "p", 1), (0, 2, 0.89, "a b c", "link", "p", 1), (0, 3, 0.85, "x y z", "impact", "q", 2)]
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string, section_type string, parent string, document long")
    assert [r["doc_id"] for r in retrieval.diversified(pool, 2).orderBy("pick").collect()] == [1, 3]


def test_diversity_equals_a_plain_greedy_choice(spark):
    rng = random.Random(4)
    words = ["growth", "trade", "harm", "court", "river", "plan", "vote", "tax"]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    rows = [(0, k, round(rng.random(), 3), base[k % 6] + (" more" if k % 4 else ""), rng.choice(["Link", "link", "impact"]), rng.choice(["p", "q", None]), k % 5) for k in range(40)]
    s = retrieval.Settings()

    def penalty(r, chosen):
        worst = 0.0
        for c in chosen:
            worst = max(worst, s.same_parent if r[5] and r[5] == c[5] else 0, s.same_document if r[6] == c[6] else 0)
            if (like := dedupe.similarity(r[3], c[3])) >= 0.82:
                worst = max(worst, (like - 0.82) / 0.18 * 0.12)
        return round(worst + s.repeated_function * min(2, sum(c[4].lower() == r[4].lower() for c in chosen)), 6)

    left, chosen = list(rows), []
    while len(chosen) < 12:
        best = min(left, key=lambda r: (-(r[2] - penalty(r, chosen)), r[1]))
        left.remove(best)
        chosen.append(best)
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string, section_type string, parent string, document long")
    assert [r["doc_id"] for r in retrieval.diversified(pool, 12).orderBy("pick").collect()] == [r[1] for r in chosen]


def test_nearest_in_tiles_equals_one_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, vectors.nearest(q, v, 5).collect()))
    monkeypatch.setattr(vectors, "PROBES", 7)
    monkeypatch.setattr(vectors, "TILE", 11)
    assert sorted(map(tuple, vectors.nearest(q, v, 5).collect())) == want


def test_ranks_across_partitions(spark):
    rows = [(i, float(i * 7 % 50)) for i in range(200)] + [(900, None)]
    got = {r["k"]: r["rank"] for r in validation.competition_rank(spark.createDataFrame(rows, "k long, t double"), "t", "k").collect()}
    assert len(got) == 201 and got[900] == 201
    assert all(got[k] == 1 + sum(u > t for _, u in rows if u is not None) for k, t in rows if t is not None)


def test_generated_queries(spark):
    r = spark.createDataFrame([(1, "THW ban corn imports", "gov")], "request_id long, motion string, side string")
    got = [(x["family"], x["text"]) for x in retrieval.generated_queries(r).orderBy("ordinal").collect()]
    assert got[0] == ("full_motion", "ban corn imports") and len(got) <= 7
    assert [f for f, _ in got].count("mechanism") == 2


def test_eligibility(spark):
    c = spark.createDataFrame([("other", "standards", "case", False), ("personal", "kritik", "case", False), ("other", "claim", "case", False)], "source_group string, section_type string, document_type string, is_special boolean")
    r = retrieval.Request(motion="m")
    assert [x[0] for x in c.select(retrieval.eligibility(r)).collect()] == ["non-personal theory excluded", "kritik not eligible for judge/context", "ok"]
    asked = retrieval.Request(motion="m", intents=("theory",))
    assert c.select(retrieval.eligibility(asked)).collect()[2][0] == "non-theory material excluded from theory retrieval"


def test_files(spark, tmp_path):
    root = tmp_path / "library"
    for name, data in {"Personal Files/a.txt": b"one\ntwo", "Past Cases/b.MD": "caf\xe9".encode("cp1252"), "x/c.csv": b"1", "x/~$d.docx": b"lock", "x/e.docx": b"bad", "x/f.txt": b"a\0b"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    found = files.discovered(spark, str(root))
    assert {r["relative"].rpartition("/")[2]: r["status"] for r in found.collect()} == {"a.txt": "ok", "b.MD": "ok", "c.csv": "unsupported", "~$d.docx": "lock_file", "e.docx": "ok", "f.txt": "ok"}
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    got = {(r["path"].rpartition("/")[2], r["status"]) for r in files.parsed(read).collect()}
    assert ("a.txt", "ok") in got and ("b.MD", "ok") in got and ("e.docx", "failed") in got and ("f.txt", "failed") in got and ("c.csv", "unsupported") in got
    g = spark.createDataFrame([(["lib", "Personal Files", "x"],), (["Non-Personal Files"],), (["z"],)], "f array<string>").select(files.source_group(F.col("f"))).collect()
    assert [r[0] for r in g] == ["personal", "other", "other"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 20, 5), i % 3, "click", 1.0, "{}") for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    telemetry.run_once(spark, str(tmp_path / "in"), "*.parquet", e.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and closed <= {tuple(r) for r in telemetry.windowed(e).collect()}


def slow_sections(rows):
    """rows: (style, kind, outline) of a document's headings, in order. Levels, wanted levels and parents by recursion over ancestors."""
    out = []
    # the families of the rules: a type is first a child of theory, then of a kritik, then of a case
    def accepted(kind):
        families = ((structure.THEORY_CHILDREN, {"theory_shell"}), (structure.KRITIK_CHILDREN, {"kritik", "advantage", "disadvantage", "contention"}), (structure.CASE_CHILDREN, {"advantage", "disadvantage", "contention", "kritik"}))
        return next((parents for kinds, parents in families if kind in kinds), set())

    for style, kind, outline in rows:
        line, at = [], (len(out) - 1 if out else None)
        while at is not None:
            line.append(at)
            at = out[at][0]
        parent = next((a for a in line if out[a][3] in accepted(kind)), None) if outline is None else None
        if outline is not None:
            want = next((out[a][1] for a in line if out[a][3] != "subpoint"), 0) + outline
        elif parent is not None:
            want = out[parent][1] + 1
        elif style is not None:
            want = style
        elif kind == "heading" and line and out[line[0]][3] != "heading":
            want = out[line[0]][1] + 1
        else:
            want = 1
        if parent is None:
            parent = next((a for a in line if out[a][1] < want), None)
        level = want if parent is None else min(want, out[parent][1] + 1)
        out.append((parent, level, want, kind))
    return out


def test_sections_by_brute_force(spark):
    rng = random.Random(4)
    kinds = ["heading", "subpoint", "advantage", "kritik", "theory_shell", "link", "impact", "standards", "answer", "framework", "claim", "turn"]
    rows = []
    for d in range(60):
        for i in range(rng.randrange(1, 25)):
            kind = rng.choice(kinds)
            rows.append((d, i, rng.choice([None, None, 1, 2, 3, 5]), kind, f"h{i}", rng.choice([1, 2, 3]) if kind == "subpoint" or rng.random() < 0.1 else None))
    found = spark.createDataFrame(rows, "doc_id long, pos int, level int, section_type string, heading string, outline int")
    got = {}
    for r in structure.sections(found).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((None if r["parent_id"] is None else int(r["parent_id"][-4:]) - 1, r["level"], r["wanted"], r["section_type"]))
    for d in range(60):
        assert got[d] == slow_sections([(r[2], r[3], r[5]) for r in rows if r[0] == d]), d


def test_two_headings_with_four_children_each_give_ten_chunks(spark):
    blocks, i = [], 0
    for top in ("Advantage 1: Access", "Disadvantage: Costs"):
        blocks.append((1, i, top, 1))
        i += 1
        for child in ("Uniqueness", "Link", "Internal Link", "Impact"):
            blocks += [(1, i, child, 2), (1, i + 1, f"A paragraph about {child.lower()} that says what it is.", None)]
            i += 2
    b = spark.createDataFrame(blocks, "doc_id long, pos int, text string, style_level int")
    forest = structure.sections(structure.detected(b).where("heading is not null"))
    got = structure.argument_chunks(forest, structure.bodies(b, forest)).collect()
    assert len(got) == 10 and sorted(r["chunk_level"] for r in got) == ["argument"] * 2 + ["submodule"] * 8


def test_outlines_have_titles_orphans_and_remarks(spark):
    rows = [(1, 0, "before anything", None, False), (1, 1, "# Whole Case:", None, False), (1, 2, "Advantage 1", None, False), (1, 3, "1. first point", None, False), (1, 4, "ii. deep point.", None, False), (1, 5, "Some Words", None, True), (2, 0, "a. begins low", None, False), (3, 0, "nothing here at all, just a sentence.", None, False)]
    b = spark.createDataFrame([(*r, f"stem{r[0]}") for r in rows], "doc_id long, pos int, text string, style_level int, bold boolean, stem string")
    found = structure.detected(b)
    said = {(r["doc_id"], r["pos"]): (r["method"], r["detection"]) for r in found.where("heading is not null").collect()}
    assert said == {(1, 1): ("style", "markdown_heading"), (1, 2): ("keyword", "debate_keyword"), (1, 3): ("numbered", "numbering"), (1, 4): ("numbered", "numbering"), (1, 5): ("formatted", "formatted_short_line:bold"), (2, 0): ("numbered", "numbering")}
    forest = structure.sections(found.where("heading is not null"))
    got = {r["doc_id"]: r for r in structure.outlines(b, found, forest, F.col("stem")).collect()}
    assert [(got[d]["title"], got[d]["sections"], got[d]["orphans"]) for d in (1, 2, 3)] == [("Whole Case", 5, 1), ("stem2", 1, 0), ("stem3", 0, 1)]
    assert got[1]["remarks"] == ["Heading at source block 4 jumped from level 2 to 4; normalized to level 3.", "1 non-empty source block(s) precede any detected heading."]
    assert got[2]["remarks"] == ["Heading at source block 0 begins at level 2 without a detected parent; preserved as a root."]
    assert got[3]["remarks"][-1].startswith("No reliable debate structure") and got[3]["confidence"] == 0.0


def test_round_types_and_http_categories(spark):
    motions = ["THW ban x", "this house would y", "THP a", "This House Regrets b", "THBT c", "This House Believes That d", "THO e", "THWx f", None]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in motions], "m string").select(rounds.round_type(F.col("m"))).collect()]
    assert got == ["policy", "policy", "value", "value", "unknown", "unknown", "unknown", "unknown", "unknown"]
    codes = [400, 401, 403, 404, 429, 500, 503, 418, 200, None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c int").select(rounds.http_category(F.col("c"))).collect()]
    assert got == ["invalid_request", "authentication", "permission", "model_unavailable", "rate_limit_or_quota", "server_error", "server_error", "provider_error", None, None]


def test_nearest_with_null_zero_and_tied_vectors_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    vecs = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [0.0] * 4), (902, [1e-30, 0.0, 0.0, 0.0])]
    probes = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(7)] + [(50, [0.0] * 4)]
    v, q = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").repartition(3), spark.createDataFrame(probes, "query_id long, query array<float>")

    def cos(a, b):
        a, b = a or [0.0] * 4, b or [0.0] * 4
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 4) if n > 1e-200 else 0.0

    for k in (1, 5, 400):
        want = [(i, *x, r) for i, p in probes for r, x in enumerate(sorted(((d, cos(p, e)) for d, e in vecs), key=lambda x: (-x[1], x[0]))[:k], 1)]
        got = sorted((tuple(r) for r in vectors.nearest(q, v, k).collect()), key=lambda r: (r[0], r[3]))
        assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))
    monkeypatch.setattr(vectors, "PROBES", 3)
    again = sorted(tuple(r) for r in vectors.nearest(q, v.where("embedding is not null"), 5).collect())
    monkeypatch.setattr(vectors, "PROBES", 4096)
    assert again == sorted(tuple(r) for r in vectors.nearest(q, v.where("embedding is not null"), 5).collect())
    assert vectors.nearest(q, v.where("false"), 5).count() == 0 and vectors.nearest(q.where("false"), v, 5).count() == 0


def test_nearest_of_copies_holds_only_the_best_and_odd_lengths_count_whole():
    probes = vectors.matrix(pa.chunked_array([pa.array([[1.0, 0.0, 0.0], [0.0, 2.0, 0.0]])]), 3)
    v = vectors.matrix(pa.chunked_array([pa.array([[1.0, 1.0]] * 5000 + [[3.0, 0.0, 4.0], None, [1.0, None]])]), 3)
    sims, at = vectors.best_of(probes, v, 3)
    # equal vectors by number, a third component counts for the length
    assert at.tolist() == [[5002, 0, 1], [0, 1, 2]] and sims[0].tolist() == [1.0, 0.7071, 0.7071]
    assert vectors.best_of(probes, v[:2], 3)[1].tolist() == [[0, 1, -1], [0, 1, -1]]


def test_nearest_of_many_queries_multiplies_matrices(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PROBES", 5)
    v = spark.range(40).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding")
    plan = vectors.nearest(v.selectExpr("vec_id AS query_id", "embedding AS query"), v, 3)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_self_descriptions_of_judges(spark):
    texts = ["flow", "judge: flow", "\u00a0I am a flow judge", "I am a\u000bflow judge", "I'm a flow judge\u00df", "I am a flow judges", None]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")
    said = lambda **k: [r["category"] for r in rounds.judged(notes, **k).orderBy("note_id").collect()]
    assert said(labelled=False) == [None, None, "flow", None, "flow", None, None]
    assert said()[:2] == ["flow", "flow"]


def test_totals_do_not_depend_on_how_rows_are_dealt_out(spark):
    rows = [(k, i, random.Random(i).randrange(10**7) / 100) for k in range(3) for i in range(40)]
    want = {k: _in_order(x for c, _, x in rows if c == k) for k in range(3)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "k long, i long, x double").repartition(parts)
        assert {r["k"]: r["total"] for r in validation.totals_in_order(df, "k", "x", ["i"]).collect()} == want


def _in_order(values):
    total = 0.0
    for x in values:
        total += x
    return total


def test_unsupplied_citations_are_told_by_one_aggregation(spark):
    kind = "owner long, item long"
    cited = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (None, 5), (3, None), (3, None), (4, 1)], kind)
    supplied = spark.createDataFrame([(1, 10), (2, 11), (None, 5), (3, None), (4, 1), (4, 1), (9, 9)], kind)
    got = validation.unsupplied(cited, supplied, "owner", "item")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 11), (2, 10), (None, 5), (3, None)]))
