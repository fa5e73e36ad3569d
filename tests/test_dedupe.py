from __future__ import annotations

import hashlib
import itertools
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.jobs import catalogue
from tessera.operators import dedupe, groups
from tessera.operators.graph import components


def chunks(spark, texts, level="argument"):
    return spark.createDataFrame([(f"c{i:04d}", t, level, "advantage", "other", 8) for i, t in enumerate(texts)], "chunk_id string, text string, chunk_level string, section_type string, source_group string, token_count int")


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert dedupe.lcs(a, b) == slow_lcs(a, b)


@given(st.text("abc ", max_size=60), st.text("abc ", max_size=60), st.integers(0, 120), st.sampled_from([1, 4, 64]))
@settings(max_examples=300, deadline=None)
def test_bands_count_indels_up_to_a_limit(a, b, most, band):
    d = len(a) + len(b) - 2 * slow_lcs(a, b)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dedupe, "BAND", band)
        assert dedupe.indels(a, b, most) == (d if d <= most else None)


def test_texts_far_apart_are_refused_without_comparing_places(monkeypatch):
    def profiles(t):
        return dedupe.profile(t, (1, 2, 4)) + dedupe.profile(" ".join(sorted(t.split())), (2, 4))

    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(400))
    a, b = text("abcdefghij"), text("abcdefghik")
    near = " ".join([*a.split()[:100], *a.split()[101:200], "edited", *a.split()[201:]])
    assert dedupe.similar(a, near, 0.92, profiles) == dedupe.similarity(a, near) > 0.98
    assert dedupe.similar(a, near, dedupe.similarity(a, near), profiles) == dedupe.similarity(a, near)
    assert dedupe.similar(a, near, dedupe.similarity(a, near) + 0.001, profiles) is None
    monkeypatch.setattr(dedupe, "banded", lambda *_: pytest.fail("compared"))
    assert dedupe.similar(a, b, 0.92, profiles) is None


def test_texts_are_taken_apart_once_for_many_comparisons():
    rng = random.Random(4)
    base = "".join(rng.choice("abcdé 日本") for _ in range(900))
    dedupe.places.cache_clear()
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randrange(1, 40)):
            t[rng.randrange(len(t))] = rng.choice("abcx\U0001f600")
        a = "".join(t)
        d = len(a) + len(base) - 2 * dedupe.lcs(a, base)
        assert dedupe.indels(a, base, d) == d and dedupe.indels(a, base, d - 1) is None
    assert dedupe.places.cache_info().misses == 1
    assert {ch: bits for ch, bits in dedupe.places("abca").items()} == {"a": 0b1001, "b": 0b10, "c": 0b100}


def test_similarity_bounds():
    words = [f"word{i}" for i in range(100)]
    near = words[:50] + ["changed"] + words[51:]
    assert dedupe.similarity("", "") == 1 and dedupe.similarity("a", "") == 0
    assert 0.95 < dedupe.similarity(" ".join(words), " ".join(near)) < 1


def test_exact_groups_and_id(spark):
    got = dedupe.exact_groups(chunks(spark, ["Same, text here!", "same text here", "other"])).collect()
    assert [(r["members"], r["first_member"]) for r in got] == [(2, "c0000")]
    assert got[0]["duplicate_group_id"] == "dup_" + hashlib.sha256(b"c0000|c0001").hexdigest()[:16]


def test_representative_prefers_the_whole_text_and_then_the_least_id(spark):
    c = chunks(spark, ["same text...", "Same text", "same  text"])
    assert dedupe.representatives(c).first()["representative"] == "c0001"


def test_blocking_compares_few_of_many_distinct_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6):06d}x" for _ in range(20)) for _ in range(300)]
    assert dedupe.candidate_pairs(dedupe.units(chunks(spark, texts))).count() < 300


def slow_groups(rows, settings=dedupe.Settings()):
    """Units in groups by the definition: all accepted candidates from the greatest, merged if every cross pair is accepted.

    rows: (uid, norm, kind, numbers); candidates: pairs of ids that blocking brings together.
    """
    units, candidates = rows
    of = {u: (norm, kind, tuple(nums)) for u, norm, kind, nums in units}
    seen = {}

    def fits(a, b):
        (x, kind, m), (y, _, n) = of[a], of[b]
        need = max(settings.fallback_threshold if kind == "fallback" else settings.threshold, settings.updated_statistic_threshold if m != n else 0)
        seen[a, b] = seen[b, a] = dedupe.similarity(x, y)
        return min(len(x), len(y)) / max(len(x), len(y), 1) >= settings.length_ratio and seen[a, b] >= need

    group = {u: [u] for u in of}
    for _, a, b in sorted(((dedupe.similarity(of[a][0], of[b][0]), a, b) for a, b in candidates), reverse=True):
        if group[a] is not group[b] and all(fits(*sorted(p)) for p in itertools.product(group[a], group[b])):
            group[a].extend(group[b])
            for u in group[b]:
                group[u] = group[a]
    out = []
    for g in {id(g): sorted(g) for g in group.values()}.values():
        if len(g) > 1:
            all_pairs = [dedupe.similarity(of[a][0], of[b][0]) for a, b in itertools.combinations(g, 2)]
            out += [(u, g[0], round(min(all_pairs), 4), round(max(all_pairs), 4)) for u in g]
    return sorted(out)


def inputs(c, settings=dedupe.Settings()):
    u = dedupe.units(c)
    rows = [(r["uid"], r["norm"], r["kind"], r["numbers"]) for r in u.select("uid", "norm", "kind", dedupe.T.numbers(dedupe.F.col("text")).alias("numbers")).collect()]
    return rows, [tuple(r) for r in dedupe.candidate_pairs(u, settings).collect()]


def test_near_groups_need_every_pair(spark):
    base = [f"token{i:03d}" for i in range(100)]
    a, b, c = list(base), list(base), list(base)
    for i in range(8):
        b[i] = f"bbbbbb{i}"
        c[i + 50] = f"cccccc{i}"
    # a is near b and near c, b and c are not near
    x = chunks(spark, [" ".join(t) for t in (a, b, c)])
    got = sorted(tuple(r) for r in dedupe.near_groups(x).collect())
    assert len(got) == 2 and got == slow_groups(inputs(x))


@pytest.mark.parametrize("links", [1000, 12])
def test_near_groups_equal_the_sequential_fold(spark, monkeypatch, links):
    monkeypatch.setattr(dedupe, "LINKS", links)
    rng, texts = random.Random(11), []
    for family in range(4):
        base = [f"{rng.choice('bcdfg')}{family}{rng.randrange(10**5):05d}x" for _ in range(60)]
        for _ in range(9):  # copies drift apart; some changes tie exactly
            t = list(base)
            for i in rng.sample(range(60), rng.choice([1, 2, 3, 5])):
                t[i] = f"z{rng.randrange(100):02d}{t[i][3:]}" if rng.random() < 0.5 else f"edit{i % 10}"
            texts.append(" ".join(t))
            if rng.random() < 0.3:
                base = t
    texts += [texts[0] + " 2024", texts[0] + " 2025", texts[1].upper(), texts[2] + "!"]
    for level in ("argument", "fallback"):
        x, wide = chunks(spark, texts, level).cache(), dedupe.Settings(anchor_share=0.3)
        got = sorted(tuple(r) for r in dedupe.near_groups(x, wide).collect())
        want = slow_groups(inputs(x, wide))
        assert got == want and (level == "fallback" or len({r[1] for r in want}) > 3)


def families() -> list[str]:
    rng, texts = random.Random(5), []
    for family in range(3):
        base = [f"{rng.choice('bcdfg')}{family}{rng.randrange(10**5):05d}x" for _ in range(50)]
        for _ in range(7):
            t = list(base)
            for i in rng.sample(range(50), rng.choice([1, 2, 4])):
                t[i] = f"edit{i % 10}"
            texts.append(" ".join(t))
    return texts


def test_components_are_folded_without_rounds(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(dedupe, "LINKS", 5)
    monkeypatch.setattr(dedupe, "materialize", lambda df, name, real=dedupe.materialize: taken.append(name) or real(df, name))
    x, wide = chunks(spark, families()).cache(), dedupe.Settings(anchor_share=0.4)
    got = sorted(tuple(r) for r in dedupe.near_groups(x, wide).collect())
    assert got == slow_groups(inputs(x, wide)) and "folded" not in taken


def test_large_components_are_folded_by_rounds(spark, monkeypatch):
    x, wide = chunks(spark, families()).cache(), dedupe.Settings(anchor_share=0.4)
    want = slow_groups(inputs(x, wide))
    monkeypatch.setattr(dedupe, "WHOLE_CHARS", 0)
    assert sorted(tuple(r) for r in dedupe.near_groups(x, wide).collect()) == want


def test_fold_whole_asks_for_pairs_that_blocking_missed():
    pairs = [(0.99, "a", "b", True), (0.98, "b", "c", True), (0.97, "c", "d", True), (None, "b", "d", False)]
    fold = lambda near, **k: dedupe.fold_whole(pairs, lambda f, g: near.get((f, g)), k.get("possible", lambda f, g: True))
    at, asked = fold({("a", "c"): 0.95})
    assert at["a"] == at["b"] == at["c"] and at["d"] == "d" and asked == [(0.95, "a", "c")]
    at, asked = fold({})
    assert at["a"] == at["b"] and at["c"] == at["d"] != at["a"] and asked == []
    assert fold({("a", "c"): 0.95}, possible=lambda f, g: False)[1] == []


def test_a_pair_that_blocking_missed_is_asked_for():
    link = lambda s, x, y: {"step": "link", "x": x, "y": y, "s": s, "f": x, "g": y, "n": None, "bad": None}
    size = [{"step": "size", "x": x, "n": 1} for x in "abcd"]
    known = [{"step": "known", "x": x, "y": y, "n": 1, "bad": 0} for x, y in ("ab", "bc", "cd")]
    part = pd.DataFrame([link(0.99, "a", "b"), link(0.98, "b", "c"), link(0.97, "c", "d"), *size, *known])
    got = dedupe.fold(part)
    # a and b merge; a-c is unknown, so c waits, and d waits for c
    assert [r[:3] for r in got if r[0] == "merge"] == [("merge", "b", "a")]
    assert [r[:3] for r in got if r[0] == "need"] == [("need", "a", "c")]
    assert sorted(r[4:6] + r[3:4] for r in got if r[0] == "later") == [("b", "c", 0.98), ("c", "d", 0.97)]
    bad = pd.DataFrame([*part.to_dict("records"), {"step": "known", "x": "a", "y": "c", "n": 1, "bad": 1}])
    got = dedupe.fold(bad)
    assert sorted(r[:3] for r in got) == [("merge", "b", "a"), ("merge", "d", "c")]


def test_groups_hold_copies_and_say_what_they_are(spark):
    words = [f"token{i:03d}" for i in range(60)]
    near = " ".join(words[:59] + ["changed"])
    texts = [" ".join(words), " ".join(words).upper(), near, "alone here", "twice, here", "Twice here", " ".join(words) + " 12"]
    x = chunks(spark, texts)
    members, near_rows = groups.memberships(x, dedupe.Settings(anchor_share=0.6))
    got = {}
    for r in members.collect():
        got.setdefault(r["duplicate_group_id"], []).append((r["member_index"], r["chunk_id"]))
    ids = {g: [c for _, c in sorted(m)] for g, m in got.items()}
    assert sorted(ids.values()) == [["c0000", "c0001", "c0002", "c0006"], ["c0004", "c0005"]]
    for g, m in ids.items():
        assert g == "dup_" + hashlib.sha256("|".join(m).encode()).hexdigest()[:16]
    kinds = {r["duplicate_group_id"]: r for r in groups.table_of(members, x, near_rows).collect()}
    said = {r["duplicate_group_id"]: r["notes"] for r in groups.notes(members, x).collect()}
    for g, m in ids.items():
        big = len(m) == 4
        assert kinds[g]["duplicate_type"] == ("near" if big else "exact") and kinds[g]["similarity_max"] == 1.0
        assert (kinds[g]["similarity_min"] < 1) == big
        assert said[g] == [groups.KEPT, groups.UPDATED][: 1 + big]


def test_near_groups_of_the_table(spark, sf_dir):
    got = sorted(tuple(r) for r in catalogue.near_duplicate_groups(spark, sf_dir).collect())
    assert got == slow_groups(inputs(catalogue.chunks(spark, sf_dir))) and got


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7000, 8000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    parts = sorted(sorted(g) for g in got.groupby("root")["node"].apply(list))
    assert parts == [list(range(51)), list(range(100, 140)), [7000, 8000]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
