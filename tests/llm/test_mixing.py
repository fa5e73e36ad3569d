from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mixing, queries


def slow_targets(sizes, weights=(5, 2, 1), repeats=3):
    """sizes: source -> words; exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in held]
        w = sum(weight[s] for s in rest)
        left = total - sum(repeats * sizes[s] for s in held)
        got = {s: Fraction(repeats * sizes[s]) if s in held else Fraction(weight[s] * left, w) for s in order}
        above = {s for s in rest if got[s] > repeats * sizes[s]}
        if not above:
            return got
        held |= above


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def held(spark, rows, near):
    """rows: (doc_id, text, source). Checks all that the contract fixes; near: share of a source's words that may be missed."""
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, source string, taken string, target double")
    got = mixing.mix(df).collect()
    want = defaultdict(int)
    for _, t, s in rows:
        want[s] += n_words(t)
    targets = slow_targets(want) if rows else {}
    size = {}
    for d, t, s in rows:
        size.setdefault(d, []).append((n_words(t), s))
    taken, by = defaultdict(int), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for d, found in by.items():
        assert sorted(r["size"] for r in found) == sorted(n for n, _ in size[d])
        for r in found:
            s = next(s for n, s in size[d] if n == r["size"] and want[s] == r["source_size"])
            assert r["target"] == pytest.approx(float(targets[s]), rel=1e-12)
            taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s in want:
        assert abs(taken[s] - targets[s]) <= max(near * want[s], 1), (s, taken[s], float(targets[s]), want[s])
    again = mixing.mix(df.repartition(7)).collect()
    order = lambda x: sorted(map(str, x))
    assert order(got) == order(again)


def test_small_and_odd_tables(spark):
    held(spark, [], 0)
    held(spark, [(1, None, None), (2, "", "a"), (3, "  \t\n", "b")], 0)
    held(spark, [(1, "a b c", None)], 0.5)
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 5}" if i % 6 else None) for i in range(400)]
    held(spark, rows + rows[:40] + [(None, "x y", "s1"), (7, "other text of this id", "s1")], 0.05)


def test_long_documents_are_made_up_for(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([10, 30, 90]), rng.choice("abcdef")) for i in range(1500)]
    rows += [(10_000 + i, "w " * 4000, s) for i, s in enumerate("abcdef")]
    held(spark, rows, 0.005)


def test_hot_source_over_many_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "GIANT", 50)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), "hot" if rng.random() < 0.6 else rng.choice("abcd")) for i in range(2500)]
    held(spark, rows, 0.02)


def test_documents_are_balanced_too(spark):
    rows = [(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for (s, of), found in by_source(mixing.mix(df).collect(), rows).items():
        ratio = found[0]["target"] / found[0]["source_size"]
        copies = sum(r["taken"] // r["size"] for r in found)
        assert abs(copies - ratio * of) <= 6, (s, copies, ratio * of)


def by_source(got, rows):
    source = {d: s for d, _, s in rows}
    out = defaultdict(list)
    for r in got:
        out[source[r["doc_id"]]].append(r)
    return {(s, len(x)): x for s, x in out.items()}


@given(st.lists(st.tuples(st.integers(0, 60), st.floats(0.01, 0.99)), min_size=3, max_size=3), st.integers())
@settings(max_examples=300, deadline=None)
def test_a_step_keeps_both_totals_and_ends_at_a_bound(units, seed):
    x = [[a, p] for a, p in units]
    mixing.step(x, random.Random(seed))
    assert any(p in (0.0, 1.0) for _, p in x)
    assert sum(p for _, p in x) == pytest.approx(sum(p for _, p in units), abs=1e-6)
    assert sum(a * p for a, p in x) == pytest.approx(sum(a * p for a, p in units), abs=1e-5)


def test_steps_keep_probabilities_on_average():
    rng, n, took = random.Random(1), 20_000, [0.0, 0.0, 0.0]
    for _ in range(n):
        x = [[3, 0.2], [7, 0.5], [11, 0.9]]
        mixing.step(x, rng)
        took = [t + p for t, (_, p) in zip(took, x, strict=True)]
    assert [t / n for t in took] == pytest.approx([0.2, 0.5, 0.9], abs=0.01)


@given(st.dictionaries(st.one_of(st.none(), st.text("abé\U0001f389", max_size=3)), st.integers(0, 1000), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]), rel=1e-12)


def test_the_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = defaultdict(int)
    for _, t, s in docs:
        want[s] += n_words(t)
    targets, of = slow_targets(want), {d: s for d, _, s in docs}
    got, taken = queries.op12_mixing(spark, sf_dir).collect(), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in docs)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == want[s] and r["target"] == pytest.approx(float(targets[s]), rel=1e-12)
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - targets[s]) <= 0.02 * want[s], (s, taken[s], float(targets[s]), want[s])
