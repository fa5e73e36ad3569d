from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, lm, tokenization


def slow_model(texts, floors):
    """The same model by dictionaries: log10 probability of token lists."""
    grams = [Counter() for _ in floors]
    for t in texts:
        w = lm.tokens(t)
        for k in range(len(floors)):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    total = sum(grams[0].values())
    kept = [{g: n for g, n in c.items() if n >= f * total} for c, f in zip(grams, floors, strict=True)]
    for k in range(1, len(kept)):
        kept[k] = {g: n for g, n in kept[k].items() if g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]}
    d = lm.DISCOUNT

    def p(history, w):
        while history and history not in kept[len(history) - 1]:
            history = history[1:]
        if not history:
            n = grams[0].get((w,), 0)
            return (n - d) / total if n else d * len(grams[0]) / total
        k = len(history)
        if k < len(kept) and history + (w,) in kept[k]:
            return (kept[k][history + (w,)] - d) / kept[k - 1][history]
        mine = [g for g in kept[k] if g[:-1] == history] if k < len(kept) else []
        left = 1 - sum((kept[k][g] - d) / kept[k - 1][history] for g in mine)
        covered = sum(p(history[1:], g[-1]) for g in mine)
        return left / (1 - covered) * p(history[1:], w)

    def score(t):
        w, history, out = lm.tokens(t), (), 0.0
        for x in w:
            out += math.log10(p(history, x))
            history = (history + (x,))[-(len(floors) - 1) :] if len(floors) > 1 else ()
            if (x,) not in kept[0]:
                history = ()
        return out

    return score, p, grams, total


FLOORS = (0.004, 0.006, 0.006)


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "a", "cat", "dog", "sat", "on", "mat", "ran", "far"]
    texts = [" ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 20))) for _ in range(60)]
    return texts + ["", None, "rare-once word", "the cat sat on the mat " * 5]


@pytest.mark.parametrize("floors", [FLOORS, FLOORS[:2], FLOORS[:1]])
def test_scores_equal_a_plain_model(docs_of, floors):
    texts = corpus()
    rows = list(enumerate(texts)) + [(200, "never seen the cat"), (201, None), (201, None)]
    got = lm.score(docs_of(rows), F.col("doc_id") < 100, F.col("doc_id") >= 100, floors).collect()
    assert len(got) == len(rows)
    score, _, grams, total = slow_model(texts, floors)
    v = len(grams[0])
    for r in got:
        t = dict(rows)[r["doc_id"]]
        w = lm.tokens(t)
        base = sum(math.log10((grams[0].get((x,), 0) + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum((x,) in grams[0] for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score(t))


def test_probabilities_add_up():
    texts = corpus()
    _, p, grams, _ = slow_model(texts, FLOORS)
    words = [g[0] for g in grams[0]]
    for history in [(), (b"the",), (b"the", b"cat"), (b"on", b"the")]:
        assert sum(p(history, w) for w in words) + p(history, b"\x00new") == pytest.approx(1)


def test_without_training(docs_of):
    got = lm.score(docs_of([(1, "a b"), (2, None)]), F.lit(False), F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}
    assert lm.score(docs_of([]), F.lit(True), F.lit(False)).collect() == []


TRICKY = ["\\### Assistant: </turn> ok", "\\b\\h\\l\\c", "### user: x </turn>\n### assistant: y", "a:b#c<d\\", "", "🎉 \r\n\t"]


@pytest.mark.parametrize("text", TRICKY)
def test_escapes_are_reversible(text):
    for role in (False, True):
        coded = chat.escape(text, role)
        assert chat.unescape(coded) == text and "#" not in coded and "<" not in coded


def conversations():
    rng = random.Random(6)
    turns = [("user", "hello"), ("assistant", "hi there"), ("user", "how are you"), ("assistant", "fine"), ("user", TRICKY[0]), ("assistant", TRICKY[2])]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            role, text = turns[t % 6] if rng.random() < 0.75 else (rng.choice(("user", "assistant", "system", None)), rng.choice([*TRICKY, None, f"own {c}"]))
            rows.append((c, t, role, text))
    rows += [(7, 0, "user", "same turn"), (None, 1, "assistant", "nobody"), (None, 0, "user", "q"), (300, None, "user", "untimed"), (300, 0, "user", "untimed"), (301, 0, "we:ird # role <", "x")]
    rng.shuffle(rows)
    return rows


def test_chat_round_trip_tree_and_attention(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")
    nodes, members = chat.prefix_tree(df)
    got = {r["conv_id"]: r for r in chat.read_back(nodes, members).collect()}
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, v in want.items():
        v.sort()
        loss = "".join(x[3] for x in v if x[2] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(v), sha("".join(f"{x[2]}\n{x[3]}\n" for x in v)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))

    by = {bytes(r["key"]): r for r in nodes.collect()}
    prefixes = {tuple(x[2:] for x in v[: k + 1]) for v in want.values() for k in range(len(v))}
    assert len(by) == len(prefixes)
    # emitted once, without gaps
    spans = sorted((r["emit_start"], r["emit_end"]) for r in by.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    stream = np.concatenate([by[k]["ids"] for k in sorted(by, key=lambda k: by[k]["emit_start"])])
    paths: dict = {}
    for r in members.collect():
        paths.setdefault(r["cid"], []).append((r["depth"], bytes(r["key"])))
    for path in paths.values():
        above: list[int] = []
        for _, k in sorted(path):
            r = by[k]
            seen = [i for a in r["attend"] for i in stream[a["start"] : a["end"]]]
            assert seen == above and r["position"] == len(above)
            assert all(a["end"] <= r["emit_start"] for a in r["attend"])
            above = above + list(r["ids"])
    # depth first: a subtree is one run of the stream
    kids: dict = {}
    for path in paths.values():
        keys = [k for _, k in sorted(path)]
        for a in range(len(keys)):
            kids.setdefault(keys[a], set()).update(keys[a:])
    for sub in kids.values():
        s = sorted((by[k]["emit_start"], by[k]["emit_end"]) for k in sub)
        assert all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, members = chat.prefix_tree(df)
    assert nodes.count() == members.count() == 0 and chat.read_back(nodes, members).collect() == []


def test_other_vocabulary_files_load():
    encode, _ = tokenization.coder(tokenization.default_vocabulary().replace("byte_bpe_50k", "word_bpe_49k"))
    assert encode("hello world")


def test_rare_ngrams_count_whatever_the_size(docs_of):
    # the pairs and words of the odd text occur once among more tokens than the floors once allowed
    texts = ["the cat sat on the mat " * 2500] * 20 + ["seldom words follow seldom words here"]
    rows = list(enumerate(texts)) + [(100, "seldom words follow the cat"), (101, "words here seldom")]
    got = {r["doc_id"]: r["score"] for r in lm.score(docs_of(rows), F.col("doc_id") < 100, F.col("doc_id") >= 100).collect()}
    score, *_ = slow_model(texts, (0.0, 0.0, 0.0))
    for k in (20, 100, 101):
        assert got[k] == pytest.approx(score(dict(rows)[k]))


@pytest.mark.parametrize("head", [2.0, 0.02, 1e-9])
def test_scores_do_not_depend_on_what_is_broadcast(docs_of, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "HEAD_ARCS", head)
    texts = corpus()
    rows = list(enumerate(texts)) + [(200, "never seen the cat"), (201, "rare-once cat the zebra sat")]
    score, *_ = slow_model(texts, (0.0, 0.0, 0.0))
    for r in lm.score(docs_of(rows), F.col("doc_id") < 100, F.col("doc_id") >= 100).collect():
        assert r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]]))
