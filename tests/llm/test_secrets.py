"""Secret scans against a plain version, on odd and on very long texts."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.common import table

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def rnd(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def slow_base(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def slow_spans(t, ratios, threshold=12.0):
    base = slow_base(t)
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        ratio = sum(ratios[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:], strict=False))
        if len(m[0]) >= 16 and ratio >= threshold and not any(b < m.end() and m.start() < e for b, _, e in base):
            found.append((m.start(), 3, m.end()))
    return sorted(base + found)


def slow_redacted(t, spans, mark="[secret]"):
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += t[at:start] + mark
        at = max(at, end)
    return out + t[at:]


def mixed(rng, n):
    parts, size = [], 0
    while size < n:
        x = rng.choice([rnd(rng, 20), "password=" + rnd(rng, 9), "deadbeef" * 3, "words of prose é🎉", "AKIA" + "ABCD1234" * 2, "internationalizationof", "0" * 24 + "api_key=hunter22", "\x01.token: " + rnd(rng, 4) + ".", "AKIA" + "12" * 14 + "abc"])
        parts.append(x)
        size += len(x) + 1
    return rng.choice((" ", "", ".")).join(parts)


def learned(docs_of):
    rng = random.Random(2)
    return secrets.train(docs_of([(i, f"the internationalization of understanding otherwise considerations token={rnd(rng, 30)}") for i in range(200)]))


def test_spans_and_redaction_equal_a_plain_version(docs_of):
    rng = random.Random(5)
    rows = [(i, mixed(rng, n)) for i, n in enumerate([1, 20, 60, 100, 200, 300, 500, 900, 2000, 6000] * 3)]
    rows += [(90, ""), (91, None), (92, rnd(rng, 70_000)), (93, " " * 5000), (94, "token=" + "a" * 300_000)]
    ratios = learned(docs_of)
    df = docs_of(rows + rows[:1])
    got = secrets.scan(df, ratios).collect()
    assert len(got) == len(rows) + 1
    texts = {k: t or "" for k, t in rows}
    for r in got:
        t = texts[r["doc_id"]]
        assert [tuple(s) for s in r["base"]] == slow_base(t)
        assert [tuple(s) for s in r["spans"]] == slow_spans(t, ratios)
    for r in secrets.redact(df, ratios=ratios).collect():
        t = dict(rows)[r["doc_id"]]
        assert r["text"] == (None if t is None else slow_redacted(t, slow_spans(t, ratios)))


def test_spans_on_the_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.train(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in secrets.scan(docs, ratios).collect():
        assert [tuple(s) for s in r["spans"]] == slow_spans(texts[r["doc_id"]], ratios)


def test_time_grows_with_length_not_its_square(docs_of):
    ratios, rng = learned(docs_of), random.Random(1)

    def seconds(n):
        df = docs_of([(1, mixed(rng, n)), (2, rnd(rng, n))]).repartition(1)
        began = time.perf_counter()
        df = secrets.redact(df, ratios=ratios).agg(F.sum(F.length("text"))).collect()
        return time.perf_counter() - began

    seconds(1000)
    short, long = seconds(300_000), seconds(3_000_000)
    assert long < 30 * max(short, 1.0)


def test_small_inputs(docs_of):
    assert secrets.redact(docs_of([])).collect() == []
    assert secrets.find(docs_of([])).collect() == []
    assert [len(r["spans"]) for r in secrets.find(docs_of([(1, None), (1, None), (None, "")])).collect()] == [0, 0, 0]
