from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, longest, least, top):
    """rows: (text, lang). All phrases are counted, without pruning."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and held[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in held):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def fast(spark, docs, **kw):
    return sorted(tuple(r) for r in phrases.collocations(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    rng = random.Random(8)
    words = ["a", "B", "c", "D", "\u00c9t\u00e9", "\u6f22", "e\x0b", "it's"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \t ", "...", "x " * 700, "one two three four five six " * 60, "a\r\nb\x0cc"]
    return [(t, rng.choice(["en", "de", None, "und"])) for t in texts]


@pytest.mark.parametrize("limits", [{}, {"RUN": 8, "OCCURRENCES": 50, "WORDS": 3}, {"RUN": 8, "BROADCAST": 0}])
def test_equals_counting_all_phrases(spark, docs_of, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(phrases, k, v)
    rows = corpus()
    docs = docs_of([(i, *r) for i, r in enumerate(rows)])
    for kw in ({"longest": 5, "least": 4, "top": 10_000}, {"longest": 3, "least": 12, "top": 5}):
        got = fast(spark, docs, **kw)
        assert got == slow(rows, **kw) and got


def test_empty_tables_and_nothing_frequent(spark, docs_of):
    assert fast(spark, docs_of([])) == []
    assert fast(spark, docs_of([(1, "a b c"), (1, "a b c"), (2, None)])) == []
    assert fast(spark, docs_of([(1, "a a"), (2, "b.b")]), least=2) == []


def test_counts_beyond_64_bits(spark, docs_of, monkeypatch):
    # a million million of everything: 1000 * a * n passes 2^64
    big = 10**12
    real = phrases.frequent_groups

    def scaled(*args):
        totals, levels = real(*args)
        at = phrases.F
        return totals.withColumn("n", at.col("n") * big), [x.withColumn("f", at.col("f") * big).withColumn("heads", at.transform("heads", lambda y: y * big)).withColumn("tails", at.transform("tails", lambda y: y * big)) for x in levels]

    docs = docs_of([(i, "alpha beta gamma") for i in range(5)])
    plain = fast(spark, docs, least=2)
    monkeypatch.setattr(phrases, "frequent_groups", scaled)
    assert [(r[2], r[3] // big, r[7]) for r in fast(spark, docs, least=2)] == [(r[2], r[3], r[7]) for r in plain]


def test_the_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir.replace('0.001', '0.01')}/documents.parquet'")
    want = db.sql(queries.oracle_sql()["op11_phrases"])
    got = queries.op11_phrases(spark, sf_dir.replace("0.001", "0.01"))
    rows = sorted(want.fetchall())
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == rows and rows
