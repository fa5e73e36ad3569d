from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def slow(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 1024) for x in v], label, tuple(v)) for i, v, label in kept]
    if not kept:
        return []
    d = max(parts, -(-max(len(v) for _, v, *_ in kept) // parts) * parts)
    w = d // parts
    kept = [(i, v + [0] * (d - len(v)), label, raw) for i, v, label, raw in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [defaultdict(list) for _ in range(parts)]
        for _, v, *_ in kept:
            for p in range(parts):
                x = v[p * w : p * w + w]
                got[p][best(p, x)[1]].append(x)
        for p in range(parts):
            for k, xs in got[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, label_error = [], defaultdict(int)
    for i, v, label, _ in kept:
        found = [best(p, v[p * w : p * w + w]) for p in range(parts)]
        error = sum(e for e, _ in found)
        label_error[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    whole = {label: None if any(e >= 1 << 63 for _, _, e, o in out if o == label) else s for label, s in label_error.items()}
    return [(i, c, fits(e), fits(whole[label]) if whole[label] is not None else None, sha) for i, c, e, label in out]


def fast(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    return [tuple(r) for r in codes.compress(df, **kw).collect()]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(a, b):
    assert sorted(a, key=key) == sorted(b, key=key)


@given(st.lists(st.lists(st.integers(-50, 50), min_size=5, max_size=5), min_size=1, max_size=40), st.lists(st.lists(st.integers(-50, 50), min_size=5, max_size=5), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_nearest_is_exact_with_ties_to_the_lower_entry(xs, es):
    x, e = np.array(xs), np.array(es)
    i, d = codes.nearest(codes.transform(x), codes.transform(e))
    plain = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (d == 8 * plain.min(axis=1)).all() and (i == plain.argmin(axis=1)).all()


def test_transform_is_in_sequency_order_and_scales_squares():
    h = codes.transform(np.eye(8, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in h] == list(range(8))
    assert (h @ h.T == 8 * np.eye(8)).all()


def test_equals_plain_loops_with_bad_rows_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.001, 1.0, -0.0004]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[5], rows[5], (None, [0.5] * 8, None), (90, None, 1), (91, [None] + [0.0] * 7, 1), (92, [math.nan] + [0.0] * 7, 1), (93, [math.inf] * 8, 2)]
    same(fast(spark, rows, entries=16), slow(rows, entries=16))
    same(fast(spark, rows), slow(rows))


def test_ragged_huge_and_empty(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 30]) for _ in range(rng.choice([6, 7]))], i % 2) for i in range(30)]
    same(fast(spark, rows, entries=8), slow(rows, entries=8))
    same(fast(spark, [(1, [], None), (2, [0.5], None)]), slow([(1, [], None), (2, [0.5], None)]))
    assert fast(spark, []) == [] and fast(spark, [(1, None, None)]) == []


def test_the_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = db.sql(queries.oracle_sql()["op13_vector_codes"])
    got = queries.op13_vector_codes(spark, sf_dir)
    same([tuple(r) for r in got.select(*want.columns).collect()], want.fetchall())


@pytest.mark.parametrize("kw", [{"entries": 257}, {"scale": 1000}])
def test_refuses_what_it_cannot_code(spark, kw):
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([], SCHEMA), **kw)
