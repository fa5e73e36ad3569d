from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.common import small_table, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text: str, size: int = 3) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", "one", "One TWO", "a b c d", "a b c a b c", "é É x\ty\u000bz", " ".join(f"w{i % 700}" for i in range(2000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    want = simhash.fingerprint(TEXTS[-1])
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(TEXTS[-1]) == want


def slow_components(fps: dict[int, int]) -> dict[int, int]:
    name = {k: k for k in fps}
    again = True
    while again:
        again = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and name[a] > name[b]:
                    name[a], again = name[b], True
    return name


def test_links_find_all_within_two_bits(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) * rng.randrange(2)
            values.add(x)
        values.add(x ^ 0b111)  # three bits away
    fps = dict(enumerate(sorted(values)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps.values()]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    groups: dict[int, int] = {}
    got = {}
    for k, (s,) in enumerate(signed):
        root = roots.get(s, s)
        got[k] = groups.setdefault(root, k)
    assert got == slow_components(fps)


def test_near_duplicates(docs_of):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long), (3, long), (9, long + " more"), (1, ""), (2, None), (4, "  \t"), (7, "alone here"), (None, long), (None, "nobody else")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    zero = "0" * 16
    assert of[1, zero] == of[2, zero] == of[4, zero] == 1
    f = f"{slow_fingerprint(long):016x}"
    assert of[5, f] == of[3, f] == of[None, f] == 3
    assert of[None, f"{slow_fingerprint('nobody else'):016x}"] is None
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_deduplicate_keeps_one_row_of_each_component(docs_of):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "x y z x y z q"), (None, "a b c d e f"), (1, None), (2, "")]
    got = simhash.deduplicate(docs_of(rows))
    assert got.columns == docs_of(rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, None), (3, "a b c d e f"), (8, "x y z x y z q")]


def test_texts_are_named_once_in_the_last_step(docs_of):
    df = simhash.deduplicate(docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("EvalPython|MapInArrow", plan)) == 1
    assert sorted(r["doc_id"] for r in df.collect()) == [1, 3]


def test_small_tables_need_no_python_workers(spark):
    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.IntegerType())])
    for rows in ([], [(1, 2), (3, None)]):
        df = small_table(spark, rows, kind)
        assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("a", "bigint"), ("b", "int")]
        assert "RDD" not in df._jdf.queryExecution().sparkPlan().toString()


def test_deduplicate_equals_brute_force_on_near_copies(docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(150, 400))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy = copy[: len(copy) // 2]  # half of it is no near copy
            rows.append((rng.randrange(10**6), " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.lower().split()]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    assert {r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()} == want


def test_a_large_group_of_near_copies_leaves_one(docs_of):
    rng = random.Random(10)
    base = [f"longword{i}" for i in range(300)]
    rows = []
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = f"changedword{k}"
        rows.append((k, " ".join(copy)))
    assert [r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()] == [0]


def test_deduplicate_loses_no_pair_near_the_threshold(docs_of):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10)))
    rows, passage = [], [word() for _ in range(60)]
    for k in range(40):  # an added passage leaves 0.78 to 0.92
        base = [word() for _ in range(300)]
        at = rng.randrange(300)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:at] + [word() for _ in range(rng.randint(24, 80))] + base[at:]))]
    chain = [word() for _ in range(200)]
    for k in range(14):  # each is near the next only
        rows.append((200 + k, " ".join(chain)))
        chain = chain[18:] + [word() for _ in range(18)]
    for k in range(12):  # one passage in common is no likeness
        rows.append((300 + k, " ".join([word() for _ in range(100)] + passage)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    assert {r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()} == want


def kept_by_brute_force(rows, size=5, similarity=0.8):
    """Least ids of the components of all pairs, by inverted lists of shingles."""
    units = {}
    for d, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER_AZ).split()
        units.setdefault(tuple(w), []).append(d)
    names = list(units)
    sets = [{u[i : i + size] for i in range(max(1, len(u) - size + 1))} for u in names]
    lists = {}
    for k, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(k)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x] if j < k)
        for j, c in common.items():
            if c / (len(s) + len(sets[j]) - c) >= similarity:
                parent[root(k)] = root(j)
    least = {}
    for k, u in enumerate(names):
        least[root(k)] = min(least.get(root(k), math.inf), *units[u])
    return sorted(least.values())


def test_pairs_in_one_vocabulary_of_many_orders(docs_of):
    """Thirty pairs of near copies, all over the same words: every pair is found, nothing else."""
    rng = random.Random(3)
    vocabulary, rows = [f"w{i}" for i in range(200)], []
    for k in range(30):
        words = rng.sample(vocabulary, 200)
        swapped = list(words)
        at = rng.randrange(199)
        swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(swapped))]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()) == list(range(0, 60, 2)) == kept_by_brute_force(rows)


def test_deduplicate_on_the_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == kept_by_brute_force(rows)


def test_a_very_long_text(docs_of):
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(200_000))
    got = simhash.deduplicate(docs_of([(2, long), (1, long + " end"), (3, "short")])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]


def test_units_are_linked_by_fingerprint(spark):
    """Units of one fingerprint or within two bits are compared, others are not."""
    units = spark.createDataFrame([(0, 0b0), (1, 0b11), (2, 0b0), (3, 0b1111), (4, 0b11111 << 20), (5, -(1 << 63))], "id long, fp long")
    pairs = {(r["a"], r["b"]) for r in simhash.linked_units(units).collect()}
    assert all(a < b for a, b in pairs) and {x for p in pairs for x in p} == {0, 1, 2, 3, 5}
    assert (0, 2) in pairs and (1, 3) in pairs and (0, 3) not in pairs


def test_deduplicate_compares_what_simhash_links(spark, docs_of, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "linked_units", lambda units, f=simhash.linked_units: asked.append(f(units).count()) or f(units))
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (2, "far away")]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()) == [0, 2]
    assert asked == [1]
