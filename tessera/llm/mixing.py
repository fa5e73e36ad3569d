"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source is wanted target / source_size times: the whole part of that ratio is taken
outright, the fraction is an inclusion probability. The cube method moves the probabilities of a source
along directions in which neither the expected tokens nor the expected documents change (the null space
of those two constraints; three documents at a time have one such direction), until a coordinate
becomes 0 or 1. A sorted stream of documents is decided with three held at a time; what is left of a
block, two documents at most, meets the rest of other blocks on the next level. On the last level the
few that are left land: the rounding that misses the tokens least is taken.

Documents of more than a thousandth of their source (fewer than a thousand) are decided first, the
largest before the others, and the ratio of those that follow makes up for what they miss. Ids and
sizes are shuffled, texts are not. Blocks go by hash of the id, and random numbers by block, so that
reruns agree however the input is dealt out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.groups import ordinals

from .common import materialize, ship

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: A document of more than this share of its source is decided before the others.
GIANT = 1000
#: Documents of a block on average; the next level has at most two of each.
BLOCK = 1024
SEED = 20
#: Probabilities this close to 0 or 1 are rounding errors of sums of doubles.
EPS = 1e-9


def words(text: Column) -> Column:
    """Number of words, runs of anything but blank and the ASCII controls that break lines or columns."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds sid, the place by code point (null last), and target; sources: source, source_size, one row each.

    The weights repeat along that order and share all words. A target stops at repeats times its source's
    words, and the rest share what is left by weight, until none is above: the driver learns three
    sums a round, and a round stops at least one source more. Sources without words get 0.
    """
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("name"))
    ranked = ordinals(sources.withColumn("_key", key).withColumn("_all", F.lit(0)), "_all", "_key", "sid").drop("_key", "_all")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * repeats
    r = ranked.agg(F.lit(0).alias("n"), F.lit(0).alias("held"), F.sum("weight").alias("w")).first()
    stopped, whole, shared = -1, total, 0
    while r["n"] != stopped:
        stopped, whole, shared = r["n"], total - (r["held"] or 0), r["w"] or 0
        # weight * whole / shared reaches most; without a division
        above = F.col("weight") * F.lit(whole).cast("decimal(38,0)") >= most.cast("decimal(28,0)") * F.lit(shared)
        r = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
    share = F.col("weight") * F.lit(float(whole)) / F.lit(float(shared or 1)) if shared else most
    return ranked.withColumn("target", F.least(most.cast("double"), share.cast("double")))


def step(units: list[list], rng: random.Random) -> None:
    """Moves the probabilities (unit[1]) of three units along the null space of tokens and documents until one is whole; size is unit[0]."""
    (a, *_), (b, *_), (c, *_) = units
    u = (b - c, c - a, a - b)
    if not any(u):
        u = (1, -1, 0)
    up = min((1 - x[1]) / v if v > 0 else x[1] / -v for x, v in zip(units, u, strict=True) if v)
    down = min(x[1] / v if v > 0 else (1 - x[1]) / -v for x, v in zip(units, u, strict=True) if v)
    move = up if rng.random() * (up + down) < down else -down
    for x, v in zip(units, u, strict=True):
        x[1] = min(1.0, max(0.0, x[1] + move * v))
        x[1] = 0.0 if x[1] < EPS else 1.0 if x[1] > 1 - EPS else x[1]


def land(units: list[list]) -> None:
    """Rounds the last units so that tokens are missed least, then documents, then by order."""
    choices = [[x >> k & 1 for k in range(len(units))] for x in range(1 << len(units))]
    miss = lambda c: (abs(sum(u[0] * (k - u[1]) for u, k in zip(units, c, strict=True))), abs(sum(k - u[1] for u, k in zip(units, c, strict=True))))
    for u, k in zip(units, min(choices, key=miss), strict=True):
        u[1] = float(k)


def settle(units: list[tuple], target: float, size: float, repeats: int, rng: random.Random) -> list[int]:
    """Times that each of a few documents is taken, sizes descending, so that (size of all, target) is kept as well as it can.

    Documents are decided by classes of sizes within a factor of two. Each class lands before the next, whose
    ratio makes up for the miss, so that in the end no more is missed than a small document, or the rest makes up for it.
    """
    taken, at = [0] * len(units), 0
    while at < len(units):
        to = at
        while to < len(units) and 2 * units[to] > units[at]:
            to += 1
        to = max(to, at + 1)
        ratio = min(float(repeats), max(0.0, target / size)) if size > 0 else 0.0
        base = math.floor(ratio + EPS)
        pi = max(0.0, ratio - base)
        held: list[list] = []
        for k in range(at, to):
            taken[k] = base
            if EPS <= pi <= 1 - EPS:
                held.append([units[k], pi, k])
                if len(held) == 3:
                    step(held, rng)
                    for x in held:
                        taken[x[2]] += x[1] == 1.0
                    held = [x for x in held if 0 < x[1] < 1]
        land(held)
        for x in held:
            taken[x[2]] += x[1] == 1.0
        target -= sum(n * u for n, u in zip(taken[at:to], units[at:to], strict=True))
        size -= sum(units[at:to])
        at = to
    return taken


def giants(rows: DataFrame, repeats: int) -> DataFrame:
    """(sid, doc_id, size, base, pi): rows above a GIANT-th of their source, decided. rows: sid, doc_id, size, source_size, target.

    A source has fewer than GIANT of them, which are held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done, kind = None, [], [], pa.int64()

        def close() -> None:
            if held:
                sid, _, _, whole, target = held[0]
                for r, n in zip(held, settle([r[2] for r in held], target, whole, repeats, random.Random(f"{SEED} giants {sid}")), strict=True):
                    done.append((sid, r[1], r[2], n, 0.0))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), kind, pa.int64(), pa.int64(), pa.float64()), strict=True)], KEPT)

        for b in batches:
            kind = b.column(1).type
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[0] != at:
                    close()
                    at = r[0]
                held.append(r)
            yield batch()
        close()
        yield batch()

    kind = dict(rows.dtypes)["doc_id"]
    dealt = rows.select("sid", "doc_id", "size", "source_size", "target").repartition("sid").sortWithinPartitions("sid", F.desc("size"), "doc_id")
    return dealt.mapInArrow(run, f"sid long, doc_id {kind}, size long, base long, pi double")


KEPT = ["sid", "doc_id", "size", "base", "pi"]


def flight(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Decides documents of each block: rows come back with pi 0 or 1, at most two of a block with what it was left at.

    rows: sid, doc_id, size, base, pi, block. A block is a sorted stream of which three documents are held,
    so its length doesn't matter. last: the two that are left land.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rng, done = None, [], None, []

        def close() -> None:
            if last:
                land(held)
            done.extend(held)
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*[(*x[2], x[1]) for x in done], strict=True)) if done else [[] for _ in KEPT]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], KEPT)

        kinds = None
        for b in batches:
            kinds = [b.column(k).type for k in range(5)]
            for sid, doc_id, size, base, pi, block in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (sid, block) != at:
                    close()
                    at, rng = (sid, block), random.Random(f"{SEED} {level} {sid} {block}")
                unit = [size, pi, (sid, doc_id, size, base)]
                if pi < EPS or pi > 1 - EPS:
                    unit[1] = float(round(pi))
                    done.append(unit)
                    continue
                held.append(unit)
                while len(held) == 3:
                    step(held, rng)
                    done.extend(x for x in held if x[1] in (0.0, 1.0))
                    held[:] = [x for x in held if 0 < x[1] < 1]
            if done:
                yield batch()
        close()
        if done:
            yield batch()

    kinds = dict(rows.dtypes)
    # large documents first, so that what is left over at the end of a block is small where it can be
    dealt = rows.select(*KEPT, "block").repartition("sid", "block").sortWithinPartitions("sid", "block", F.desc("size"), "doc_id", "pi")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in KEPT))


def decided(rows: DataFrame, sources: DataFrame, most: int, tag: str) -> DataFrame:
    """Rows (sid, doc_id, size, base, pi) with pi 0 or 1, level by level. sources: sid, n (rows); most: the largest n."""
    level, parts = 0, []
    blocks = lambda n, k: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK) / F.lit((BLOCK / 2) ** k))).cast("long")
    rows = rows.join(sources.select("sid", F.col("n").alias("_n")), "sid")
    while True:
        many = max(1, math.ceil(most / BLOCK / (BLOCK / 2) ** level))
        block = F.pmod(F.xxhash64(F.lit(f"{tag} {level}"), "doc_id", "size"), blocks(F.col("_n"), level))
        flown = materialize(flight(rows.withColumn("block", block), level, many == 1), f"flown-{tag}")
        whole = F.col("pi").isin(0.0, 1.0)
        parts.append(flown.where(whole))
        if many == 1:
            break
        rows, level = flown.where(~whole).join(sources.select("sid", F.col("n").alias("_n")), "sid"), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split(rows: DataFrame, ratio: Column) -> DataFrame:
    """(sid, doc_id, size, base, pi): the whole part of a ratio and its fraction."""
    whole = F.floor(ratio + EPS).cast("long")
    return rows.select("sid", "doc_id", "size", whole.alias("base"), F.greatest(F.lit(0.0), ratio - whole).alias("pi"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row; docs: doc_id, text, source; other columns are ignored.

    taken is a whole multiple of size, at most repeats times it. A source's taken words miss its target by about
    a thousandth of its words at most, or, where it has few documents, by about half of a small one. Null texts have size 0 and are taken 0 words; a null source is a source. Repeated
    rows are documents of their own. Empty tables give no rows.
    """
    ship(docs.sparkSession)
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(targets(sums, weights, repeats), "targets")
    named = sources.select("sid", F.col("source").alias("_source"), "source_size", "target")
    rows = materialize(sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "doc_id", "size", "source_size", "target"), "rows")
    giant = F.col("size") * GIANT > F.col("source_size")
    first = materialize(giants(rows.where(giant), repeats), "giants")
    taken = (F.col("base") + F.col("pi").cast("long")) * F.col("size")
    got = first.groupBy("sid").agg(F.sum(taken).alias("_taken"), F.sum("size").alias("_size"))
    rest = rows.where(~giant).join(got, "sid", "left")
    left = F.col("source_size") - F.coalesce("_size", F.lit(0))
    ratio = F.when(left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(repeats)), (F.col("target") - F.coalesce("_taken", F.lit(0))) / left))).otherwise(0.0)
    counts = materialize(rows.where(~giant).groupBy("sid").agg(F.count("*").alias("n")), "counts")
    others = decided(split(rest, ratio), counts, counts.agg(F.max("n")).first()[0] or 0, "rest")
    return first.unionByName(others).join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", taken.alias("taken"))
