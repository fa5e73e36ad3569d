"""Exact and near duplicates of chunks: units, blocking, scoring, complete linkage, representatives.

Chunks: chunk_id, text, chunk_level, section_type, and for representatives source_group,
token_count, freshness, year, is_special, context_depth, structure_confidence where they exist.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import components
from tessera.operators.ordering import ordinals
from tessera.tables import materialize

# Ranks of sources and of freshness; types and sections whose age doesn't matter.
SOURCE_RANK = {"personal": 3, "past_case": 2, "other": 1}
AGE_NEUTRAL_TYPES = ("theory", "kritik")
AGE_NEUTRAL_SECTIONS = (
    "alternative", "competing_interpretations", "counter_interpretation", "counter_standards", "framework", "framing",
    "impact_calculus", "interpretation", "kritik", "reasonability", "role_of_the_ballot", "standards", "theory_shell",
    "thesis", "violation", "voters",
)
FRESHNESS_RANK = {"current": 4, "possibly_stale": 3, "unknown": 2, "stale_empirics": 1, "evergreen": 2}


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.92
    fallback_threshold: float = 0.98
    updated_statistic_threshold: float = 0.97
    length_ratio: float = 0.82
    bucket_ratio: float = 1.25
    minimum_characters: int = 40
    anchors: int = 6
    anchor_share: float = 0.01  # of all units that an anchor may occur in


def compatibility(level: Column, section: Column) -> Column:
    """Arguments and fallbacks compare with their like; other chunks within their section type."""
    return F.when(level.isin("argument", "fallback"), level).otherwise(F.concat_ws("|", level, F.lower(section)))


def keyed(chunks: DataFrame) -> DataFrame:
    """Adds norm, the comparison text, and unit, the hash of it and its kind."""
    norm = T.normalized_exact(F.coalesce("text", F.lit("")))
    kind = compatibility(F.col("chunk_level"), F.col("section_type"))
    return chunks.withColumn("norm", norm).withColumn("kind", kind).withColumn("unit", F.sha2(F.concat_ws("|", "kind", "norm"), 256))


def member_digest(rows: DataFrame) -> DataFrame:
    """(unit, members, digest): count and hash of the '|'-joined ids in order; rows: unit, chunk_id.

    Rows are sorted and streamed, so a group of any size is a running hash and not a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sha = None, 0, hashlib.sha256()

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["unit", "members", "digest"])

        for b in batches:
            done = []
            for unit, cid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if unit != at:
                    if at is not None:
                        done.append((at, n, sha.hexdigest()))
                    at, n, sha = unit, 0, hashlib.sha256()
                sha.update(f"{'|' if n else ''}{cid}".encode())
                n += 1
            if done:
                yield out(done)
        if at is not None:
            yield out([(at, n, sha.hexdigest())])

    ordered = rows.select("unit", "chunk_id").repartition("unit").sortWithinPartitions("unit", "chunk_id")
    return ordered.mapInArrow(run, "unit string, members long, digest string")


def exact_groups(chunks: DataFrame) -> DataFrame:
    """(duplicate_group_id, members, first_member) of units with two chunks or more."""
    # texts are normalised once; what follows reads two short columns
    rows = materialize(keyed(chunks).select("unit", "chunk_id"), "members")
    many = rows.groupBy("unit").agg(F.min("chunk_id").alias("first_member"), F.count("*").alias("n")).where("n > 1")
    digests = member_digest(rows.join(many.select("unit"), "unit", "left_semi"))
    return digests.join(many, "unit").select(F.concat(F.lit("dup_"), F.substring("digest", 1, 16)).alias("duplicate_group_id"), "members", "first_member")


def age_neutral(c: DataFrame) -> Column:
    """Whether a chunk's age says nothing about it, by document type (where there is one) and section."""
    kind = F.coalesce("document_type", F.lit("")) if "document_type" in c.columns else F.lit("")
    return kind.isin(*AGE_NEUTRAL_TYPES) | F.lower(F.coalesce("section_type", F.lit(""))).isin(*AGE_NEUTRAL_SECTIONS)


def quality(c: DataFrame) -> list[Column]:
    """Sort keys of a representative, the best first when ascending."""
    has = lambda name, default: F.col(name) if name in c.columns else F.lit(default)
    rank = lambda table, col: F.coalesce(*[F.when(col == k, v) for k, v in table.items()], F.lit(0))
    dated = has("freshness", "unknown").isin("current", "possibly_stale", "stale_empirics")
    empirical = (dated | T.has_number(F.col("text"))) & ~age_neutral(c)
    special = ((F.col("source_group") == "personal") & has("is_special", False)).cast("int")
    keys = [
        rank(SOURCE_RANK, F.col("source_group")), special,
        F.when(empirical, F.coalesce(has("year", 0), F.lit(0))).otherwise(0),
        F.when(empirical, rank(FRESHNESS_RANK, has("freshness", "unknown"))).otherwise(0),
        (~T.truncated(F.col("text"))).cast("int"), F.col("token_count"), has("context_depth", 0), has("structure_confidence", 1.0), -T.junk_characters(F.col("text")),
    ]
    return [-k for k in keys]


def representatives(chunks: DataFrame) -> DataFrame:
    """(unit, representative, members) of units with two chunks or more; aggregated on the map side, so a hot unit stays small."""
    c = keyed(chunks)
    best = F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(quality(c))], F.col("chunk_id").alias("chunk_id")))
    return c.groupBy("unit").agg(best.alias("best"), F.count("*").alias("members")).where("members > 1").select("unit", F.col("best.chunk_id").alias("representative"), "members")


def units(chunks: DataFrame) -> DataFrame:
    """One row per distinct comparison text and kind: unit, uid (least chunk id), norm, kind, members, text of uid."""
    return keyed(chunks).groupBy("unit").agg(F.min_by(F.struct("chunk_id", "norm", "kind", "text"), "chunk_id").alias("u"), F.count("*").alias("members")).select("unit", F.col("u.chunk_id").alias("uid"), F.col("u.norm").alias("norm"), F.col("u.kind").alias("kind"), F.col("u.text").alias("text"), "members")


def document_frequency(unit_rows: DataFrame) -> DataFrame:
    """(token, df) over all units."""
    return unit_rows.select(F.explode(F.array_distinct(T.significant(F.col("norm")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def blocking_keys(unit_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(uid, kind, chars, bucket, anchor): each long enough unit under its rarest tokens and its first and last two."""
    # texts are taken apart once; what follows reads words
    tokens = T.significant(F.col("norm")).alias("tokens")
    base = materialize(unit_rows.select("uid", "kind", F.length("norm").alias("chars"), F.substring(F.sha2("norm", 256), 1, 16).alias("own"), tokens), "tokens")
    total = base.agg(F.greatest(F.lit(2), F.floor(F.count("*") * settings.anchor_share)).alias("df_limit"))
    frequency = base.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df = frequency.join(F.broadcast(total), F.col("df") <= F.col("df_limit")).drop("df_limit")
    long = base.where(F.col("chars") >= settings.minimum_characters)
    edges = F.array_union(F.slice("tokens", 1, 2), F.when(F.size("tokens") > 1, F.slice("tokens", -2, 2)).otherwise(F.col("tokens")))
    # a row knows its own first and last words, so that each of its words is sent once
    each = long.select("uid", edges.alias("edges"), F.explode(F.array_distinct("tokens")).alias("token")).select("uid", "token", F.array_contains("edges", F.col("token")).alias("edge"))
    rare = each.join(df, "token").withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("df", "token")))
    chosen = rare.where((F.col("rank") <= settings.anchors) | F.col("edge")).select("uid", F.col("token").alias("anchor"))
    keyed_ = long.join(chosen, "uid", "left").select("uid", "kind", "chars", F.coalesce("anchor", "own").alias("anchor"))
    return keyed_.withColumn("bucket", F.floor(F.log(F.greatest(F.col("chars"), F.lit(1))) / math.log(settings.bucket_ratio)).cast("int"))


def candidate_pairs(unit_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(first_id, second_id) that share kind and anchor, in equal or adjoining length buckets and of similar length."""
    # both sides read the keys, which are made once
    keys = materialize(blocking_keys(unit_rows, settings), "keys")
    left = keys.select("kind", "anchor", F.col("uid").alias("first_id"), F.col("chars").alias("c1"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = keys.select("kind", "anchor", "bucket", F.col("uid").alias("second_id"), F.col("chars").alias("c2"))
    close = F.least("c1", "c2") / F.greatest("c1", "c2") >= settings.length_ratio
    return left.join(right, ["kind", "anchor", "bucket"]).where((F.col("first_id") < F.col("second_id")) & close).select("first_id", "second_id").distinct()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of b's characters at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    rows = full
    for ch in a:
        hit = rows & where.get(ch, 0)
        rows = (rows + hit | rows - hit) & full
    return len(b) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(a: str, b: str) -> float:
    """Characters in order weigh 0.7, words in any order 0.3, of comparison texts."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    return round(0.7 * ratio(a, b) + 0.3 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 6)


@lru_cache(8)
def places(text: str) -> dict[str, int]:
    """Of each character the places where it is, as bits; a text that is compared with many is taken apart once."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(x): int.from_bytes(np.packbits(c == x, bitorder="little").tobytes(), "little") for x in np.unique(c).tolist()}


class Stretch(dict):
    """Places of characters from a place on, looked up once each."""

    def __init__(self, where: dict[str, int], start: int, full: int):
        self.where, self.start, self.full = where, start, full

    def __missing__(self, ch: str) -> int:
        self[ch] = found = self.where.get(ch, 0) >> self.start & self.full
        return found


def banded(a: str, b: str, width: int, most: int, where: dict[str, int], start: int) -> int:
    """Insertions and deletions from a to b where places that match differ by little more than width at most; over `most` it may stop early.

    where: places() of a text that has b at `start`.
    """
    step, matched, lo, hi, rows = max(256, 2 * width), 0, 0, 0, 0
    for at in range(0, len(a), step):
        # what lies below the band is settled, and what it reaches now has no match yet
        low, high = min(len(b), max(0, at - width)), min(len(b), at + step + width)
        below = low - lo
        matched += below - (rows & (1 << below) - 1).bit_count()
        rows = rows >> below | (1 << high - hi) - 1 << hi - low
        lo, hi = low, high
        full = (1 << hi - lo) - 1
        part = a[at : at + step]
        # what is carried beyond the band changes nothing in it, so it is cut off at the end
        for hit in map(Stretch(where, start + lo, full).__getitem__, part):
            if hit := rows & hit:
                rows = rows + hit | rows ^ hit
        rows &= full
        left = len(a) - at - len(part)
        least = len(a) + len(b) - 2 * (matched + hi - lo - rows.bit_count() + left)
        if least > most:
            return least
    return len(a) + len(b) - 2 * (matched + hi - lo - rows.bit_count())


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


#: Width of the least band, what the first one is wider than a lower bound, and the next than the one before.
BAND, FIRST, WIDER = 32, 2.5, 3


def indels(a: str, b: str, most: int, least: float = 0) -> int | None:
    """Least insertions and deletions from a to b, len(a) + len(b) - 2 * lcs(a, b), if they are `most` at most; they are `least` at least.

    A way of d of them strays (d + difference of lengths) / 2 places at most, so a band that holds it decides.
    """
    where, start = places(b), common(a, b)
    a, b = a[start:], b[start:]
    k = common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    apart = abs(len(a) - len(b))
    width = BAND + int(FIRST * least)
    while apart <= most:
        width = min(width, (most + apart + 1) // 2)
        d = banded(a, b, width, most, where, start)
        if d <= most and d + apart <= 2 * width:
            return d
        if most + apart <= 2 * width:
            return d if d <= most else None
        width *= WIDER
    return None


#: Cells that sequences of characters are counted in, a power of two.
CELLS = 4096


def profile(text: str, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Counts of the sequences of so many characters, several to a cell."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = []
    for q in lengths:
        key = np.zeros(max(0, len(c) - q + 1), np.int64)
        for i in range(q):
            key = key * 1_000_003 + c[i : len(c) - q + 1 + i]
        # cut off where 16 bits end, which makes two texts look more alike and never less
        out.append(np.minimum(np.bincount((key ^ key >> 15) & CELLS - 1, minlength=CELLS), 32767).astype(np.int16))
    return out


@lru_cache(64)
def in_order(t: str) -> str:
    """The words of a text in alphabetical order."""
    return " ".join(sorted(t.split()))


def similar(a: str, b: str, need: float, profiles: Callable[[str], list[np.ndarray]]) -> float | None:
    """similarity() of comparison texts (words one space apart) that reach `need`, None for the others.

    An insertion or deletion changes 2q - 1 sequences of q characters at most, so counts of sequences tell most texts
    that can't reach it apart; what the one order of words uses up of the allowed distance limits the other.
    """
    if not a or not b or a == b:
        return similarity(a, b)
    total = len(a) + len(b)
    allowed = (1 - need + 2e-6) * total
    x, y = profiles(a), profiles(b)
    least = [int(np.abs(p - q).sum(dtype=np.int64)) / k for p, q, k in zip(x, y, (1, 3, 7, 3, 7), strict=True)]
    first, second = max(least[:3]), max(least[0], *least[3:])
    if 0.7 * first + 0.3 * second > allowed:
        return None
    d = indels(a, b, int((allowed - 0.3 * second) / 0.7), first)
    if d is None:
        return None
    e = indels(in_order(a), in_order(b), int((allowed - 0.7 * d) / 0.3), second)
    if e is None:
        return None
    return round(0.7 * ((total - d) / total) + 0.3 * ((total - e) / total), 6)


@lru_cache(1024)
def profiles(t: str) -> list[np.ndarray]:
    """The counts of sequences that similar() asks for; a process remembers those of its last texts, also from one batch to the next."""
    return profile(t, (1, 2, 4)) + profile(in_order(t), (2, 4))


def similarity_of(a: str, b: str, need: str) -> Column:
    """similarity() of the pairs that reach `need`, null for the others."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q, r, profiles) for p, q, r in zip(x, y, n, strict=True)], dtype="float64")

    return score(a, b, need)


def required(kind: Column, numbers_a: Column, numbers_b: Column, settings: Settings = Settings()) -> Column:
    fallback = F.when(kind == "fallback", settings.fallback_threshold).otherwise(settings.threshold)
    return F.greatest(fallback, F.when(numbers_a != numbers_b, settings.updated_statistic_threshold).otherwise(settings.threshold))


def marks(unit_rows: DataFrame) -> DataFrame:
    """(uid, chars, kind, numbers): what a comparison needs of a unit besides its text."""
    return unit_rows.select("uid", F.length("norm").alias("chars"), "kind", T.numbers(F.col("text")).alias("numbers"))


def scored_pairs(pairs: DataFrame, unit_rows: DataFrame, unit_marks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(first_id, second_id, similarity, ok): whether pairs reach what their kind and numbers require.

    Lengths decide first, from marks alone; texts are fetched for the pairs that could reach it. Pairs
    that don't reach it have no similarity, or one below it.
    """
    side = lambda k: unit_marks.select(F.col("uid").alias(f"{k}_id"), *[F.col(c).alias(f"{k}_{c}") for c in ("chars", "kind", "numbers")])
    both = pairs.join(side("first"), "first_id").join(side("second"), "second_id")
    low, high = F.least("first_chars", "second_chars"), F.greatest("first_chars", "second_chars", F.lit(1))
    both = both.withColumn("required", required(F.col("first_kind"), F.col("first_numbers"), F.col("second_numbers"), settings))
    possible = (low / high >= settings.length_ratio) & (1.4 * low / (low + high) + 0.3 >= F.col("required"))
    judged = materialize(both.select("first_id", "second_id", "required", possible.alias("possible")), "judged")
    text = lambda k: unit_rows.select(F.col("uid").alias(f"{k}_id"), F.col("norm").alias(f"{k}_norm"))
    read = judged.where("possible").join(text("first"), "first_id").join(text("second"), "second_id").withColumn("similarity", similarity_of("first_norm", "second_norm", "required"))
    out = materialize(read.select("first_id", "second_id", "similarity", F.coalesce(F.col("similarity") >= F.col("required"), F.lit(False)).alias("ok")), "scored")
    return out.unionByName(judged.where("not possible").select("first_id", "second_id", F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("ok")))


def near_pairs(unit_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(first_id, second_id, similarity) of the candidates that reach what their kind and numbers require."""
    u = materialize(unit_rows, "units")
    return scored_pairs(candidate_pairs(u, settings), u, marks(u), settings).where("ok").select("first_id", "second_id", "similarity")


#: Links of one component that are folded at a time; a component with more is folded from its best on.
LINKS = 1000
FOLDED = "step string, x string, y string, s double, f string, g string, n long, bad long"


def fold(part: pd.DataFrame) -> list[tuple]:
    """One component's links, the best first, as far as what is known of its clusters decides them.

    part: rows of step `link` (x, y: clusters; s, f, g: similarity and the two units), `known` (x, y: clusters; n pairs
    compared, bad of them refused) and `size` (x: cluster; n units). Two clusters merge if all their cross pairs are
    known and none is refused; a refused pair is refused for good, as clusters only grow. Where a cross pair is not
    known yet, the two clusters are asked for and wait, as do links to clusters that wait. Links between others
    can't change that, so they go on. Rows out: `merge` (x into y), `need` (x, y) and the links that are left, as `later`.
    """
    size = {r.x: r.n for r in part[part.step == "size"].itertuples()}
    at = {x: x for x in size}
    inside = {x: [x] for x in size}
    known: dict[str, dict[str, tuple[int, int]]] = {x: {} for x in size}
    for r in part[part.step == "known"].itertuples():
        known[r.x][r.y] = known[r.y][r.x] = (r.n, r.bad)
    waiting: set[str] = set()
    out = []
    links = part[part.step == "link"]
    for s, f, g, x, y in sorted(zip(links.s, links.f, links.g, links.x, links.y, strict=True), reverse=True):
        p, q = at[x], at[y]
        if p == q:
            continue
        n, bad = known[p].get(q, (0, 0))
        if p in waiting or q in waiting:
            waiting |= {p, q}
            out.append(("later", x, y, s, f, g, None, None))
        elif bad:
            continue
        elif n == size[p] * size[q]:
            size[p] += size.pop(q)
            for c in inside[q]:
                at[c] = p
            inside[p] += inside.pop(q)
            for r, (m, worse) in known.pop(q).items():
                if r != p:
                    del known[r][q]
                    m2, worse2 = known[p].get(r, (0, 0))
                    known[p][r] = known[r][p] = (m + m2, worse + worse2)
            known[p].pop(q, None)
        else:
            waiting |= {p, q}
            out += [("need", p, q, None, None, None, None, None), ("later", x, y, s, f, g, None, None)]
    return out + [("merge", x, p, None, None, None, None, None) for x, p in at.items() if x != p]


#: Candidate pairs and characters up to which a component of links is folded whole, with its texts.
WHOLE_PAIRS, WHOLE_CHARS = 200_000, 50_000_000


def fold_whole(pairs: list[tuple], fits: Callable[[str, str], float | None], possible: Callable[[str, str], bool]) -> tuple[dict[str, str], list[tuple]]:
    """({unit: cluster}, accepted pairs that were not candidates): one component, all its links from the best on.

    pairs: (similarity, first, second, accepted) of its candidates. Cross pairs that are no candidates are compared
    when two clusters meet, those that lengths refuse first; fits() is None where a pair is refused.
    """
    seen = {(f, g): ok for _, f, g, ok in pairs}
    at = {u: u for pair in seen for u in pair}
    inside = {u: [u] for u in at}
    refused: dict[str, set[str]] = {u: set() for u in at}
    for (f, g), ok in seen.items():
        if not ok:
            refused[f].add(g)
            refused[g].add(f)
    asked = []

    def meet(p: str, q: str) -> bool:
        new = [x for x in ((u, v) if u < v else (v, u) for u in inside[p] for v in inside[q]) if x not in seen]
        if not all(possible(*x) for x in new):
            return False
        for x in new:
            s = fits(*x)
            seen[x] = s is not None
            if s is None:
                return False
            asked.append((s, *x))
        return True

    for _, f, g in sorted(((s, f, g) for s, f, g, ok in pairs if ok), reverse=True):
        p, q = at[f], at[g]
        if p == q or q in refused[p]:
            continue
        if not meet(p, q):
            refused[p].add(q)
            refused[q].add(p)
            continue
        for u in inside[q]:
            at[u] = p
        inside[p] += inside.pop(q)
        for r in refused.pop(q):
            refused[r].discard(q)
            refused[r].add(p)
            refused[p].add(r)
    return at, asked


def folded_whole(known: DataFrame, links: DataFrame, unit_rows: DataFrame, unit_marks: DataFrame, settings: Settings) -> DataFrame:
    """(step, x, y, s) of the components that a task can hold: `at` (x: unit, y: cluster) and `pair` (x, y: units) of pairs that were no candidates."""
    roots = components(links.select(F.col("first_id").alias("a"), F.col("second_id").alias("b"))).withColumnRenamed("node", "uid")
    of = lambda k: roots.select(F.col("uid").alias(k), F.col("root").alias(f"{k}_root"))
    inner = materialize(known.join(of("first_id"), "first_id").join(of("second_id"), "second_id").where("first_id_root = second_id_root").withColumnRenamed("first_id_root", "root").drop("second_id_root"), "inner")
    chars = roots.join(unit_marks, "uid").groupBy("root").agg(F.sum("chars").alias("chars")).where(F.col("chars") <= WHOLE_CHARS)
    small = inner.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= WHOLE_PAIRS).join(chars, "root").select("root")
    small = materialize(small, "small")
    texts = roots.join(small, "root", "left_semi").join(unit_rows.select("uid", "norm"), "uid").join(unit_marks.select("uid", "kind", "numbers"), "uid")
    pair_rows = inner.join(small, "root", "left_semi").select("root", F.col("first_id").alias("x"), F.col("second_id").alias("y"), F.col("similarity").alias("s"), "ok")
    rows = pair_rows.unionByName(texts.withColumnRenamed("uid", "x"), allowMissingColumns=True).select("root", "x", "y", "s", "ok", "norm", "kind", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, units, root, out = [], {}, None, []

        def need(f: str, g: str) -> float:
            (_, kind, m), (_, _, n) = units[f], units[g]
            changed = m is not None and n is not None and m != n
            return max(settings.fallback_threshold if kind == "fallback" else settings.threshold, settings.updated_statistic_threshold if changed else settings.threshold)

        def possible(f: str, g: str) -> bool:
            low, high = sorted((len(units[f][0]), len(units[g][0])))
            return low / max(high, 1) >= settings.length_ratio and 1.4 * low / (low + high) + 0.3 >= need(f, g)

        def fits(f: str, g: str) -> float | None:
            s = similar(units[f][0], units[g][0], need(f, g), profiles)
            return s if s is not None and s >= need(f, g) else None

        def done() -> None:
            at, asked = fold_whole(pairs, fits, possible)
            out.extend(("at", u, c, None) for u, c in at.items() if u in units)
            out.extend(("pair", f, g, s) for s, f, g in asked)
            pairs.clear()
            units.clear()

        def taken() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["step", "x", "y", "s"])
            out.clear()
            return b

        for b in batches:
            for r, x, y, s, ok, norm, kind, numbers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r != root:
                    if root is not None:
                        done()
                    root = r
                if y is None:
                    units[x] = (norm, kind, numbers)
                else:
                    pairs.append((s, x, y, ok))
            yield taken()
        if root is not None:
            done()
        yield taken()

    # by a number of parts of its own, so that small rows with long work are not put into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(parts, "root").sortWithinPartitions("root").mapInArrow(run, "step string, x string, y string, s double"), "whole")


def linkage(unit_rows: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """((uid, cluster), scored pairs) of units that have a link: complete linkage, the best link first.

    Equals going through all accepted candidates by similarity and ids, from the greatest, and merging
    two clusters whenever all their cross pairs are accepted. Components of links don't touch each
    other, so each is folded in one task, with its texts, if that holds it (WHOLE_PAIRS, WHOLE_CHARS).
    A larger one is folded by rounds, a stretch of LINKS links and the clusters they join at a time, without
    texts; cross pairs that blocking didn't bring together are scored in between, as a join.
    """
    u = unit_rows
    light = materialize(marks(u), "marks")
    known = scored_pairs(candidate_pairs(u, settings), u, light, settings)
    links = known.where("ok").select("first_id", "second_id", "similarity")
    ends = links.select(F.col("first_id").alias("uid")).union(links.select("second_id")).distinct()
    whole = folded_whole(known, links, u, light, settings)
    held = whole.where("step = 'at'").select(F.col("x").alias("uid"), F.col("y").alias("cluster"))
    known = known.unionByName(whole.where("step = 'pair'").select(F.col("x").alias("first_id"), F.col("y").alias("second_id"), F.col("s").alias("similarity"), F.lit(True).alias("ok")))
    links = links.join(held.select(F.col("uid").alias("first_id")), "first_id", "left_anti")
    clusters = materialize(ends.join(held, "uid", "left").select("uid", F.coalesce("cluster", "uid").alias("cluster")), "clusters")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(part), columns=["step", "x", "y", "s", "f", "g", "n", "bad"])

    while True:
        a, b = clusters.select(F.col("uid").alias("first_id"), F.col("cluster").alias("x")), clusters.select(F.col("uid").alias("second_id"), F.col("cluster").alias("y"))
        live = materialize(links.join(a, "first_id").join(b, "second_id").where("x != y"), "live")
        if live.isEmpty():
            return clusters, known
        rooted = lambda rows, col: components(rows.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", col)
        todo, rest = live.join(rooted(live, "x"), "x"), None
        counts = todo.groupBy("root").agg(F.count("*").alias("n"))
        if not counts.where(F.col("n") > LINKS).isEmpty():
            placed = ordinals(todo.withColumn("_key", F.struct("similarity", "first_id", "second_id")), "root", "_key", "place").drop("_key").join(counts, "root")
            placed = materialize(placed.withColumn("now", F.col("place") >= F.col("n") - LINKS).drop("place", "n", "root"), "placed")
            taken, rest = placed.where("now").drop("now"), placed.where("not now").select("first_id", "second_id", "similarity")
            todo = taken.join(rooted(taken, "x"), "x")
        todo = materialize(todo, "todo")
        roots = todo.select("x", "root").union(todo.select("y", "root")).distinct()
        empty = lambda kind: F.lit(None).cast(kind)
        row = lambda df, step, **c: df.select("root", F.lit(step).alias("step"), *[c.get(k, empty(t)).alias(k) for k, t in (("x", "string"), ("y", "string"), ("s", "double"), ("f", "string"), ("g", "string"), ("n", "long"), ("bad", "long"))])
        cross = known.join(a, "first_id").join(b, "second_id").where("x != y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
        cross = cross.join(roots, "x").join(roots.select(F.col("x").alias("y"), F.col("root").alias("other")), "y").where("root = other")
        sizes = clusters.groupBy(F.col("cluster").alias("x")).agg(F.count("*").alias("n")).join(roots, "x")
        col = F.col
        rows = row(todo, "link", x=col("x"), y=col("y"), s=col("similarity"), f=col("first_id"), g=col("second_id")).unionByName(row(cross, "known", x=col("x"), y=col("y"), n=col("n"), bad=col("bad"))).unionByName(row(sizes, "size", x=col("x"), n=col("n")))
        done = materialize(rows.groupBy("root").applyInPandas(run, FOLDED), "folded")
        merged = done.where("step = 'merge'").select(F.col("x").alias("cluster"), F.col("y").alias("into"))
        clusters = materialize(clusters.join(merged, "cluster", "left").select("uid", F.coalesce("into", "cluster").alias("cluster")), "clusters")
        links = done.where("step = 'later'").select(F.col("f").alias("first_id"), F.col("g").alias("second_id"), F.col("s").alias("similarity"))
        links = links if rest is None else links.unionByName(rest)
        needed = done.where("step = 'need'").select("x", "y")
        if not needed.isEmpty():
            members = lambda k, c: clusters.select(F.col("cluster").alias(c), F.col("uid").alias(k))
            asked = needed.join(members("p", "x"), "x").join(members("q", "y"), "y").select(F.least("p", "q").alias("first_id"), F.greatest("p", "q").alias("second_id"))
            known = known.unionByName(scored_pairs(asked.join(known.select("first_id", "second_id"), ["first_id", "second_id"], "left_anti"), u, light, settings))


def near_groups(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(uid, group_uid, similarity_min, similarity_max) of units in groups of two or more. group_uid: least uid of the group.

    All pairs of a group were compared when it grew, so its least and greatest similarity are aggregates.
    """
    clusters, known = linkage(materialize(units(chunks), "units"), settings)
    first = clusters.groupBy("cluster").agg(F.min("uid").alias("group_uid"), F.count("*").alias("n")).where("n > 1")
    at = clusters.select(F.col("uid").alias("first_id"), "cluster")
    pairs = known.where("ok").join(at, "first_id").join(clusters.select(F.col("uid").alias("second_id"), F.col("cluster").alias("other")), "second_id").where("cluster = other")
    span = pairs.groupBy("cluster").agg(F.round(F.min("similarity"), 4).alias("similarity_min"), F.round(F.max("similarity"), 4).alias("similarity_max"))
    return clusters.join(first, "cluster").join(span, "cluster").select("uid", "group_uid", "similarity_min", "similarity_max")


def statistics(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: chunks, units, possible pairs, candidate pairs."""
    u = units(chunks)
    a = u.agg(F.sum("members").alias("chunks"), F.count("*").alias("units"), F.expr("count(*) * (count(*) - 1) div 2").alias("possible_pairs"))
    b = candidate_pairs(u, settings).agg(F.count("*").alias("candidate_pairs"))
    return a.join(b)
