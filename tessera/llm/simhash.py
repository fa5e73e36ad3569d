"""SimHash near-duplicates by hashing the neighbours of whole fingerprints.

This is multi-index hashing with a single table of whole fingerprints instead of a table for each segment: each
fingerprint is entered under itself and under the 64 values that differ from it in one bit. Two
fingerprints at distance one or two always share a key (flip one differing bit on either
side), and all that share a key lie within two bits of it, so at most 65 distinct fingerprints
meet there: no bucket can be hot, whatever the number of documents, where values of segments would
gather all fingerprints that share one. Sharing a key with another value proves a distance of one or two, so nothing is left to
verify. Groups are connected components of the links, found by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.graph import components

from .common import LOWER_AZ, materialize, texts

BITS = 64
SEGMENT_BITS = 16
RADIUS = 2
#: Shingles hashed at a time; bounds the memory that a very long text takes.
BLOCK = 100_000


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text as a signed 64-bit integer (0 if it has no word)."""
    return fingerprint_of(_words(text), words_per_shingle, seed)


def fingerprint_of(words: list[bytes], words_per_shingle: int = 3, seed: int = 42) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(words_per_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        # groups of up to 255 rows add up in bytes, which is several times faster than in wide integers
        whole = len(bits) // 255 * 255
        ones += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row (doc_id, fp) per row of docs. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words_per_shingle, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = texts(docs)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect what lies within RADIUS bits; fps: distinct fp.

    Among the at most 65 fingerprints of a key each is linked with the next one only: all of
    them are within two bits of each other, so the components are those of all pairs.
    """
    flips = [1 << (s * SEGMENT_BITS + i) for s in range(BITS // SEGMENT_BITS) for i in range(SEGMENT_BITS)]
    signed = [0] + [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    keys = fps.select("fp", F.explode(F.expr(f"transform(array({', '.join(f'{x}L' if x > -(1 << 63) else '(-9223372036854775807L - 1L)' for x in signed)}), x -> x ^ fp)")).alias("key"))
    near = keys.select("fp", F.lag("fp").over(Window.partitionBy("key").orderBy("fp")).alias("a"))
    return near.where("a is not null and bit_count(a ^ fp) between 1 and 2").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs; repeated rows stay repeated.

    component_id is the smallest doc_id of the component of links of two or fewer bits. Blank
    texts share fingerprint 0. A null doc_id takes part and never is a component's id, unless
    it has no other.
    """
    fps = materialize(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp").distinct()))
    member = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(member.join(named, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits of the counts of shingles that rank them, rarest first.
RANK_BITS = 20
#: Odd multiplier that mixes the hashes of a shingle's words in turn.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a unit's name that the bitmap of wanted units goes by: 2 MB.
PREFIX_BITS = 24


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()


def unit_of(words: list[bytes]) -> bytes:
    """Names a sequence of words; equal sequences are one unit."""
    return xxhash.xxh128_digest(b" ".join(words))


class Hashes(dict):
    """Unsigned 64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHES = Hashes()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes, rising, of the runs of size words, or of all words where there are fewer."""
    w = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    h = np.zeros(max(1, len(w) - size + 1), np.uint64)
    for j in range(size):
        h = (h ^ w[j : j + len(h)]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def ranks(src: DataFrame, size: int) -> np.ndarray:
    """How often shingles of each value of their last RANK_BITS bits occur; of fixed size.

    Counts of one in a task are left out: any order serves, and these tell frequent from rare no better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RANK_BITS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(n, shingles(_words(t), size) & len(n) - 1, 1)
        at = np.flatnonzero(n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    got = src.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RANK_BITS, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


#: Rounds in which each bucket's members are compared with one of them, before all pairs left are.
STAR_ROUNDS = 2


def similar_units(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(units, links): unit, id, least doc_id; and (a, b, jaccard) of ids whose components are those of all pairs of at least the similarity.

    Shingles have one order, rarest first. Two sets of at least the similarity share a shingle
    among the first n - ceil(similarity * n) + 1 of each, so such prefixes are table keys, and at the first
    that they share enough shingles follow in both, so no pair is lost. Pairs that SimHash links are compared first, and
    in a few rounds each unit of a bucket with one that meets most others, a new one each round. Then all pairs of a bucket are compared
    that these links have not put into one component: others change no component. Buckets are
    counted and joined, never gathered.
    """

    src = texts(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(ranks(src, size))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()  # of copies in a task one brings its keys
        for b in batches:
            names, keys, sizes, fps = [], [], [], []
            for w in map(_words, b.column(1).to_pylist()):
                names.append(unit := unit_of(w))
                if unit in given:
                    keys.append(None)
                    sizes.append(None)
                    fps.append(None)
                    continue
                given.add(unit)
                h = shingles(w, size)
                first = np.lexsort((h, order.value[h & (1 << RANK_BITS) - 1]))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                keys.append(h[first])
                sizes.append(len(h))
                fps.append(fingerprint_of(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "unit", "keys", "size", "fp"])

    marks = src.mapInArrow(mark, f"doc_id {kind}, unit binary, keys array<bigint>, size long, fp long")
    units = marks.groupBy("unit").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("least"), F.first("keys", True).alias("keys"), F.max("size").alias("size"), F.max("fp").alias("fp"))
    units = materialize(units.select("unit", F.col("least.doc_id").alias("least"), "keys", "size", "fp", F.monotonically_increasing_id().alias("id")), "units")

    keys = units.select("id", "size", F.posexplode("keys").alias("pos", "key")).select("key", "id", F.col("size").cast("int"), "pos")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(keys.join(several, "key"), "buckets")

    # as if a shared key were the first one: what follows it in both must hold what the similarity needs
    may_reach = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size2")) - 1e-6
    ordered = lambda pairs: pairs.where(may_reach).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    partner = [F.col(c).alias(f"{c}2") for c in ("id", "size", "pos")]

    def scored(pairs: DataFrame) -> DataFrame:
        return _scored(src, units, pairs, size).where(F.col("jaccard") >= similarity)

    near = seen = None
    for k in range(STAR_ROUNDS):
        if k == 0:
            # the unit that meets most others
            degrees = member.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
            hub = member.join(degrees, "id").groupBy("key").agg(F.max_by(F.struct(*partner), F.struct("degree", "id")).alias("hub"))
        else:
            # any component's, but the same in most buckets
            by = F.struct(F.xxhash64(F.lit(k), "root"), F.xxhash64(F.lit(k), "id"))
            hub = member.groupBy("key").agg(F.min_by(F.struct(*partner), by).alias("hub"), F.min_by("root", by).alias("root2"))
        stars = member.join(hub.select("key", "hub.*", *(["root2"] if k else [])), "key").where("root != root2" if k else "id != id2")
        stars = ordered(stars) if k else ordered(stars).union(linked_units(units)).distinct()
        stars = materialize(stars.join(seen, ["a", "b"], "left_anti") if seen is not None else stars, "stars")
        found = materialize(scored(stars), "near")
        near, seen = (found, stars) if near is None else (near.unionByName(found), seen.unionByName(stars))
        roots = components(near).withColumnRenamed("node", "id")
        placed = member.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        member = materialize(placed.join(apart, "key", "left_semi"), "members")
        if member.isEmpty():
            return units.select("unit", "id", "least"), near
    other = member.select("key", *partner, F.col("root").alias("root2"))
    rest = ordered(member.join(other, "key").where("root < root2"))
    rest = materialize(rest.join(seen, ["a", "b"], "left_anti"), "pairs")
    return units.select("unit", "id", "least"), near.unionByName(scored(rest))


def linked_units(units: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids that connect the units whose fingerprints lie within RADIUS bits; units: id, fp.

    Units of one fingerprint are linked with the first of them, and the first ones with those of the fingerprints beside theirs.
    """
    first = units.groupBy("fp").agg(F.min("id").alias("first"))
    same = units.join(first, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    at = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}"))
    beside = links(first.select("fp")).join(at("a"), "a").join(at("b"), "b")
    return same.union(beside.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def _scored(src: DataFrame, units: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, b, jaccard) of pairs of ids, by their sets of shingles."""
    wanted = units.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "unit")

    # Texts are not shuffled for their shingles: a bitmap of fixed size of the wanted units' first
    # bytes passes over most others where they are read, and a join on the whole name decides.
    prefix = F.conv(F.hex(F.substring("unit", 1, PREFIX_BITS // 8)), 16, 10).cast("long").alias("at")
    held = wanted.select(prefix).selectExpr("shiftright(at, 6) as word", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << PREFIX_BITS - 6, np.int64)
    for r in held.toLocalIterator():  # at most 2^18 rows
        bitmap[r["word"]] = r["bits"]
    shared_bits = src.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, given = np.frombuffer(shared_bits.value, np.uint64), set()  # of copies in a task one is enough
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                words = _words(t)
                unit = unit_of(words)
                at = int.from_bytes(unit[: PREFIX_BITS // 8], "big")
                if int(bits[at >> 6]) >> (at & 63) & 1 and unit not in given:
                    given.add(unit)
                    rows.append((unit, pa.array(shingles(words, size), pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["of", "shingles"])

    each = src.select("text").mapInArrow(gather, "of binary, shingles array<bigint>")
    # the join finds the rows where the search for copies has put them
    sets = each.groupBy("of").agg(F.first("shingles").alias("shingles")).join(wanted, F.col("of") == F.col("unit")).select("id", "shingles")
    sets = materialize(sets, "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard"))


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that stand for a group of near-duplicates: of each the one of least doc_id.

    Groups are connected by pairs of at least the similarity, of sets of shingles of size words
    with A-Z lower-cased; equal sequences of words, blank ones among them, are always one. Of
    repeated rows one stays. Rows without an id stand for a group only where all of it is without.
    """
    units, near = similar_units(docs, size, similarity)
    roots = components(near)
    member = units.join(roots.withColumnRenamed("node", "id"), "id", "left").select("unit", "least", F.coalesce("root", "id").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "unit"))
    keep = member.groupBy("root").agg(first.alias("keep")).select(F.col("keep.unit").alias("keep_unit"), F.col("keep.least").alias("keep_id"))
    keep = materialize(keep, "kept")

    # not a UDF: the join's filter would run it a second time, in a second Python worker beside the first
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([unit_of(_words(t)) for t in b.column(2).to_pylist()], pa.binary())], ["row", "own_id", "own_unit"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.mapInArrow(own, T.StructType([*rows.schema.fields[:2], T.StructField("own_unit", T.BinaryType())]))
    kept = marked.join(keep, (F.col("own_unit") == F.col("keep_unit")) & F.col("own_id").eqNullSafe(F.col("keep_id")))
    same = Window.partitionBy("own_unit", "own_id").orderBy(F.lit(0))
    return kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")
