"""Vector code compression: product quantisation over integers, searched through a Walsh-Hadamard transform.

A component x becomes the integer floor(scale * x). Vectors are cut into equal parts, and each part
position has a codebook that a few rounds of nearest-entry assignment and floored means refine. The
nearest entry is found in the transform's domain: an unnormalised Walsh-Hadamard transform of parts
and entries, zero-padded to a power of two m, multiplies every squared distance by m exactly. Squared
differences are added in sequency order, smooth components first, and an entry is dropped once its
sum so far is above the whole distance of another entry. Everything is an integer.

A round reads the table and sends at most parts x entries sums from each task; the codebooks, of
parts x entries x width integers, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of at most so many bits keep all sums of squares within 64 bits; larger ones are Python's integers.
SMALL_BITS = 20
#: Sums travel as limbs of so many bits, so that no aggregate overflows whatever the components.
LIMB = 30
#: Parts that are compared with all entries at once, and components added between two eliminations.
BLOCK, STEP = 1024, 4


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of rows whose vector is whole: not null, no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))
    return rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))


def integers(flat: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x); Python's integers where wide. scale is a power of two, so that the product is exact."""
    if not wide:
        return np.floor(flat * scale).astype(np.int64)
    return np.array([math.floor(x) * scale if abs(x) >= 2**60 else math.floor(x * scale) for x in flat.tolist()], dtype=object)


def cut(column: pa.Array, dimension: int, parts: int, scale: int, wide: bool) -> np.ndarray:
    """(rows, parts, width) integers; shorter vectors end in zeros."""
    flat, lengths = integers(column.flatten().to_numpy(zero_copy_only=False), scale, wide), np.diff(column.offsets.to_numpy())
    if (lengths == dimension).all():
        whole = flat
    else:
        whole = np.zeros(len(lengths) * dimension, dtype=flat.dtype)
        starts = np.repeat(np.arange(len(lengths)) * dimension, lengths)
        whole[starts + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return whole.reshape(len(lengths), parts, dimension // parts)


def sequency_rows(m: int) -> np.ndarray:
    """Rows of the natural-order Hadamard matrix of size m in order of their sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, zero-padded to a power of two, in sequency order; squared lengths grow by that power."""
    width = x.shape[-1]
    m = 1 << max(0, width - 1).bit_length()
    y = np.zeros((*x.shape[:-1], m), dtype=x.dtype)
    y[..., :width] = x
    h = 1
    while h < m:
        z = y.reshape(*x.shape[:-1], m // (2 * h), 2, h)
        y = np.stack([z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]], axis=-2).reshape(*x.shape[:-1], m)
        h *= 2
    return y[..., sequency_rows(m)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance times m) of each row's nearest entry, ties to the lower index; both in the transform's domain.

    All entries meet the first components. The best of them so far is summed to its end, which bounds
    the row's distance; what is above the bound is dropped, and the others go on, a few components at a time.
    """
    index, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    m = x.shape[1]
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        first = min(STEP, m)
        sums = np.zeros((len(part), len(entries)), dtype=x.dtype)
        for k in range(first):
            d = part[:, k, None] - entries[None, :, k]
            sums += d * d
        guess = sums.argmin(axis=1)
        d = part[:, first:] - entries[guess, first:]
        bound = sums[np.arange(len(part)), guess] + (d * d).sum(axis=1)
        row, entry = np.nonzero(sums <= bound[:, None])
        alive = sums[row, entry]
        for k in range(first, m, STEP):
            d = part[row, k : k + STEP] - entries[entry, k : k + STEP]
            alive = alive + (d * d).sum(axis=1)
            keep = alive <= bound[row]
            row, entry, alive = row[keep], entry[keep], alive[keep]
        # what is left has its whole distance; rows are in order, and entries within them
        starts = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(alive, starts)
        hit = np.nonzero(alive == best[row])[0]
        index[at : at + BLOCK] = entry[hit[np.searchsorted(row[hit], np.arange(len(part)))]]
        least[at : at + BLOCK] = best
    return index, least


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def limbs(x: int, many: int) -> list[int]:
    return [x >> LIMB * i & (1 << LIMB) - 1 for i in range(many - 1)] + [x >> LIMB * (many - 1)]


def assigned(rows: DataFrame, books: np.ndarray, dimension: int, scale: int, wide: bool) -> DataFrame:
    """(vec_id, label, code, error): the nearest entry of each part; error is null where it passes 63 bits."""
    parts, m = len(books), 1 << max(0, books.shape[2] - 1).bit_length()
    tables = [transform(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = cut(b.column(1), dimension, parts, scale, wide)
            found = [nearest(transform(x[:, p]), tables[p]) for p in range(parts)]
            error = sum(d // m for _, d in found)
            codes = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def refined(rows: DataFrame, books: np.ndarray, dimension: int, scale: int, wide: bool, many: int) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts nearest to them; unused entries stay.

    A task adds up its own parts and sends a row for each entry it met. many: limbs of a sum.
    """
    parts, entries, width = books.shape
    tables = [transform(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=object if wide else np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = cut(b.column(1), dimension, parts, scale, wide)
            for p in range(parts):
                i = nearest(transform(x[:, p]), tables[p])[0]
                np.add.at(sums[p], i, x[:, p])
                counts[p] += np.bincount(i, minlength=entries)
        p, e = np.nonzero(counts)
        flat = [[y for v in s for y in limbs(int(v), many)] for s in sums[p, e].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(p * entries + e, pa.int64()), pa.array(counts[p, e], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["slot", "n", "sums"])

    found = rows.mapInArrow(run, "slot long, n long, sums array<long>")
    total = found.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width * many)]).alias("sums"))
    books = books.copy()
    for r in total.collect():  # at most a row for each entry
        whole = [sum(r["sums"][w * many + i] << LIMB * i for i in range(many)) for w in range(width)]
        books[r["slot"] // entries, r["slot"] % entries] = [s // r["n"] for s in whole]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row with a whole vector.

    vectors: vec_id, embedding, label (may be missing: then null); other columns are ignored. Codebooks
    start as the parts of the first `entries` rows by vec_id, null ids last, ties by vector; fewer rows
    give fewer entries. Repeated rows and ids count each. Vectors of several lengths end in zeros, as do
    those whose length is no multiple of parts. Empty tables give no rows. Components of any finite size are
    exact; a sum of squares that passes 63 bits is null. label_error adds up errors of equal labels, nulls together.
    """
    if entries > 256 or scale & scale - 1:
        raise ValueError("entries must be at most 256, and scale a power of two")
    ship(vectors.sparkSession)
    rows = kept(vectors)
    shape = rows.agg(F.max(F.size("embedding")).alias("d"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).first()
    dimension = max(parts, -(-(shape["d"] or 0) // parts) * parts)
    bits = (math.floor(shape["top"] or 0) + 1).bit_length() + scale.bit_length()
    wide, many = bits > SMALL_BITS, (bits + 1) // LIMB + 1
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    books = cut(first, dimension, parts, scale, wide).transpose(1, 0, 2) if len(first) else np.zeros((parts, 1, dimension // parts), dtype=np.int64)
    for _ in range(rounds):
        books = refined(rows, books, dimension, scale, wide, many)
    coded = materialize(assigned(rows, books, dimension, scale, wide), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
