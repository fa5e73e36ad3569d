"""Exact vector search, metadata filters, index synchronisation and status."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a vector is null, empty or all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def valid(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dimension)


def equal(filters: dict, allowed: tuple[str, ...]) -> Column:
    """Conjunction of equalities; None is no condition, an unknown column raises."""
    if unknown := sorted(set(filters) - set(allowed)):
        raise ValueError(f"unknown filter columns: {', '.join(unknown)}")
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in filters.items() if v is not None], F.lit(True))


#: Probes and vectors on average that meet in one task, and similarities that a task computes at a time.
PROBES, TILE, AT_ONCE = 16_384, 65_536, 8_000_000
#: More than rounding to four digits and the order of a sum can change a similarity by.
MARGIN = 1e-4


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles of length 1; null and zero vectors are zeros, shorter ones end in zeros, and so do null components."""
    column = pc.fill_null(column.combine_chunks().cast(pa.list_(pa.float64())), [])
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.nan_to_num(pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(lengths), width))
    row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def rounded(sims: np.ndarray) -> np.ndarray:
    """Four digits, halves away from zero; -0 is 0."""
    return np.copysign(np.floor(np.abs(np.clip(sims, -1, 1)) * 1e4 + 0.5), sims) / 1e4 + 0.0


def best_of(probes: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounded similarities and row numbers of the k best vectors of each probe, ties by row number; number -1 where there are fewer."""
    n, step = len(probes), max(1, AT_ONCE // max(1, len(probes)))
    held, at = np.full((n, k), -2.0), np.full((n, k), -1)
    for begin in range(0, len(vectors), step):
        sims = probes @ vectors[begin : begin + step].T
        least = held[:, -1] + MARGIN / 4  # a later row has to be better by a digit
        if not begin and sims.shape[1] > k:
            least = np.partition(sims, -k, axis=1)[:, -k] - MARGIN
        row, col = np.nonzero(sims > least[:, None])
        if not len(row):
            continue
        new = rounded(sims[row, col])
        rows = np.unique(row)
        where = np.concatenate([np.repeat(rows, k), row])
        sim, number = np.concatenate([held[rows].ravel(), new]), np.concatenate([at[rows].ravel(), col + begin])
        order = np.lexsort((number, -sim, where))
        keep = order[(np.searchsorted(where[order], rows)[:, None] + np.arange(k)).ravel()]
        held[rows], at[rows] = sim[keep].reshape(-1, k), number[keep].reshape(-1, k)
    return held, at


def nearest(queries: DataFrame, vectors: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar of each query, conditions before the limit, ties by vec_id.

    queries (query_id, query): a stated set. Queries fall into blocks of about PROBES and vectors into tiles of about TILE, by hash;
    each block meets each tile in a task of its own, which multiplies them as matrices and returns the k best of each query. So no task
    grows with either table, and equal vectors are not held beyond k. A null or zero vector is at similarity 0 to all.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    pool = vectors if condition is None else vectors.where(condition)
    # small tables are dealt out too, as far as there are cores
    n, many = queries.count(), pool.count()
    blocks = max(1, -(-n // PROBES))
    tiles = max(1, -(-many // TILE), min(many // 1000, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // blocks)))
    dealt = lambda df, key, parts, other, place: df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("bucket", place)
    q = dealt(queries.select("query_id", "query"), "query_id", blocks, tiles, F.col("_part") * tiles + F.col("_other")).select("bucket", "query_id", "query")
    v = dealt(pool.select("vec_id", "embedding"), "vec_id", tiles, blocks, F.col("_other") * tiles + F.col("_part")).select("bucket", "vec_id", "embedding")

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by("vec_id")
        width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (q.column("query"), v.column("embedding"))) if q.num_rows and v.num_rows else 0
        sims, at = best_of(matrix(q.column("query"), width), matrix(v.column("embedding"), width), k) if width else (np.zeros((q.num_rows, min(k, v.num_rows))), np.tile(np.arange(min(k, v.num_rows)), (q.num_rows, 1)))
        there = at >= 0
        row = np.nonzero(there)[0]
        return pa.table({"query_id": q.column("query_id").take(pa.array(row)), "vec_id": v.column("vec_id").take(pa.array(at[there])), "similarity": sims[there]})

    kinds = dict(queries.dtypes)["query_id"], dict(pool.dtypes)["vec_id"]
    pairs = q.groupBy("bucket").cogroup(v.groupBy("bucket")).applyInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sync_plan(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(id, action): new, changed, current or stale. chunks, index: id, fingerprint."""
    both = chunks.select("id", F.col("fingerprint").alias("want")).join(index.select("id", F.col("fingerprint").alias("have"), F.lit(True).alias("indexed")), "id", "full_outer")
    action = F.when(F.col("want").isNull(), "stale").when(F.col("indexed").isNull(), "new").when(F.col("want") == F.col("have"), "current").otherwise("changed")
    return both.select("id", action.alias("action"))


def index_status(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """(chunk_id, status): invalid if id or text are blank, skipped if a copy stands for it, else eligible.

    members (chunk_id, representative): duplicate group members.
    """
    blank = F.col("chunk_id").isNull() | (F.trim(F.coalesce("text", F.lit(""))) == "")
    status = F.when(blank, "invalid").when(F.col("representative").isNotNull() & (F.col("representative") != F.col("chunk_id")), "skipped").otherwise("eligible")
    return chunks.join(members, "chunk_id", "left").select("chunk_id", status.alias("status"))


def embedding_text(path: Column, argument: Column, heading: Column, section: Column, text: Column) -> Column:
    """Context lines that the text's opening doesn't already say, the section, a blank line, the text."""
    opening = F.lower(F.substring(F.regexp_replace(text, r"\s+", " "), 1, 500))
    line = lambda label, value: F.when(value.isNotNull() & (value != "") & ~opening.contains(F.lower(value)), F.concat(F.lit(f"[{label}] "), value))
    said = F.filter(path, lambda p: ~opening.contains(F.lower(p)))
    lines = F.concat_ws("\n", F.when(F.size(said) > 0, F.concat(F.lit("[Path] "), F.array_join(said, " > "))), line("Argument", argument), line("Heading", heading), F.concat(F.lit("[Section] "), section))
    return F.concat(lines, F.lit("\n\n"), text)


def fingerprint(version: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(version), F.char(F.lit(0)), text), 256)
