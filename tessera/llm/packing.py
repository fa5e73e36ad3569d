"""Best-fit packing planned on the histogram of lengths.

Only counts of pieces by length (at most `capacity` numbers) go to the driver. Best-fit
decreasing runs over the counts: all pieces of a length are placed together, into groups of
open sequences that are alike. The plan is a short table of slots (length, range of ranks, first
sequence, offset). Each piece then takes its slot by its rank within its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_table, texts
from .tokenization import coder, default_vocabulary

CAPACITY = 1024
END = 2

PLAN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("length", "rank_from", "rank_to", "sequence_from", "offset")])


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) per piece of each row of docs.

    A document of more than capacity tokens is cut into pieces of capacity tokens, of which the
    first takes the remainder. The vocabulary's added tokens are recognised in texts. rank counts the pieces of a length within a task, part the tasks.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), defaultdict(int), coder(path, True)[0]
        for b in batches:
            out = [[] for _ in range(7)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end], "<u4")
                at, k, to = 0, 0, len(ids) % capacity or min(len(ids), capacity)
                while at < len(ids):
                    row = (doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes()), part, seen[to - at])
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
                    seen[to - at] += 1
                    at, k, to = to, k + 1, to + capacity
            kinds = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    src = texts(docs)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, sequence_from, offset) by best-fit decreasing over counts.

    Groups of sequences with equal space left are held as runs of consecutive numbers. Lengths
    that occur more often than any group is long fill several groups, so the plan has at most
    about capacity rows for each time that a group is split.
    """
    slots, sequences = [], 0
    runs: dict[int, deque] = defaultdict(deque)  # space left: runs (first sequence, how many)
    spaces: list[int] = []
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, many = runs[space].popleft()
                take = min(many, left)
                if take < many:
                    runs[space].appendleft((first + take, many - take))
                if not runs[space]:
                    spaces.pop(k)
            else:
                # full sequences of this length alone, as many as it needs
                per = capacity // length
                space, first = capacity, sequences
                take = min(left, -(-left // per))
                sequences += take
            slots.append((length, rank, rank + take, first, capacity - space))
            rank, left = rank + take, left - take
            if rest := space - length:
                if not runs[rest]:
                    insort(spaces, rest)
                runs[rest].append((first, take))
    return slots


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of each row.

    Null and empty texts are one piece, the end token. Equal lengths are interchangeable, so which
    of them shares a sequence with what is arbitrary but complete: every piece has one place, no
    two overlap, and a sequence is filled from 0 without gaps. Repeated rows are packed each.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity, end), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = materialize(base, "ranks")
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = small_table(spark, plan(histogram, capacity), PLAN)
    ranked = cut.join(base.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    s = slots.withColumnRenamed("length", "slot_length")
    # at most a few rows for each of `capacity` lengths
    placed = ranked.join(F.broadcast(s), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
