"""Phrase collocation mining by relations of occurrences (SETM).

R1 holds the occurrences of frequent words, sorted by piece and position. R(k+1) is the merge-join of
Rk with itself at adjacent positions of a piece: where the group at p and the group at p + 1 are both
frequent, they are a phrase of k + 1 words at p. Its groups are counted, frequent ones get numbers, and
a semi-join keeps their occurrences for the next length.

A relation is stored in runs: a row holds a stretch of a text, its positions in order and the groups
there. The end of a piece takes a position of its own, so that words of two pieces are never neighbours.
Texts of any length are cut into runs of RUN positions that overlap by the longest phrase less one, and
a phrase belongs to the run where it begins. So a merge-join needs no other row, relations stay sorted
from one length to the next, and only counts of groups are shuffled, a task's own occurrences of a
group added up before. Frequent groups of up to BROADCAST rows travel to the tasks as sorted arrays;
more of them are joined, and their runs gathered again, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.groups import ordinals

from .common import LOWER_AZ, materialize, ship

LONGEST, LEAST, TOP = 5, 100, 2000
#: Positions of a text that begin in one run.
RUN = 4096
#: Frequent groups that are sent to tasks; beyond, occurrences are joined with them.
BROADCAST = 1_000_000
#: Distinct words, or occurrences of groups, that a task adds up before it sends their counts.
WORDS, OCCURRENCES = 200_000, 2_000_000
BREAK = b"\n"
#: Lower case, marks and line ends become one break, and tabs blanks.
PREPARED = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", BREAK * 10 + b" ")
PREPARED = bytes(PREPARED[x] for x in LOWER_AZ)
RELATION = "at array<int>, groups array<long>"


def tokens(text: str) -> list[bytes]:
    """Words in order; BREAK between pieces, empty strings to be left out."""
    return text.encode().translate(PREPARED).replace(BREAK, b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f); docs: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w.decode(), n) for lang, c in found.items() for w, n in c.items() if w not in (b"", BREAK)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "f"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, found.values())) > WORDS:
                yield out()
        yield out()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def runs_of(ids: np.ndarray, length: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, groups) of the runs of a text, each of length positions and the overlap: ids of its words, 0 for infrequent ones, -1 for breaks, -2 for nothing."""
    ids = ids[ids != -2]
    for at in range(0, len(ids), length):
        part = ids[at : at + length + longest - 1]
        where = np.nonzero(part > 0)[0]
        if len(where) > 1:
            yield where.astype(np.int32), part[where] - 1


def relation(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Runs as a batch; rows: positions, groups."""
    offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32))
    flat = [pa.array(np.concatenate([r[i] for r in rows]) if rows else [], t) for i, t in enumerate((pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, x) for x in flat], ["at", "groups"])


class Known(dict):
    """Ids of frequent words; any other is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def words_at(docs: DataFrame, frequent: DataFrame, many: int, longest: int) -> DataFrame:
    """R1: runs of frequent words. frequent: id, lang, word."""
    spark, sent = docs.sparkSession, None
    if many <= BROADCAST:
        rows = frequent.select("id", "lang", "word").toArrow()
        sent = spark.sparkContext.broadcast([rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["id"].to_numpy()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Known] = {}
        for lang, word, k in zip(*sent.value, strict=True):
            known.setdefault(lang, Known({b"": -2, BREAK: -1}))[word.encode()] = int(k) + 1
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang in known:
                    words = tokens(text)
                    ids = np.fromiter(map(known[lang].__getitem__, words), np.int64, len(words))
                    rows += runs_of(ids, RUN, longest)
            yield relation(rows)

    if sent:
        return docs.mapInArrow(run, RELATION)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, stretches = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w.decode() for w in tokens(text) if w]
                for at in range(0, len(words), RUN):
                    langs.append(lang)
                    stretches.append(words[at : at + RUN + longest - 1])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(stretches, pa.list_(pa.string()))], ["lang", "words"])

    # a break is no frequent word, so the join leaves its place empty
    stretches = materialize(docs.mapInArrow(spelled, "lang string, words array<string>").withColumn("run", F.monotonically_increasing_id()), "stretches")
    return gathered(stretches.select("lang", "run", F.posexplode("words").alias("at", "word")).join(frequent.select("lang", "word", F.col("id").alias("group")), ["lang", "word"]))


def gathered(rows: DataFrame) -> DataFrame:
    """Runs of rows (run, at, group), a run's rows bounded by its length."""
    return rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "group"))).alias("p")).select(F.col("p.at").alias("at"), F.col("p.group").alias("groups"))


def adjacent(b: pa.RecordBatch, edge: int) -> tuple[np.ndarray, ...]:
    """(row, position, first group, second group) of the neighbours in a batch of runs, in order, that begin before edge."""
    where, group = (b.column(i).flatten().to_numpy() for i in (0, 1))
    row = np.repeat(np.arange(b.num_rows), np.diff(b.column(0).offsets.to_numpy()))
    here = np.nonzero((row[1:] == row[:-1]) & (where[1:] == where[:-1] + 1) & (where[:-1] < edge))[0]
    return row[here], where[here], group[here], group[here + 1]


def pair_counts(runs: DataFrame) -> DataFrame:
    """(a, b, f): how often group b follows group a. What a run holds of the next one is counted there."""

    def summed(parts: list) -> pa.RecordBatch:
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        parts.clear()
        # ids are dense, so that two of them fit one number; beyond three billion groups pairs go one by one
        m = int(b.max()) + 1 if len(b) else 1
        if len(a) and int(a.max()) * m >= 1 << 62:
            n = np.ones(len(a), np.int64)
        else:
            code, n = np.unique(a * m + b, return_counts=True)
            a, b = np.divmod(code, m)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            parts.append(adjacent(batch, RUN)[2:])
            many += len(parts[-1][0])
            if many > OCCURRENCES:
                many = 0
                yield summed(parts)
        yield summed(parts)

    return runs.mapInArrow(run, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f"))


def extended(runs: DataFrame, frequent: DataFrame, many: int, length: int, longest: int) -> DataFrame:
    """R(length): the neighbours of the relation before whose pair is frequent. frequent: id, a, b."""
    # a phrase may begin where longer ones of this run still reach
    edge = RUN + longest - length
    if many > BROADCAST:
        each = materialize(runs.withColumn("run", F.monotonically_increasing_id()), "runs").select("run", "at", "groups", F.posexplode("at").alias("i", "p"))
        after = lambda c: F.try_element_at(c, F.col("i") + 2)
        pairs = each.where((after("at") == F.col("p") + 1) & (F.col("p") < edge)).select("run", F.col("p").alias("at"), F.element_at("groups", F.col("i") + 1).alias("a"), after("groups").alias("b"))
        return gathered(pairs.join(frequent.select("a", "b", F.col("id").alias("group")), ["a", "b"]))
    rows = frequent.select("a", "b", "id").toArrow()
    a, b, k = (rows[c].to_numpy() for c in ("a", "b", "id"))
    order = np.lexsort((b, a))
    sent = runs.sparkSession.sparkContext.broadcast((a[order], b[order], k[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, k = sent.value
        left, right = np.unique(a), np.unique(b)
        code = np.searchsorted(left, a) * len(right) + np.searchsorted(right, b)  # in order, as (a, b) are

        def places(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i = np.minimum(np.searchsorted(among, x), len(among) - 1)
            return i, among[i] == x

        for batch in batches:
            row, at, x, y = adjacent(batch, edge)
            i, known = places(x, left)
            j, known_too = places(y, right)
            c, frequent_too = places(i * len(right) + j, code)
            hit = np.nonzero(known & known_too & frequent_too)[0]
            row, at, group = row[hit], at[hit], k[c[hit]]
            bounds = [0, *(np.nonzero(row[1:] != row[:-1])[0] + 1).tolist(), len(row)]
            yield relation([(at[lo:hi], group[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False) if hi - lo > 1])

    return runs.mapInArrow(run, RELATION)


def numbered(groups: DataFrame, key: list[str]) -> DataFrame:
    """Frequent groups with id, dense from 0."""
    keyed = groups.withColumn("_key", F.struct(*key)).withColumn("_all", F.lit(0))
    return materialize(ordinals(keyed, "_all", "_key", "id").drop("_key", "_all"), "groups")


def frequent_groups(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and for each length from 1 its frequent groups (id, lang, words, f, heads, tails, a, b).

    docs: lang, text, neither null. heads and tails hold f of the first and last 1, 2, ... words of a
    phrase, itself last; a and b are the groups of its first and last length - 1 words.
    """
    counted = materialize(word_counts(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    first = numbered(counted.where(F.col("f") >= least), ["lang", "word"])
    nothing = F.lit(None).cast("long")
    levels = [first.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), nothing.alias("a"), nothing.alias("b"))]
    many = first.count()
    runs = materialize(words_at(docs, first, many, longest), "occurrences") if many else None
    for length in range(2, longest + 1):
        if not many:
            break
        pairs = numbered(pair_counts(runs).where(F.col("f") >= least), ["a", "b"])
        many = pairs.count()
        below = levels[-1]
        head = below.select(F.col("id").alias("a"), "lang", F.col("words").alias("hw"), "heads")
        tail = below.select(F.col("id").alias("b"), F.element_at("words", -1).alias("tw"), "tails")
        grown = pairs.join(head, "a").join(tail, "b")
        own = F.array("f")
        levels.append(materialize(grown.select("id", "lang", F.concat("hw", F.array("tw")).alias("words"), "f", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails"), "a", "b"), "phrases"))
        if many and length < longest:
            runs = materialize(extended(runs, pairs, many, length, longest), "occurrences")
    return totals, levels


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to longest words.

    docs: lang, text; other columns are ignored. Null languages are `und`, null texts empty. Pieces end at
    marks and line ends; phrases lie within pieces. A phrase occurs a >= least times; cut after its first k
    words, l and r are the counts of its parts, and the cut of least floor(1000 a n / (l r)) counts, the
    first of equals. A phrase inside a longer one that occurs as often is left out. Repeated rows count
    each. Empty tables give no rows. Products are decimals of 38 digits.
    """
    ship(docs.sparkSession)
    clean = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    totals, levels = frequent_groups(clean, longest, least)
    out = None
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            above = levels[k]
            # counts never grow with length, so a longer phrase that occurs as often has one of k + 1 words in between that does too
            inside = above.select(F.explode(F.array("a", "b")).alias("id"), F.col("f")).distinct()
            level = level.join(inside, ["id", "f"], "left_anti")
        level = level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "heads", "tails")
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, heads array<long>, tails array<long>")
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = out.join(totals, "lang").select("lang", "phrase", "a", "n", F.posexplode(F.slice("heads", 1, F.size("heads") - 1)).alias("k", "l"), "tails")
    cuts = cuts.select("lang", "phrase", "a", "n", "k", "l", F.element_at("tails", F.size("tails") - F.col("k") - 1).alias("r"))
    top_side, low_side = F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r"))
    cuts = cuts.withColumn("t", top_side.cast("decimal(38,0)")).withColumn("d", low_side.cast("decimal(38,0)")).withColumn("score", F.expr("t div d"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
