"""Toxicity by nearest labelled examples.

Labelled examples are TF-IDF vectors over all words that occur in them. Inverse document
frequencies come from all documents, and each is scaled by how strongly the word tells the labels
apart (log-likelihood ratio over the examples), never below a floor, so no word is dropped. The
vectors lie in a block-max inverted index: queries multiply the few longest lists as a matrix, go
through short lists, take the greatest weights by block of those in between as bounds, look into
blocks in falling order of bound, and stop where no block can enter the nearest k, so the result is
the exact k nearest by cosine. Distance-weighted votes are calibrated on the examples, each left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_table

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
#: Postings of a term above which blocks of its list are bounded before they are looked at, and
#: how many of the longest lists are kept as rows of a matrix and multiplied for TEXTS texts at a time.
LONG, DENSE, TEXTS = 2048, 512, 64
#: Calibration: votes, and the scores that they stand for.
Levels = tuple[np.ndarray, np.ndarray]
LEVEL = (np.zeros(1), np.zeros(1))
#: Texts whose scores a task remembers.
REMEMBERED = 20_000


@dataclass(frozen=True)
class Settings:
    per_class: int = 8192  # labelled examples kept of each class, those of least hash
    floor: float = 0.05  # share of its inverse document frequency that a word keeps though it tells nothing
    evidence: float = 26.0  # log-likelihood ratio at which half of a word's evidence counts
    k: int = 8
    prior_weight: float = 0.5


class Folded(dict):
    """Lower case of a character beyond ASCII, with spaces for what is no letter."""

    def __missing__(self, char: str) -> str:
        if len(self) >= 50_000:
            self.clear()
        self[char] = low = "".join(c if WORD.match(c) else " " for c in char.lower())
        return low


FOLDED = Folded()
#: The same for ASCII; bytes of other characters stay.
ASCII = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """WORD in the lower-cased text, as UTF-8."""
    if not text.isascii():
        if "\u03a3" in text:  # whose lower case depends on its place
            text = text.lower()
        odd = [c for c in set(text) if c > "\x7f" and FOLDED[c] != c]
        if len(odd) > 64:
            text = text.translate({ord(c): FOLDED[c] for c in odd})
        else:
            for c in odd:
                text = text.replace(c, FOLDED[c])
    return text.encode().translate(ASCII).split()


def hashes(distinct: Collection[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)) ^ np.uint64(1 << 63)).view(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a text, rising, and how often each occurs."""
    n = Counter(words(text))
    h = hashes(n)
    at = np.argsort(h)
    return h[at], np.fromiter(n.values(), np.int32, len(n))[at]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _key(terms: np.ndarray, tf: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(terms.tobytes() + tf.tobytes())


@dataclass
class Index:
    """Examples with equal vectors are one entry with the weight of their labels."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes of the examples' words, rising
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by term
    prior: float = 0.0
    labels: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # by entry: weight of toxic examples, of all
    example: list = field(default_factory=list)  # by entry: least doc_id
    entries: dict = field(default_factory=dict)  # by key of the counts: entry
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # postings by term and entry
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    upto: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # by term: its first posting
    empty_score: float = 0.0

    def known(self, words: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of those words that examples hold."""
        if not len(self.terms):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        held = self.terms[at] == words
        return at[held].astype(np.int32), tf[held]

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = (1 + np.log(tf)) * self.weight[terms]
        return v / max(float(np.sqrt((v * v).sum())), 1e-12)

    def build(self, number: np.ndarray, tf: np.ndarray, ends: np.ndarray, labels: np.ndarray, ids: list) -> None:
        """Entries with distinct counts, one after the other: term numbers and counts up to each end, weights of labels, an id."""
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        value = tf.astype(np.float32)
        np.log(value, out=value)
        value += 1
        value *= self.weight.astype(np.float32)[number]
        size = np.sqrt(np.add.reduceat(value * value, starts, dtype=float)) if len(ends) else np.zeros(0)
        value /= np.repeat(np.maximum(size, 1e-12).astype(np.float32), ends - starts)
        # vectors with the same strongest word stand side by side, which keeps block maxima tight
        strongest = np.array([number[a + int(value[a:b].argmax())] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        order = np.lexsort((np.arange(len(ends)), strongest))
        place = np.empty(len(ends), np.int32)
        place[order] = np.arange(len(ends), dtype=np.int32)
        self.labels, self.example = labels[order].reshape(-1, 2), [ids[i] for i in order.tolist()]
        self.entries = {_key(number[a:b], tf[a:b]): int(e) for a, b, e in zip(starts.tolist(), ends.tolist(), place.tolist(), strict=True)}
        entry = np.repeat(place, ends - starts)
        at = np.lexsort((entry, number)).astype(np.int32)
        self.entry, self.value, number = entry[at].astype(np.uint16 if len(ends) < 1 << 16 else np.int32), value[at], number[at]
        del at, entry, value
        self.upto = np.searchsorted(number, np.arange(len(self.terms) + 1))
        size = np.diff(self.upto)
        self.kind = np.where(size > LONG, 1, 0).astype(np.int8)
        self.kind[np.argsort(-size, kind="stable")[:DENSE]] = 2
        # the lists in between have a greatest weight for each block of entries
        long = np.repeat(self.kind == 1, size)
        term, block, spot = number[long], self.entry[long].astype(np.int32) // BLOCK, np.flatnonzero(long)
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.block, self.most = block[first], np.maximum.reduceat(self.value[long], first) if len(first) else self.value[:0]
        self.block_from, self.block_size = spot[first], np.diff(np.append(first, len(term)))
        self.block_upto = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each term with one of the longest lists, and those lists as rows over all entries."""
        terms = np.flatnonzero(self.kind == 2)
        row, rows = np.zeros(len(self.terms), np.int32), np.zeros((len(terms), len(self.example)), np.float32)
        row[terms] = np.arange(len(terms))
        for k, t in enumerate(terms.tolist()):
            rows[k, self.entry[self.upto[t] : self.upto[t + 1]]] = self.value[self.upto[t] : self.upto[t + 1]]
        return row, rows

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (term numbers, counts) the k entries of greatest cosine above 0, ties by entry number: (cosine, entry)."""
        if not self.example:
            return [[] for _ in queries]
        row, rows = self.dense
        vectors = [self.vector(*x) if len(x[0]) else np.zeros(0) for x in queries]
        often = np.zeros((len(queries), len(rows)), np.float32)
        for i, ((terms, _), q) in enumerate(zip(queries, vectors, strict=True)):
            most = self.kind[terms] == 2
            often[i, row[terms[most]]] = q[most]
        return [self._best(terms, q, score.astype(float), k) if len(terms) else [] for (terms, _), q, score in zip(queries, vectors, often @ rows, strict=True)]

    def _best(self, terms: np.ndarray, q: np.ndarray, score: np.ndarray, k: int) -> list[tuple[float, int]]:
        """score: what the longest lists add to each entry."""
        n, few, many = len(score), self.kind[terms] == 0, self.kind[terms] == 1
        # short lists in full
        begin = self.upto[terms[few]]
        length = self.upto[terms[few] + 1] - begin
        at = _spans(begin, length)
        score += np.bincount(self.entry[at], np.repeat(q[few], length) * self.value[at], n)
        # a block's bound: its best score so far, and the greatest weight in it of each term left
        begin = self.block_upto[terms[many]]
        length = self.block_upto[terms[many] + 1] - begin
        at, share = _spans(begin, length), np.repeat(q[many], length)
        block, start = self.block[at], np.arange(0, n, BLOCK)
        best = np.maximum.reduceat(score, start)
        bound = best + np.bincount(block, share * self.most[at], len(start)) + 1e-5
        order = np.argsort(-bound)
        # scores only grow, so the k-th of the blocks' best is at any time a bound from below of the k-th best
        kth = lambda x: float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) > k else 0.0
        least, done, step = kth(best), 0, 8
        while done < len(order) and bound[order[done]] >= least:
            chosen = np.zeros(len(bound), bool)
            chosen[order[done : done + step]] = True
            here = np.flatnonzero(chosen[block])
            size = self.block_size[at[here]]
            p = _spans(self.block_from[at[here]], size)
            score += np.bincount(self.entry[p], np.repeat(share[here], size) * self.value[p], n)
            least, done, step = max(least, kth(np.maximum.reduceat(score, start))), done + step, step * 4
        # entries of blocks not looked into lie below the k-th best
        found = np.flatnonzero(score >= max(least - 2e-5, 1e-5))
        score = np.round(score[found], 5)
        top = np.lexsort((found, -score))[:k]
        return list(zip(score[top].tolist(), found[top].tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]], settings: Settings, without: tuple[int, float, float] | None = None) -> float:
        toxic, total = settings.prior_weight * self.prior, settings.prior_weight
        for cosine, e in near:
            w, (t, a) = cosine / (1.05 - min(cosine, 1.0)), self.labels[e]
            if without and without[0] == e:
                t, a = t - without[1], a - without[2]
            toxic, total = toxic + w * t, total + w * a
        return float(toxic / total) if total > 0 else self.prior


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators: levels (mean x, mean y), rising, the means smoothed by half a row each way."""
    pools: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-likelihood ratio of each word's share among toxic and clean examples against one share for both."""
    n, total = toxic + clean, max(n_toxic + n_clean, 1.0)
    part = lambda seen, size: seen * np.log(np.maximum(seen, 1e-300) / np.maximum(n * size / total, 1e-300))
    return np.maximum(2 * (part(toxic, n_toxic) + part(clean, n_clean)), 0.0)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many rows docs has, and in how many of them each term occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = Index(shared.value), 0
        n = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                found = np.sort(hashes(set(words(t))))
                n[index.known(found, found)[0]] += 1
            rows += b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], rows))], ["term", "n"])

    got = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    at, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> tuple[Broadcast, Levels]:
    """The index of labelled examples, as shared with tasks, and its calibration.

    labels: (doc_id, toxic); several rows of a document count as toxic if any is; null ids and
    labels are ignored. learn says which documents of docs may lend their labels. At most
    settings.per_class examples of either class, of least hash of the id, are learned from
    (weighted by the share of their class that they stand for); document frequencies cover all
    documents.
    """
    spark, id_kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = materialize(docs.where(learn & F.col("text").isNotNull()).select("doc_id").distinct().join(known, "doc_id"), "labelled")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [(r["doc_id"], r["toxic"]) for c in totals for r in rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class).collect()]
    kept = Counter(c for _, c in picked)
    weight = {c: totals[c] / kept[c] for c in totals}
    index = Index(prior=totals.get(1, 0) / max(1, sum(totals.values())))
    index.empty_score = index.prior
    if len(kept) < 2:
        return spark.sparkContext.broadcast(index), LEVEL
    # at most 2 * per_class rows of two numbers
    chosen = F.broadcast(small_table(spark, picked, T.StructType([T.StructField("learned_id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.IntegerType())])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counted(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w for w, _ in got], pa.list_(pa.int64())), pa.array([n for _, n in got], pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "tf"])

    seen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("learned_id")).select("doc_id", "toxic", "text")
    examples = materialize(seen.mapInArrow(count, f"doc_id {id_kind}, toxic int, words array<bigint>, tf array<int>"), "examples")
    _learn(index, examples.toArrow(), weight, lambda terms: document_frequencies(docs, terms), settings)
    shared = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            votes = []
            for lo in range(0, b.num_rows, TEXTS):
                toxic, *counts = (b.column(k).slice(lo, TEXTS).to_pylist() for k in (1, 2, 3))
                known = [index.known(np.array(words, np.int64), np.array(tf, np.int32)) for words, tf in zip(*counts, strict=True)]
                for c, x, near in zip(toxic, known, index.nearest(known, settings.k), strict=True):
                    own = index.entries.get(_key(*x))
                    votes.append(None if own is None else index.vote(near, settings, (own, weight[c] * c, weight[c])))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(votes, pa.float64())], ["toxic", "vote"])

    votes = examples.mapInArrow(left_out, "toxic int, vote double").where("vote is not null").toArrow()
    y = votes.column("toxic").to_numpy()
    return shared, isotonic(votes.column("vote").to_numpy(), y.astype(float), np.array([weight[c] for c in y.tolist()])) if len(y) else LEVEL


def _learn(index: Index, got: pa.Table, weight: dict[int, float], frequencies: Callable[[np.ndarray], tuple[int, np.ndarray]], settings: Settings) -> None:
    """Fill the index from at most 2 * per_class examples (doc_id, toxic, words, tf)."""
    lengths = pc.list_value_length(got.column("words")).to_numpy().astype(np.int64)
    toxic, ids = got.column("toxic").to_numpy(), got.column("doc_id").to_pylist()
    words, tf = (pc.list_flatten(got.column(c)).to_numpy() for c in ("words", "tf"))
    index.terms = np.unique(words)
    number = np.empty(len(words), np.int32)
    for lo in range(0, len(words), 1 << 18):
        number[lo : lo + (1 << 18)] = np.searchsorted(index.terms, words[lo : lo + (1 << 18)])
    # the driver's memory is small
    del words, got
    n_docs, df = frequencies(index.terms)
    per_word = np.repeat(toxic == 1, lengths)
    hits = [np.bincount(number[x], minlength=len(index.terms)).astype(float) for x in (per_word, ~per_word)]
    told = evidence(*hits, float((toxic == 1).sum()), float((toxic == 0).sum()))
    index.weight = (np.log((1 + n_docs) / (1 + df)) + 1e-3) * (settings.floor + (told / (told + settings.evidence)) ** 2)

    # examples with equal counts are one entry, the one of least id
    ends, blank, groups = np.cumsum(lengths), [0.0, 0.0], {}
    for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
        c, w = int(toxic[i]), weight[int(toxic[i])]
        if a == b:
            blank = [blank[0] + w * c, blank[1] + w]
            continue
        g = groups.setdefault(_key(number[a:b], tf[a:b]), [0.0, 0.0, i])
        g[0], g[1], g[2] = g[0] + w * c, g[1] + w, i if ids[i] < ids[g[2]] else g[2]
    kept = sorted(groups.values(), key=lambda g: g[2])
    at = np.array([g[2] for g in kept], np.int64)
    stays = np.zeros(len(lengths), bool)
    stays[at] = True
    stays = np.repeat(stays, lengths)
    number, tf = number[stays], tf[stays]
    index.build(number, tf, np.cumsum(lengths[at]), np.array([g[:2] for g in kept]), [ids[i] for i in at.tolist()])
    if blank[1]:
        index.empty_score = (blank[0] + 0.05) / (blank[1] + 0.1)


class Scorer:
    """Scores texts; equal texts of a task are looked up once."""

    def __init__(self, index: Index, levels: Levels, settings: Settings):
        self.index, self.levels, self.settings, self.seen = index, levels, settings, {}

    def __call__(self, texts: list[str]) -> list[tuple[float, list]]:
        """Scores, and the ids of the nearest examples, nearest first."""
        index, keys = self.index, [xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        new = list({k: t for k, t in zip(keys, texts, strict=True) if k not in self.seen}.items())
        for lo in range(0, len(new), TEXTS):
            part = new[lo : lo + TEXTS]
            for (key, _), near in zip(part, index.nearest([index.known(*counted(t)) for _, t in part], self.settings.k), strict=True):
                score = float(np.interp(index.vote(near, self.settings), *self.levels)) if near else index.empty_score
                self.seen[key] = score, [index.example[e] for _, e in near]
        return [self.seen[k] for k in keys]


def classify(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of docs; see fit() for what is learned.

    Texts without any word of an example, empty and null ones included, get the rate of toxic
    examples among texts without words (of all examples, if there are none). Without labels of
    both classes every score is the rate of label 1. evidence: doc_ids of the nearest examples,
    nearest first. Repeated rows are scored each. Ids may be of any type that can be ordered.
    """
    shared, levels = fit(docs, labels, learn, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value, levels, settings)
        for b in batches:
            got = score(b.column(2).to_pylist())
            s = np.array([x for x, _ in got], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([e for _, e in got], pa.list_(b.column(0).type))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below 0.5; null and empty texts are scored as in classify()."""
    shared, levels = fit(docs, labels, learn, settings)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value, levels, settings)
        for b in batches:
            keep = [x < 0.5 for x, _ in score([t or "" for t in b.column(at).to_pylist()])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
