"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Every window of as many words as an item has is a candidate. A window that is similar enough must
hold a known share of the benchmark's shingles; running counts of those pass over all other
windows without loss. The SimHash of each window left is looked up in a multi-index of the items'
fingerprints: bits fall into blocks, and two fingerprints within RADIUS bits must agree in some
block up to RADIUS // BLOCKS bits, so tables of those small balls find all of them. Exact
weighted (multiset) shingle similarity then decides. Fingerprints of similar windows can lie further
apart, so the windows that hold enough of one item's own shingles are compared as well: none is
lost. A text of fewer words than an item is one window.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import texts

SHINGLE = 3
SIMILARITY = 0.5
RADIUS, BLOCKS, BLOCK_BITS = 24, 8, 8
#: Items and their characters that one pass over the documents takes; more items take more passes.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 20_000_000
#: Positions of a document looked at together; bounds the memory that a very long text takes.
SPAN = 1 << 16

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits (ASCII punctuation and white space part them)."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1 | 1


def _codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of size words; runs with an unknown word (0) give 0."""
    n = len(hashes) - size + 1
    code, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = hashes[k : k + n]
        code = code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        ok &= part > 0
    code ^= code >> np.uint64(31)
    return np.where(ok, code | np.uint64(1), np.uint64(0))


def _bits(codes: np.ndarray) -> np.ndarray:
    """64 votes of +1 or -1 for each shingle."""
    x = codes * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def _pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1)  # a row of 8 blocks of 8 bits


#: All bytes within RADIUS // BLOCKS bits of 0.
BALL = np.array([sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)], np.uint8)


def least_shared(shingles: int, others: int) -> int:
    """Shingles that two sequences of so many shingles share at least at SIMILARITY."""
    return max(1, math.ceil(SIMILARITY / (1 + SIMILARITY) * (shingles + others) - 1e-9))


def need(shingles: int) -> int:
    """Shingles that two sequences of so many shingles each share at least at SIMILARITY."""
    return max(1, math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * shingles - 1e-9))


class Index:
    """Items of one pass by their length in words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hashes: dict[bytes, int] = {}
        self.items: list[tuple[int, int, int, Counter]] = []  # id, words, shingles, counts of codes
        self.by_code: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # by shingle size
        grouped: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in sorted(items):
            ids = np.array([self.hashes.setdefault(w, _hash(w)) for w in words_of(text)], np.int64)
            if len(ids):
                size = min(SHINGLE, len(ids))
                codes, k = _codes(ids, size), len(self.items)
                self.items.append((item_id, len(ids), len(codes), Counter(codes.tolist())))
                grouped[len(ids)].append((k, _pack(_bits(codes).sum(0, dtype=np.int64)[None, :])[0]))
                for c in set(codes.tolist()):
                    self.by_code[size][c].append(k)
        self.by_code = {s: dict(x) for s, x in self.by_code.items()}
        self.known = {s: np.sort(np.array(list(x), np.uint64)) for s, x in self.by_code.items()}
        self.fewest = {s: min(need(n) for _, w, n, _ in self.items if min(SHINGLE, w) == s) for s in self.by_code}
        self.by_length = {}
        for length, members in grouped.items():
            f = np.stack([x for _, x in members])
            tables: list[dict[int, list[int]]] = []  # for each block, by value: members within the ball
            for b in range(BLOCKS):
                t: dict[int, list[int]] = defaultdict(list)
                for at, v in enumerate(f[:, b]):
                    for x in (BALL ^ v).tolist():
                        t[x].append(at)
                tables.append(dict(t))
            self.by_length[length] = ([k for k, _ in members], f, tables)

    def matches(self, ids: np.ndarray, words: list[bytes], whole: bool) -> dict[int, tuple[float, int, int]]:
        """The items in a run of words: item: (-similarity, start, Hamming distance) of the best window.

        ids: the hashes of words that the items have, 0 for others. whole: the run is a whole text,
        which is also a window for the items of more words.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for size, known in self.known.items():
            if len(ids) < size:
                continue
            codes = _codes(ids, size)
            live = np.flatnonzero(codes)
            at = np.minimum(np.searchsorted(known, codes[live]), len(known) - 1)
            live = live[known[at] == codes[live]]
            if len(live) < (min(self.fewest[size], least_shared(len(codes), len(codes) + 1)) if whole else self.fewest[size]):
                continue
            shared: Counter = Counter()
            for c in codes[live].tolist():
                shared.update(self.by_code[size][c])
            near = sorted(k for k, n in shared.items() if n >= need(self.items[k][2]) and self.items[k][2] <= len(codes))
            longer = sorted(k for k, n in shared.items() if whole and self.items[k][2] > len(codes) and n >= least_shared(len(codes), self.items[k][2]))
            if not near and not longer:
                continue
            lengths = {self.items[k][1] for k in near}
            running = np.zeros(len(codes) + 1, np.int64)
            running[live + 1] = 1
            np.cumsum(running, out=running)
            votes = None
            for length in sorted(lengths):
                m = length - size + 1
                starts = np.flatnonzero(running[m:] - running[:-m] >= need(m))
                if not len(starts):
                    continue
                if votes is None:
                    codes = _codes(np.array([_hash(w) for w in words], np.int64), size)  # now of all words
                    votes = np.zeros((len(codes) + 1, 64), np.int32)
                    np.cumsum(_bits(codes), axis=0, out=votes[1:])
                self._verify(codes, starts, _pack(votes[starts + m] - votes[starts]), length, m, best)
            if votes is None:
                codes = _codes(np.array([_hash(w) for w in words], np.int64), size)
            for k in near + longer:
                self._compare(codes, k, best)
        return best

    def _compare(self, codes: np.ndarray, k: int, best: dict) -> None:
        """The best of all windows of codes for one item; all of codes is one where the item is longer."""
        _, length, shingles, counts = self.items[k]
        m = min(shingles, len(codes))
        running = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(np.isin(codes, np.array(list(counts), np.uint64)), out=running[1:])
        top = None
        for s in np.flatnonzero(running[m:] - running[:-m] >= least_shared(m, shingles)).tolist():
            both = sum((Counter(codes[s : s + m].tolist()) & counts).values())
            similarity = both / (m + shingles - both)
            if similarity >= SIMILARITY and (top is None or similarity > -top[0]):
                top = (-similarity, s)
        if top and top < best.get(k, (0.0, 0, 0))[:2]:
            members, f, _ = self.by_length[length]
            own = _pack(_bits(codes[top[1] : top[1] + m]).sum(0, dtype=np.int64)[None, :])[0]
            best[k] = (*top, int(np.bitwise_count(f[members.index(k)] ^ own).sum()))

    def _verify(self, codes: np.ndarray, starts: np.ndarray, fps: np.ndarray, length: int, m: int, best: dict) -> None:
        members, f, tables = self.by_length[length]
        for s, fp in zip(starts.tolist(), fps, strict=True):
            found = set().union(*(tables[b].get(v, ()) for b, v in enumerate(fp.tolist())))
            counts = None
            for at in found:
                distance = int(np.bitwise_count(f[at] ^ fp).sum())
                if distance > RADIUS:
                    continue
                if counts is None:
                    counts = Counter(codes[s : s + m].tolist())
                k = members[at]
                both = sum((counts & self.items[k][3]).values())
                similarity = both / (2 * m - both)
                if similarity >= SIMILARITY:
                    best[k] = min(best.get(k, (0.0, 0, 0)), (-similarity, s, distance))


def search(text: str, index: Index) -> list[tuple[int, int, int, float, int]]:
    """(item_id, start, end, similarity, hamming) of a whole text, in words, by item."""
    get, words = index.hashes.get, words_of(text)
    ids = np.array([get(w, 0) for w in words], np.int64)
    longest = max((w for _, w, _, _ in index.items), default=0)
    best: dict[int, tuple[float, int, int]] = {}
    # a text shorter than some item is whole in the first run
    for at in range(0, max(1, len(ids)) if len(words) >= longest else 1, SPAN):
        for k, (similarity, start, distance) in index.matches(ids[at : at + SPAN + longest], words[at : at + SPAN + longest], len(words) < longest).items():
            best[k] = min(best.get(k, (0.0, 0, 0)), (similarity, at + start, distance))
    return [(index.items[k][0], s, min(s + index.items[k][1], len(words)), -sim, d) for k, (sim, s, d) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, similarity, hamming): for each row of docs and each item in it, the best window.

    A text of fewer words than an item is one window. start and end count words, end exclusive; of equal windows the first is reported. Null and
    empty texts and items match nothing; items of one or two words are one shingle and match
    themselves. Items are taken in passes of about ITEMS_A_PASS, so no pass broadcasts more;
    repeated items with one id are reported for each text that the id has. Repeated rows of docs
    are reported each.
    """
    src = texts(docs)
    kind, item_kind = src.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    names, arrow_item = ["doc_id", "item_id", "start", "end", "similarity", "hamming"], to_arrow_type(item_kind)
    out = None
    for shared in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                take, found = [], []
                for at, t in enumerate(b.column(1).to_pylist()):
                    got = search(t, index) if index.items else []
                    found += got
                    take += [at] * len(got)
                kinds = (arrow_item, pa.int64(), pa.int64(), pa.float64(), pa.int32())
                cols = [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), *cols], names)

        part = src.mapInArrow(run, f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start long, end long, similarity double, hamming int")
        out = part if out is None else out.unionByName(part)
    return out


def _passes(benchmark: DataFrame) -> list[Broadcast]:
    """The items in broadcasts of about ITEMS_A_PASS; at least one, which may be empty."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").alias("item_text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size["n"] // ITEMS_A_PASS), -(-size["chars"] // CHARS_A_PASS))
    share = benchmark.sparkSession.sparkContext.broadcast
    return [share([(r["item_id"], r["item_text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(passes)) == k).collect()]) for k in range(passes)]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for shared in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                yield b.filter(pa.array([not index.items or not search(t or "", index) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
