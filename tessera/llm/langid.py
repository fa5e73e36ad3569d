"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all training texts, as (language, bucket) sums; the log-probability matrix of
languages x buckets is small whatever the corpus and is broadcast; texts are scored in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters hashed at a time; bounds the memory that batches and very long texts take.
WINDOW = 1 << 19
#: Multiplier of the polynomial hash (odd, fixed).
MIX = 0x9E3779B1


def pieces(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of at most about WINDOW code points: (code points, index of the row of each).

    A text longer than a window is cut into windows that overlap by the longest n-gram less one,
    so that every n-gram of every order is in exactly one of them (see grams()).
    """
    held, rows, size = [], [], 0
    for k, t in enumerate(batch):
        if not t:
            continue
        cp = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(cp), WINDOW):
            part = cp[max(0, at - max(ORDERS) + 1) : at + WINDOW]
            held.append((part, k, min(at, max(ORDERS) - 1)))
            size += len(part)
            if size >= WINDOW:
                yield from _joined(held)
                held, size = [], 0
    yield from _joined(held)


def _joined(held: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if held:
        lens = [len(p) for p, _, _ in held]
        row = np.repeat(np.array([k for _, k, _ in held], np.int32), lens)
        seen = np.zeros(len(row), bool)  # code points that an earlier window has ended n-grams at
        at = 0
        for n, (_, _, old) in zip(lens, held, strict=True):
            seen[at : at + old] = True
            at += n
        yield np.concatenate([p for p, _, _ in held]), np.where(seen, -1 - row, row)


def grams(cp: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of each order, by the position where they end."""
    own, new = np.where(row < 0, -1 - row, row), row >= 0
    h = np.zeros(len(cp), np.uint64)
    c = cp.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(ORDERS) + 1):
        h = c if n == 1 else h[:-1] * np.uint64(MIX) + c[n - 1 :]
        if n in ORDERS:
            ok = new[n - 1 :] & (own[n - 1 :] == own[: len(own) - n + 1])
            x = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (x[ok] >> np.uint64(49)).astype(np.int32), own[n - 1 :][ok]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of docs (text, lang), none of them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            for cp, row in pieces(b.column(0).to_pylist()):
                for bucket, own in grams(cp, row):
                    add = np.bincount(code[own] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                    for k, name in enumerate(names):
                        part = add[k * BUCKETS : (k + 1) * BUCKETS]
                        total[name] = total[name] + part if name in total else part.astype(np.int64)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Language names and float32 log probabilities (languages x buckets). No training text: no name.

    The driver gets languages x BUCKETS sums, which doesn't grow with the rows. Languages have
    equal priors, so that a source that holds much of one language does not tilt the rest.
    """
    got = counts(docs.where("text is not null and lang is not null")).toPandas()
    names = sorted(got["lang"].unique())
    m = np.full((len(names), BUCKETS), alpha)
    for k, name in enumerate(names):
        part = got[got["lang"] == name]
        m[k, part["bucket"].to_numpy()] += part["n"].to_numpy()
    return names, np.log(m / m.sum(1, keepdims=True)).astype(np.float32) if names else m.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: Column, carry_name: str) -> DataFrame:
    """(doc_id, <carry>, lang_pred, score) per row of docs, in whole texts.

    lang_pred is `und` with score 0 if the text is null, has no letter, or nothing was learned;
    else the language of the highest posterior (a tie: the first by name), and score is the
    posterior of the per-n-gram mean at the tempered length of at most 200 n-grams.
    """
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logp.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = shared.value
        for b in batches:
            batch = b.column(1).to_pylist()
            total, n = np.zeros((len(batch), len(names))), np.zeros(len(batch))
            for cp, row in pieces(batch) if names else ():
                for bucket, own in grams(cp, row):
                    if len(own):
                        cuts = np.flatnonzero(np.diff(own, prepend=-1))
                        total[own[cuts]] += np.add.reduceat(rows[bucket], cuts, axis=0, dtype=np.float64)
                        n[own[cuts]] += np.diff(np.append(cuts, len(own)))
            known = np.array([bool(names) and any(map(str.isalpha, t)) for t in batch], bool)
            if names:
                z = total * (np.minimum(n, 200) / np.maximum(n, 1))[:, None]
                p = np.exp(z - z.max(1, keepdims=True))
                best, score = p.argmax(1), p.max(1) / p.sum(1)
            else:
                best, score = np.zeros(len(batch), int), np.zeros(len(batch))
            pred = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", carry_name, "lang_pred", "score"])

    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), carry.alias(carry_name))
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"doc_id {kinds['doc_id']}, {carry_name} {kinds[carry_name]}, lang_pred string, score double")


def identify(docs: DataFrame, train_on: Column, held_out: Column) -> DataFrame:
    """Train on the rows where train_on holds and predict every row.

    Null text or lang never trains; empty tables give no row; repeated rows count as often as
    they occur; other columns are ignored.
    """
    model = train(docs.where(train_on).select("text", "lang"))
    return predict(docs, model, held_out, "held_out")
