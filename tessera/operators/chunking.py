"""Fallback chunks of documents without sections: windows and packed blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WORD

TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"
_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Settings:
    maximum: int = 450
    overlap: int = 45

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.maximum:
            raise ValueError("overlap must be less than maximum")


def windows(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, window, first_token, n_tokens): windows of each text by tokens, up to the first that reaches the end.

    Texts of at most maximum tokens are one window, empty ones none.
    """
    n, step = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)), settings.maximum - settings.overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - settings.maximum) / F.lit(float(step))).cast("int"))
    counted = docs.select("doc_id", n.alias("n")).where("n > 0")
    spread = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    first = F.col("window") * step
    return spread.select("doc_id", "window", first.alias("first_token"), F.least(F.lit(settings.maximum), F.col("n") - first).alias("n_tokens"))


def packed(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, chunk, text, tokens, first_block, last_block): blocks in order, up to maximum tokens, with a tail carried over.

    The tail of a full chunk of at most overlap tokens opens the next one unless that overflows. A
    block longer than maximum stands alone in windows. Rows of a document stream through one task.
    """
    most, tail = settings.maximum, settings.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, size, n = None, [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, size, n
            if held:
                out.append((doc, n, "\n".join(t for _, t, _ in held), size, held[0][0], held[-1][0]))
                n += 1

        for b in batches:
            for did, pos, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if did != doc:
                    close()
                    doc, held, size, n = did, [], 0, 0
                spans = [m.span() for m in _TOKEN.finditer(text)]
                pieces = [(pos, text, len(spans))]
                if len(spans) > most:
                    pieces = []
                    for at in range(0, len(spans), most - tail):
                        end = min(at + most, len(spans))
                        pieces.append((pos, text[0 if at == 0 else spans[at][0] : len(text) if end == len(spans) else spans[end - 1][1]], end - at))
                        if end == len(spans):
                            break
                for piece in pieces:
                    if held and size + piece[2] > most:
                        close()
                        kept, total = [], 0
                        for old in reversed(held):
                            if total + old[2] > tail:
                                break
                            kept.insert(0, old)
                            total += old[2]
                        held, size = (kept, total) if total + piece[2] <= most else ([], 0)
                    held.append(piece)
                    size += piece[2]
            if out:
                yield batch(out)
                out.clear()
        close()
        if out:
            yield batch(out)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[blocks.schema["doc_id"].dataType.simpleString()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (arrow, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "chunk", "text", "tokens", "first_block", "last_block"])

    ordered = blocks.select("doc_id", F.col("pos").cast("int").alias("pos"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return ordered.mapInArrow(run, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, chunk int, text string, tokens int, first_block int, last_block int")


def side(path: Column) -> Column:
    """The one side that a path's words name, or unknown."""
    words = F.split(F.lower(path), r"[^a-z]+")
    named = F.filter(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, w.split()))), k) for k, w in {"aff": "aff affirmative", "neg": "neg negative", "gov": "gov government", "opp": "opp opposition"}.items()]), lambda x: x.isNotNull())
    return F.when(F.size(named) == 1, named[0]).otherwise("unknown")
