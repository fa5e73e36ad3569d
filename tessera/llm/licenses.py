"""Licence scans: a trained paragraph classifier, confirmed against templates.

A multinomial logistic regression over word unigrams and bigrams is trained on the templates below
(whole, cut and set among ordinary words) against an unknown class of ordinary paragraphs of the
corpus. Its temperature is fitted on examples held back. It predicts a paragraph's family by
calibrated probability; the prediction counts if the paragraph holds enough of the shingles of one
of that family's templates.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .decontam import words_of

UNKNOWN = "unknown"
# Usual notices of the licence families.
TEMPLATES = {
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0."),
    "BSD": ("Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v2.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
#: Expected number of documents that lend the paragraphs of the unknown class, and the most paragraphs.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 500, 3000
#: Share of a template's two-word shingles that a paragraph must hold.
CONFIRM = 0.75


def _grams(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [(w,) for w in words] + list(zip(words, words[1:], strict=False))


class Classifier:
    """Weights of the templates' n-grams by family; the last class is unknown."""

    def __init__(self, ordinary: list[str], seed: int = 7):
        self.families = sorted(TEMPLATES)
        self.templates = [(f, frozenset(zip(w, w[1:], strict=False))) for f in self.families for t in TEMPLATES[f] for w in [words_of(t)]]
        self.pairs = frozenset().union(*(s for _, s in self.templates))
        self.number = {g: i for i, g in enumerate(sorted({g for f in self.families for t in TEMPLATES[f] for g in _grams(words_of(t))}))}
        rng = random.Random(seed)
        noise = sorted({w for t in ordinary for w in words_of(t)}) or [b"word"]
        rows, labels = [], []
        for k, f in enumerate(self.families):
            for t in TEMPLATES[f]:
                w = words_of(t)
                for _ in range(40):
                    part = [x for x in w if rng.random() > 0.1] if rng.random() < 0.5 else w
                    around = [rng.choice(noise) for _ in range(rng.choice((0, 0, 3, 12)))]
                    cut = rng.randrange(len(around) + 1)
                    rows.append(around[:cut] + part + around[cut:])
                    labels.append(k)
        clean = [w for t in ordinary if not self._confirm(w := words_of(t))]
        # ordinary paragraphs, and shuffled pieces of notices, which say nothing in their order
        for w in clean + [rng.sample(w, max(1, len(w) // 3)) for f in self.families for t in TEMPLATES[f] for w in [words_of(t)] for _ in range(10)]:
            rows.append(w)
            labels.append(len(self.families))
        x = np.zeros((len(rows), len(self.number) + 1), np.float32)
        for i, w in enumerate(rows):
            x[i] = self._vector(w)
        y = np.eye(len(self.families) + 1, dtype=np.float32)[labels]
        held = np.arange(len(rows)) % 5 == 0
        self.weights = np.zeros((x.shape[1], y.shape[1]), np.float32)
        # classes weigh alike; a convex loss, by accelerated gradient steps of a safe length
        each = (1 / np.maximum(y[~held].sum(0), 1))[y[~held].argmax(1)][:, None] / y.shape[1]
        move, xt, yt = np.zeros_like(self.weights), x[~held], y[~held]
        for _ in range(400):
            p = _softmax(xt @ (self.weights + 0.9 * move))
            move = 0.9 * move - 4.0 * (xt.T @ ((p - yt) * each) + 1e-5 * self.weights)
            self.weights += move
        scores = x[held] @ self.weights
        self.temperature = min((float(t) for t in np.geomspace(0.25, 4, 17)), key=lambda t: -float(np.log(np.maximum((_softmax(scores / t) * y[held]).sum(1), 1e-9)).mean()))

    def _vector(self, words: list[bytes]) -> np.ndarray:
        v = np.zeros(len(self.number) + 1, np.float32)
        for g, n in Counter(g for g in _grams(words) if g in self.number).items():
            v[self.number[g]] = 1 + np.log(n)
        v[:-1] /= max(1.0, float(np.sqrt((v * v).sum())))
        v[-1] = 1.0
        return v

    def _confirm(self, words: list[bytes]) -> dict[str, float]:
        """The best share of a template's shingles by family, where it is CONFIRM or more."""
        own, found = set(zip(words, words[1:], strict=False)), {}
        for f, s in self.templates:
            if s and (share := len(own & s) / len(s)) >= CONFIRM:
                found[f] = max(found.get(f, 0.0), share)
        return found

    def label(self, words: list[bytes]) -> tuple[str, float, float] | None:
        """(family, probability, template share) of a paragraph, or None if it is no notice.

        The classifier predicts; its family counts if it is not the unknown one and if the paragraph
        holds enough of one of its templates. A paragraph without any pair of words of a template
        can't be confirmed and is not looked at.
        """
        if not any(p in self.pairs for p in zip(words, words[1:], strict=False)):
            return None
        p = _softmax(self._vector(words)[None, :] @ self.weights / self.temperature)[0]
        best = int(p.argmax())
        if best == len(self.families):
            return None
        share = self._confirm(words).get(self.families[best])
        return None if share is None else (self.families[best], float(p[best]), share)

    def notices(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, share) of the notices of a text, in order.

        A line is a paragraph by itself; neighbouring lines that share words with templates and
        are no notices by themselves are one paragraph (blank lines and others end it), so wrapped
        notices and comment blocks are found. Its line is that of its first.
        """
        found: list[tuple[int, str, float, float]] = []
        open_from, lines, held = 0, 0, []

        def close() -> None:
            nonlocal lines, held
            if lines > 1 and (got := self.label(held)):
                found.append((open_from, *got))
            lines, held = 0, []

        for k, line in enumerate(text.split("\n")):
            words = words_of(line)
            # the last words of a line and the first of the next may be all that it shares
            touching = words and (any(p in self.pairs for p in zip(words, words[1:], strict=False)) or bool(held) and (held[-1], words[0]) in self.pairs)
            got = self.label(words) if touching else None
            if got or not touching:
                close()
                if got:
                    found.append((k, *got))
                continue
            if not lines:
                open_from = k
            lines += 1
            held.extend(words)
        close()
        return sorted(found)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, families, n_notices, notices) per row of docs.

    Paragraphs are lines, and neighbouring lines that look like one wrapped notice. families: names
    of the families found, sorted and comma-joined (empty: none); notices: (line from 0, family,
    probability, template share) in order. Null and empty texts have none, an empty table gives
    none, repeated rows are scanned each. The unknown class learns from at most
    SAMPLE_PARAGRAPHS paragraphs of about SAMPLE_DOCS documents of least hash.
    """
    spark, src = docs.sparkSession, texts(docs)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = src.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("p"))
    ordinary = [r["p"] for r in picked.select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).collect()]
    shared = spark.sparkContext.broadcast(Classifier(ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
        for b in batches:
            notices = [[dict(zip(("line", "family", "probability", "share"), got, strict=True)) for got in model.notices(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(sorted({x["family"] for x in n})) for n in notices]), pa.array([len(n) for n in notices], pa.int64()), pa.array(notices, kind)], ["doc_id", "families", "n_notices", "notices"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, families string, n_notices long, notices array<struct<line:int,family:string,probability:double,share:double>>")
