"""Licence scans: wrapped notices, and every paragraph of the tables by a plain version."""

from __future__ import annotations

import math
import time
from collections import Counter

from tessera.llm import licenses
from tessera.llm.common import table

MIT = """/* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or later."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""


def test_wrapped_notices(docs_of):
    filler = [(100 + i, "ordinary words of the day\nand the terms of a garden under the sun\nthis work is hard") for i in range(30)]
    rows = [(1, f"int main\n\n{MIT}\n\nint x"), (2, GPL), (3, f"prose before\n{BSD}\nprose after"), (4, "this software\nfree of charge\nwithout restriction"), (5, f"{GPL}\n\nReleased under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows + filler)).collect()}
    assert [got[k]["families"] for k in range(1, 6)] == ["MIT", "GPL", "BSD", "", "GPL,MIT"]
    assert [n["line"] for n in got[1]["notices"]] == [2] and [n["line"] for n in got[5]["notices"]] == [0, 4]
    assert not any(got[100 + i]["families"] for i in range(30))


def test_small_and_long_texts(docs_of):
    rows = [(1, ""), (1, ""), (2, None), (None, "Released under the MIT License."), (3, "word " * 400_000), (4, "line\n" * 100_000 + "Released under the MIT License.")]
    got = sorted((str(r["doc_id"]), r["families"], r["n_notices"]) for r in licenses.scan(docs_of(rows)).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "", 0), ("4", "MIT", 1), ("None", "MIT", 1)]


def plain_label(model, words):
    """Softmax over dictionaries of n-grams, and shares of all templates, for each paragraph."""
    grams = Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))
    v = {model.number[g]: 1 + math.log(n) for g, n in grams.items() if g in model.number}
    size = max(1.0, math.sqrt(sum(x * x for x in v.values())))
    z = [(sum(x / size * float(model.weights[i, c]) for i, x in v.items()) + float(model.weights[-1, c])) / model.temperature for c in range(len(model.families) + 1)]
    p = [math.exp(x - max(z)) for x in z]
    best = max(range(len(p)), key=lambda c: p[c])
    if best == len(model.families):
        return None
    shares = [len(set(zip(words, words[1:], strict=False)) & s) / len(s) for f, s in model.templates if f == model.families[best] and s]
    return model.families[best] if max(shares) >= licenses.CONFIRM else None


def test_on_the_tables_as_a_plain_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    model = licenses.Classifier(sorted({p for t in texts.values() for p in t.split("\n")})[:3000])
    lines = sorted({line for t in texts.values() for line in t.split("\n")} | {t for f in licenses.TEMPLATES.values() for t in f})
    for line in lines:
        words = licenses.words_of(line)
        got = model.label(words)
        assert (got[0] if got else None) == plain_label(model, words)
    got = {r["doc_id"]: set(filter(None, r["families"].split(","))) for r in licenses.scan(docs).collect()}
    for d, t in texts.items():
        assert {f for line in t.split("\n") if (f := plain_label(model, licenses.words_of(line)))} <= got[d]


def test_many_neighbouring_lines_that_look_like_a_notice():
    model = licenses.Classifier(["ordinary words of the day", "the terms of a garden under the sun"])
    took = []
    for n in (30_000, 240_000):
        began = time.process_time()
        assert model.notices("under the terms of\n" * n + "Released under the MIT License.")[-1][:2] == (n, "MIT")
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 5
