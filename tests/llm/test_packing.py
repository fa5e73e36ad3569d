from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, tokenization


def slow_best_fit(lengths, capacity):
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - n)
        else:
            spaces.append(capacity - n)
    return len(spaces)


@given(st.lists(st.integers(1, 24), max_size=200))
@settings(max_examples=300, deadline=None)
def test_plan_is_whole_and_as_short_as_best_fit(lengths):
    slots = packing.plan(Counter(lengths), 24)
    used: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for n, lo, hi, first, offset in slots:
        assert hi > lo
        ranks.setdefault(n, []).extend(range(lo, hi))
        for k in range(hi - lo):
            used.setdefault(first + k, []).append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 24
    assert len(used) == slow_best_fit(lengths, 24)


@pytest.mark.parametrize("text", ["", "Hello, world!  two\n\nlines", "naïve 漢字 🎉 <|endoftext|> 12345", "  x\r\n\t'll we've", "a" * 5000])
def test_encoder_gives_the_tokenizers_ids(text):
    path = tokenization.default_vocabulary()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode, decode = tokenization.coder(path)
    assert encode(text) == t.encode(text, add_special_tokens=False).ids
    assert decode(encode(text)) == text.encode()
    t.encode_special_tokens = False
    encode, decode = tokenization.coder(path, True)
    assert encode(text) == t.encode(text, add_special_tokens=False).ids
    assert decode(encode(text)) == text.encode()


def test_pack(docs_of):
    rows = [(1, "word " * 3000), (2, None), (3, ""), (5, "a <|endoftext|> b"), (4, "some text"), (4, "some text"), (None, "x"), *[(100 + i, "tok " * i) for i in range(60)]]
    got = packing.pack(docs_of(rows)).toPandas()
    encode, texts = tokenization.coder(tokenization.default_vocabulary(), True)[0], {r[0]: r[1] for r in rows}
    assert len(got[got["doc_id"] == 4]) == 2 and len(got[got["doc_id"] == 2]) == 1
    for doc_id, part in got[got["doc_id"] != 4].dropna(subset=["doc_id"]).groupby("doc_id"):
        ids, at = np.array([*encode(texts[doc_id] or ""), 2], "<u4"), 0
        for k, p in enumerate(part.sort_values("piece").itertuples()):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            assert p.length == 1024 or k == 0
            at += p.length
        assert at == len(ids)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 1024
    assert packing.pack(docs_of([])).collect() == []
