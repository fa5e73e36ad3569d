"""Secrets, licences, language, media and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, licenses, media, secrets

SECRETS = [
    "password=hunter22 and token: \"abc\" then secret = 'x/y+z=123'", "pässwörd é token=ünï tokenAPI_KEY:   ABCDEFG", "AKIA" + "A1B2" * 4 + " AKIAAKIASHORT akia" + "0" * 20,
    "deadbeef" * 3 + "g" + "deadbeef" * 2, "secret: token = abcdefgh", "x" * 5000 + " apikey=" + "a1" * 40, "", None, "🎉🎉 passwd:🎉 secret=abcdef🎉", "Token=aaaaaa Token=aaaaaa",
]


def slow_base(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_rules(docs_of):
    df = docs_of(list(enumerate(SECRETS)))
    got = {r["doc_id"]: r for r in secrets.find(df).collect()}
    for k, t in enumerate(SECRETS):
        assert [tuple(s) for s in got[k]["base"]] == slow_base(t or ""), t
        assert set(map(tuple, got[k]["base"])) <= set(map(tuple, got[k]["spans"]))
    plan = secrets.find(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert secrets.find(docs_of([])).collect() == []


def test_markov_models_tell_random_from_words(docs_of):
    rng = random.Random(2)
    rnd = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = [(i, f"the internationalization of understanding recommendations {'otherwise considerations'} token={rnd(30)}") for i in range(200)]
    rows += [(1000, f"see {rnd(32)} here"), (1001, "see internationalizationrecommendations here")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find(docs_of(rows)).collect()}
    assert [s["kind"] for s in got[1000]] == [3] and got[1001] == []


def test_redact(docs_of):
    df = docs_of([(1, "keep password=hunter22 this"), (2, "clean"), (3, None), (4, "token=" + "deadbeef" * 4)])
    got = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"], got[4]["text"]) == ("keep [secret] this", "clean", None, "[secret]")
    assert got[1]["n_chars"] == len("keep [secret] this") and got[2]["n_chars"] == 5 and secrets.redact(df).columns == df.columns


def test_licenses(docs_of):
    filler = [(100 + i, "ordinary words of the day\nand the terms of a garden under the sun\nthis work is hard") for i in range(30)]
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "RELEASED UNDER THE MIT LICENSE!!!"), (3, "Licensed under the Apache License, Version 2.0."), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, "we licensed the song under a new label"), (7, None), (8, ""), (9, "a license to drive, version 3 of the public form")]
    got = {r["doc_id"]: r["families"] for r in licenses.scan(docs_of(rows + filler)).collect()}
    assert [got[k] for k in range(1, 10)] == ["MIT", "MIT", "Apache-2.0", "GPL", "CC-BY-NC", "", "", "", ""]
    assert all(got[100 + i] == "" for i in range(30))
    assert licenses.scan(docs_of([])).collect() == []


def slow_grams(text):
    out = Counter()
    cps = [ord(c) + 1 for c in text.lower()]
    for n in langid.ORDERS:
        for i in range(len(cps) - n + 1):
            h = 0
            for c in cps[i : i + n]:
                h = (h * langid.MIX + c) % 2**64
            out[((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> 49] += 1
    return out


@pytest.mark.parametrize("window", [1 << 19, 7, 3])
def test_grams_whatever_the_window(monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    texts = ["Hello wörld", "", "ab", "a", "some longer text here, 漢字 🎉"]
    got = [Counter() for _ in texts]
    for cp, row in langid.pieces(texts):
        for bucket, own in langid.grams(cp, row):
            for b, r in zip(bucket.tolist(), own.tolist(), strict=True):
                got[r][b] += 1
    assert got == [slow_grams(t) for t in texts]


def test_language(docs_of):
    en, de = "the cat and the dog went to the house with them", "der hund und die katze sind mit ihnen in das haus gegangen"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)] + [(50, None, "en"), (51, "", "de"), (52, "123 !?", "en"), (53, "the house and the dog", None), (54, "die katze und das haus", "zz"), (54, "die katze und das haus", "zz")]
    got = langid.identify(docs_of(rows), F.col("doc_id") < 20, F.col("doc_id") >= 20).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in got}
    assert by[50] == by[51] == by[52] == ("und", True) and by[53][0] == "en" and by[54][0] == "de" and by[0] == ("de", False)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs_of(rows), F.lit(False), F.lit(True)).collect()} == {"und"}
    assert langid.identify(docs_of([]), F.lit(True), F.lit(False)).collect() == []


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize(("predictor", "tile", "order"), [(1, 0, "<"), (2, 0, ">"), (1, 16, "<"), (2, 32, ">")])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 1025):
        payload = bytes(rng.integers(0, 4, 64 * n, dtype=np.uint8)) if n != 300 else bytes(64 * n)
        data = media.encode(payload, compression, predictor, tile, order)
        assert b"".join(p[6].tobytes() for p in media.pages(data)) == payload


def test_long_lzw_passes_every_code_width():
    raw = bytes(np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8))
    assert media.lzw_decode(media.lzw_encode(raw)) == raw


def test_sixteen_bit_samples_with_predictor():
    import struct

    img = np.array([[1, 500, 40000], [7, 7, 8]], np.uint16)
    raw = np.diff(img.astype(np.int64), axis=1, prepend=0).astype(np.uint16).tobytes()
    tags = [(256, 3), (257, 2), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (278, 2), (279, len(raw)), (317, 2)]
    data = struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert next(media.pages(data))[6].tolist() == img.tolist()


def test_media(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (4, "é" * 50_000), (None, "x" * 64)]
    got = media.digests(media.read(media.store(docs_of(rows)))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 2)}) == 1
    bad = spark.createDataFrame([(1, b"nonsense"), (2, None), (3, b"II*\0\xff\xff\xff\x7f")], "id long, media binary")
    assert [r["page"] for r in media.read(bad).collect()] == [-1] * 3
    assert media.digests(media.read(media.store(docs_of([])))).collect() == []


def slow_similarity(window, item):
    sh = lambda w: Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))
    a, b = sh(window), sh(item)
    return sum((a & b).values()) / sum((a | b).values())


def test_decontamination(spark, docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 50)))) for i in range(30)] + [(90, "two words"), (91, ""), (92, None), (None, "no name at all"), (93, "same same same same same")]
    rows = []
    for d in range(200):
        words = [word() for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            leak = items[d % 30][1].split()
            if d % 2:
                leak[len(leak) // 2] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in leak] if d % 5 == 0 else leak
        rows.append((d, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "Two words!"), (503, "same same same same same same")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontam.contaminated(docs_of(rows), b).collect()}
    want = {}
    for d, t in rows:
        w = [x.decode() for x in decontam.words_of(t or "")]
        for i, it in items:
            x = [y.decode() for y in decontam.words_of(it or "")]
            if i is None or not x:
                continue
            best = max(((slow_similarity(w[s : s + len(x)], x) if len(x) > 2 else float(w[s : s + len(x)] == x), -s) for s in range(len(w) - len(x) + 1)), default=(0, 0))
            if best[0] >= 0.5:
                want[d, i] = best
    missed = set(want) - set(got)
    assert set(got) <= set(want) and all(want[k][0] < 0.6 for k in missed)
    assert all((-got[k][0], round(got[k][1], 9)) == (want[k][1], round(want[k][0], 9)) for k in got if want[k][0] >= 0.75)
    dirty = {d for d, _ in got}
    kept = decontam.clean(docs_of(rows), b)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - dirty and kept.columns == docs_of([]).columns
    assert decontam.contaminated(docs_of([]), b).collect() == [] and decontam.contaminated(docs_of(rows), b.limit(0)).collect() == []


def test_a_long_text_is_searched_in_spans(monkeypatch):
    monkeypatch.setattr(decontam, "SPAN", 50)
    item = " ".join(f"w{i}" for i in range(20))
    index = decontam.Index([(1, item)])
    for at in (0, 31, 45, 49, 50, 333):
        text = " ".join(f"x{i}" for i in range(at)) + " " + item + " tail" * 10
        assert [(r[0], r[1], r[2]) for r in decontam.search(text, index)] == [(1, at, at + 20)]


def test_texts_shorter_than_an_item_and_windows_at_the_threshold(spark, docs_of):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(40)]
    rows = []
    for i, t in items:
        w = t.split()
        rows += [(10 * i, " ".join(w[:-1])), (10 * i + 1, " ".join(w[: len(w) // 2 + 2])), (10 * i + 2, " ".join(w[: len(w) // 3]))]
        changed = list(w)
        changed[len(w) // 2] = "changed"
        rows += [(10 * i + 3, " ".join(changed)), (10 * i + 4, " ".join([word() for _ in range(30)] + w[: len(w) * 3 // 4] + [word() for _ in range(30)]))]
    want = {}
    for d, t in rows:
        w = t.encode().split()
        for i, it in items:
            x = it.encode().split()
            windows = [w] if len(w) < len(x) else [w[s : s + len(x)] for s in range(len(w) - len(x) + 1)]
            best = max((slow_similarity(v, x), -s, s + len(v)) for s, v in enumerate(windows))
            if best[0] >= 0.5:
                want[d, i] = (round(best[0], 9), -best[1], best[2])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"], r["end"]) for r in decontam.contaminated(docs_of(rows), b).collect()}
    assert got == want and sum(len(dict(rows)[d].split()) < len(dict(items)[i].split()) for d, i in want) > 40
