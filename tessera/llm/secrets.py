"""Secret scans in DataFrame functions alone.

Rules find assigned values, access keys and long hexadecimal runs. Two character Markov models,
one of random strings (the rules' own finds) and one of ordinary identifiers (long tokens of
letters), are trained from a bounded set of labelled samples; other long tokens are reported where
the log-likelihood ratio of the two models says that they are random.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' patterns and the least length of what they report.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
#: One greedy class cannot match twice in one run, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Tokens that ordinary identifiers are learned from.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{8,}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "markov")
#: Past the end of any text.
NOWHERE = 1 << 40
#: Expected number of documents that ordinary identifiers are learned from, and the most finds of the rules used.
SAMPLE_DOCS, SAMPLE_SECRETS = 4096, 20_000


#: Elements of an array handled together where a running value or a piece of a text is taken.
BLOCK, TEXT_BLOCK = 64, 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], levels: int = 4) -> Column:
    """Running value up to and including each element, in time linear in the array.

    Elements are merged in blocks, the blocks' values in blocks again, and so on, so nothing is
    copied more than BLOCK times. values and zero have one type.
    """

    def within(block: Column, first: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(F.slice(block, 1, i + 1), first, merge))

    def run(v: Column, level: int) -> Column:
        if not level:
            return within(v, zero)
        cut = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        ends = lambda blocks: run(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), level - 1)
        return _let(cut, lambda blocks: _let(ends(blocks), lambda e: F.flatten(F.transform(blocks, lambda b, i: within(b, F.coalesce(F.get(e, i - 1), zero))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, run(v, levels)).otherwise(v))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, found) of all leftmost, non-overlapping matches, in code points, end exclusive.

    The gaps that a split leaves and the matches alternate, so their running length is the place.
    """

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: (F.length(gap) + F.coalesce(F.length(x), F.lit(0))).cast("bigint"))
        spans = lambda ends: F.zip_with(found, F.slice(ends, 1, F.size(found)), lambda x, e: F.struct((e - F.length(x)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x.alias("found")))
        return _let(_running(steps, F.lit(0).cast("bigint"), lambda a, b: a + b), spans)

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the rules, by start, then kind; an empty text has none, a null one counts as empty.

    Spans of different rules may overlap or be equal but for their kind; within a rule they never overlap.
    """
    text = F.coalesce(text, F.lit(""))
    long_enough = F.filter(_matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(_bare(long_enough), _bare(_matches(text, ACCESS, 1)), _bare(_matches(text, HEX, 2))))


def _pairs(token: Column) -> Column:
    """Pairs of neighbouring characters."""
    each = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(token) >= 2, _let(F.split(token, ""), each)).otherwise(F.array().cast("array<string>"))


def train(docs: DataFrame, smoothing: float = 0.5, backoff: float = 2.0) -> list[float]:
    """Log ratios of transition probabilities by 128 * first + second character code.

    Random strings: finds of the rules of 16 characters or more (SAMPLE_SECRETS at most). Ordinary
    identifiers: letter tokens of about SAMPLE_DOCS documents, chosen by the hash of their text.
    """
    n = max(1, docs.count())
    text = F.coalesce(F.col("text"), F.lit(""))
    share = min(1.0, SAMPLE_DOCS / n)
    ordinary = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    # what the rules find is no ordinary identifier
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " ")
    ordinary = ordinary.select(F.lit(0).alias("random"), F.explode(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))).alias("token"))
    finds = docs.select(text.alias("text")).select(F.explode(F.concat(*[F.when(F.regexp_like("text", F.lit(p)), F.regexp_extract_all("text", F.lit(p), F.lit(g))).otherwise(F.array().cast("array<string>")) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))])).alias("token"))
    finds = finds.where(F.length("token") >= 16).distinct().orderBy(F.xxhash64("token"), "token").limit(SAMPLE_SECRETS).select(F.lit(1).alias("random"), "token")
    pairs = ordinary.union(finds).select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    counts = [[0.0] * 16384, [0.0] * 16384]
    for r in pairs.collect():  # pairs of characters of the patterns' classes: 66 * 66 at most
        counts[r["random"]][ord(r["pair"][0]) * 128 + ord(r["pair"][1])] = r["n"]
    alphabet = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_.=-"]
    ratios, logs = [0.0] * 16384, []
    for c in counts:
        # a transition is as likely as its second character where the first was rarely seen
        seen = {b: sum(c[a * 128 + b] for a in alphabet) + smoothing for b in alphabet}
        share = {b: n / sum(seen.values()) for b, n in seen.items()}
        rows = {a: sum(c[a * 128 + b] for b in alphabet) + backoff for a in alphabet}
        logs.append({(a, b): math.log((c[a * 128 + b] + backoff * share[b]) / rows[a]) for a in alphabet for b in alphabet})
    for a, b in logs[0]:
        ratios[a * 128 + b] = round(logs[1][a, b] - logs[0][a, b], 6)
    return ratios


def scan(docs: DataFrame, ratios: list[float], threshold: float = 12.0) -> DataFrame:
    """(doc_id, base, spans) per row of docs: arrays of (start, kind, end) by start, then kind.

    base holds the rules' spans; spans adds tokens with a log-likelihood ratio of at least
    threshold that overlap none of them. Null and empty texts have none. Repeated rows are
    scanned each.
    """
    return _judged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ratios, threshold).drop("text")


def _judged(src: DataFrame, ratios: list[float], threshold: float) -> DataFrame:
    """src with base and spans; src.text is not null."""
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to one literal
    src = src.withColumn("base", base_spans(F.col("text")))

    def ratio(token: Column) -> Column:
        each = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(model, a * 128 + b + 1))
        return F.aggregate(_let(F.transform(F.split(token, ""), F.ascii), each), F.lit(0.0), lambda s, x: s + x)

    random = _bare(F.filter(_matches(F.col("text"), TOKEN, 3), lambda s: ratio(s["found"]) >= threshold))

    def apart(spans: Column) -> Column:
        """Of spans by start, then kind, all but tokens that a rule's span overlaps."""
        rule = lambda value, other: lambda s: F.when(s["kind"] < 3, s[value]).otherwise(F.lit(other).cast("bigint"))
        reach = _running(F.transform(spans, rule("end", -1)), F.lit(-1).cast("bigint"), lambda a, b: F.greatest(a, b))
        ahead = F.reverse(_running(F.reverse(F.transform(spans, rule("start", NOWHERE))), F.lit(NOWHERE).cast("bigint"), lambda a, b: F.least(a, b)))
        sides = F.zip_with(spans, F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        return F.transform(F.filter(sides, lambda y: (y["s"]["kind"] < 3) | (y["x"]["r"] <= y["s"]["start"]) & (y["x"]["a"] >= y["s"]["end"])), lambda y: y["s"])

    src = src.withColumn("random", random)
    every = F.array_sort(F.concat("base", "random"))
    spans = F.when(F.size("random") == 0, F.col("base")).when(F.size("base") == 0, F.col("random")).otherwise(_let(every, apart))
    return src.withColumn("spans", spans).drop("random")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, threshold: float = 12.0) -> DataFrame:
    """Train on docs and scan docs."""
    return scan(docs, train(docs), threshold)


def redact(docs: DataFrame, threshold: float = 12.0, mark: str = "[secret]", ratios: list[float] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, with every span found replaced by mark.

    Overlapping spans become one mark. n_chars, where there is such a column, is counted anew for
    texts that change. A null text stays null, an empty one empty; repeated rows are all kept.
    ratios: what train() returned; by default it learns from docs.
    """
    ratios = ratios or train(docs)
    cols = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _judged(docs.select(cols, F.coalesce("text", F.lit("")).alias("text")), ratios, threshold)
    end = F.length("text").cast("bigint")

    def piece(blocks: Column, start: Column, stop: Column) -> Column:
        i, j = (F.shiftright(x, TEXT_BLOCK.bit_length() - 1).cast("int") for x in (start, stop))
        at = lambda x: (x % TEXT_BLOCK).cast("int")
        inside = F.substring(F.get(blocks, i), at(start) + 1, (stop - start).cast("int"))
        across = F.concat(F.substring(F.get(blocks, i), at(start) + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), at(stop)), F.lit("")))
        return F.coalesce(F.when(i == j, inside).otherwise(across), F.lit(""))

    def rebuilt(blocks: Column, reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
        parts = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(blocks, before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1), end))

    # a piece is taken out of short blocks, not counted off from the beginning of the text
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    reach = _running(F.transform("spans", lambda s: s["end"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
    new = F.when(F.size("spans") > 0, _let(cut, lambda blocks: _let(reach, lambda r: rebuilt(blocks, r)))).otherwise(F.col("row.text"))
    changed = found.select("row", "spans", new.alias("new_text"))
    value = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.size("spans") > 0, F.length("new_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return changed.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
