"""Inverted index, boolean, phrase and prefix matching, BM25 and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import WORD

K1, B = 1.2, 0.75
#: Folds the diacritics of Latin letters.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def terms(text: Column) -> Column:
    """Lower-cased words of letters and digits without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl): one row per term of a document; docs: doc_id, text."""
    rows = docs.select("doc_id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    counted = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counted


def positions(docs: DataFrame) -> DataFrame:
    """(term, doc_id, pos)."""
    return docs.select("doc_id", F.posexplode(terms(F.coalesce("text", F.lit("")))).alias("pos", "term")).select("term", "doc_id", "pos")


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(terms(F.coalesce("text", F.lit("")))).alias("dl"))


@dataclass(frozen=True)
class Match:
    """A conjunction of words, phrases and one-word prefixes."""

    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    prefixes: tuple[str, ...]


def parse_match(query: str) -> Match:
    """Quoted runs are phrases, a trailing * asks for a prefix, all else is words; all must match.

    Raises ValueError if nothing is left to search for.
    """
    words, phrases, prefixes = [], [], []
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', query):
        found = re.findall(r"[^\W_]+", (quoted or bare).lower().translate(str.maketrans(MARKED, PLAIN)))
        if not found:
            continue
        if quoted:
            phrases.append(tuple(found))
        elif bare.endswith("*"):
            words += found[:-1]
            prefixes.append(found[-1])
        else:
            words += found
    if not (words or phrases or prefixes):
        raise ValueError("no term to search for")
    return Match(tuple(words), tuple(p for p in phrases), tuple(prefixes))


def match_all(docs: DataFrame, match: Match) -> DataFrame:
    """doc_id and matched text of documents that meet the whole match; a filter, with no join."""
    folded = F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" "))
    has = [folded.contains(f" {w} ") for w in match.words] + [folded.contains(f" {' '.join(p)} ") for p in match.phrases] + [folded.contains(f" {p}") for p in match.prefixes]
    found = docs
    for h in has:
        found = found.where(h)
    return found


def snippet(text: Column, word: str, around: int = 8) -> Column:
    """About 2 * around words of text at the first place of word, which stands in brackets."""
    w = F.split(text, r"\s+")
    at = F.coalesce(F.array_position(F.transform(w, lambda x: F.translate(F.lower(F.regexp_replace(x, rf"^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$", "")), MARKED, PLAIN)), word).cast("int"), F.lit(1))
    start = F.greatest(F.lit(1), at - around)
    cut = F.transform(F.slice(w, start, F.lit(2 * around)), lambda x, i: F.when(i + start == at, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(cut, " "), F.when(start + 2 * around <= F.size(w), "…").otherwise(""))


#: Words of a snippet, and how much a further term in it counts against repeated ones.
SNIPPET, DISTINCT = 16, 1000
TOKEN = regex.compile(r"[\p{L}\p{N}]+")
FOLDS = str.maketrans(MARKED, PLAIN)


def hits(tokens: list[str], match: Match) -> list[tuple[int, int, int]]:
    """(place, length, which) of each word, phrase and prefix of a match among folded words, in order."""
    asked = [((w,), False) for w in match.words] + [(p, False) for p in match.phrases] + [((p,), True) for p in match.prefixes]
    at: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        at.setdefault(t, []).append(k)
    found = []
    for which, (words, prefix) in enumerate(asked):
        if prefix:
            found += [(k, 1, which) for t, places in at.items() if t.startswith(words[0]) for k in places]
        else:
            found += [(k, len(words), which) for k in at.get(words[0], ()) if tuple(tokens[k : k + len(words)]) == words]
    return sorted(found)


def best_window(found: list[tuple[int, int, int]], n: int, size: int = SNIPPET) -> int:
    """First word of the window that holds most of a match's terms, then most of their repeats, the earliest of equals.

    Windows begin at a hit; the best is moved so that its hits stand in the middle, as far as the text reaches.
    """
    best, first, last = -1, 0, 0
    for i, (start, *_) in enumerate(found):
        inside = []
        for h in found[i:]:
            if h[0] >= start + size:
                break
            if h[0] + h[1] <= start + size:
                inside.append(h)
        terms_ = len({h[2] for h in inside})
        score = DISTINCT * terms_ + len(inside) - terms_
        if score > best:
            best, first, last = score, start, max((h[0] + h[1] for h in inside), default=start + 1)
    return max(0, min(first - (size - (last - first)) // 2, n - size))


def best_snippet(text: Column, match: Match, size: int = SNIPPET, left: str = "[", right: str = "]", gap: str = " … ") -> Column:
    """About size words of a text where a match is densest, hits in brackets; touching hits share them. Meant for the few rows of a result.

    A text without a hit gives its first words, a null or empty one an empty snippet.
    """

    def cut(t: str | None) -> str:
        spans = [m.span() for m in TOKEN.finditer(t or "")]
        if not spans:
            return ""
        found = hits([t[a:b].lower().translate(FOLDS) for a, b in spans], match)
        lo = best_window(found, len(spans), size)
        hi = min(len(spans), lo + size)
        marked = sorted((a, a + n) for a, n, _ in found if a >= lo and a + n <= hi)
        runs: list[list[int]] = []
        for a, b in marked:
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out, at = [gap if lo else ""], spans[lo][0]
        for a, b in runs:
            out += [t[at : spans[a][0]], left, t[spans[a][0] : spans[b - 1][1]], right]
            at = spans[b - 1][1]
        return "".join([*out, t[at : spans[hi - 1][1]], gap if hi < len(spans) else ""])

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(cut)

    return run(text)


def bm25(docs: DataFrame, queries: DataFrame, all_terms: bool = False) -> DataFrame:
    """(query_id, doc_id, score): summed over a query's distinct terms; queries: query_id, term.

    The postings are cut to the queries' terms before they shuffle. With all_terms only documents
    that hold every term of the query score. The terms' frequencies, the number of documents and
    their mean length are aggregates over all documents.
    """
    wanted = queries.select("query_id", "term").distinct()
    size = lengths(docs)
    stats = size.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("mean_dl"))
    # the words are cut to those asked for before they are counted, so only these shuffle
    words = docs.select("doc_id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    asked = words.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    hits = asked
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    scored = hits.join(df, "term").join(size, "doc_id").join(F.broadcast(stats)).select("term", "doc_id", weight.alias("w")).join(wanted, "term")
    out = scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"), F.count("*").alias("held"))
    if all_terms:
        need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
        out = out.join(need, "query_id").where("held = need").drop("need")
    return out.drop("held")


def top_k(scored: DataFrame, k: int, by: str = "score", digits: int = 4) -> DataFrame:
    """Best k of each query, ties by doc_id; adds rank. Scores are compared as rounded."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    return scored.withColumn(by, F.round(by, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_score(rank: Column) -> Column:
    """1 for the first, falling with the rank."""
    return 1 / (1 + 0.25 * (rank - 1))
