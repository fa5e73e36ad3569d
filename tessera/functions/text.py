"""Column functions over text. Word characters are letters, digits and the underscore of any script."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
BULLET = r"(?m)^\s*[-*•‣▪◦]+\s+"

# Comparison-only replacements, and the words that say little about a text's topic.
SPACES = "   "
DROPPED = "‘’'"
DASHES = "‐‑‒–—−"
DEDUP_STOPWORDS = (
    "about", "after", "again", "against", "argument", "because", "before", "being", "between", "claim", "could",
    "debate", "does", "from", "have", "impact", "into", "more", "other", "should", "that", "their", "there", "these",
    "they", "this", "through", "under", "which", "with", "would",
)
CONCEPT_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "this", "to", "would", "should", "with",
)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalized(text: Column) -> Column:
    """Comparison form: folded case, no apostrophes, bullets or punctuation; numbers and % stay.

    For text in compatibility form already; normalized_exact() folds any text.
    """
    # ASCII texts, which their lengths tell at once, hold only one of the characters to replace
    plain = F.octet_length(text) == F.length(text)
    marked = F.translate(text, SPACES + DASHES + DROPPED, " " * len(SPACES) + "-" * len(DASHES))
    t = F.when(plain, F.replace(text, F.lit("'"), F.lit(""))).otherwise(marked)
    t = F.regexp_replace(t, BULLET, "")
    t = F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(t, r"[^a-z\p{L}\p{N}_%]++", " "))


def compatible(text: Column) -> Column:
    """Compatibility form (NFKC) with full case folding, which no built-in function gives."""

    @F.pandas_udf("string")
    def fold(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return fold(text)


#: Characters that compatibility form and full case folding may change in a way that lower() doesn't; ranges of others are left out.
ODD = (
    "(?=[^\\x00-\\x7F])"
    "[^\\x00-\\x7F\\u00A1-\\u00A7\\u00A9\\u00AB\\u00AC\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u012F\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E"
    "\\u0400-\\u0482\\u048A-\\u052F\\u2010\\u2012-\\u2016\\u2018-\\u201F\\u2022\\u2023\\u20AC\\u4E00-\\u9FA5]"
)


def normalized_exact(text: Column) -> Column:
    """normalized() of any text. Only texts with a character of ODD are folded outside the JVM; for the others the task sends nulls."""
    # most texts are ASCII, which their lengths tell at once
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(ODD)
    return normalized(F.coalesce(compatible(F.when(odd, text)), text))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized_exact(text), 256)


def token_count(text: Column) -> Column:
    """Words and single symbols."""
    return F.regexp_count(text, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"))


def significant(norm: Column) -> Column:
    """Words of four characters or more that are neither stop words nor numbers, in order, of a comparison form."""
    # one pass that begins where a word of the form begins; a percent sign at a word's ends is none of it
    long = rf"(?<![^ ])%*+(?!\p{{Nd}}++%*+(?: |$))({WORD}[a-z\p{{L}}\p{{N}}_%]{{2,}}{WORD})"
    return F.filter(F.regexp_extract_all(norm, F.lit(long), F.lit(1)), lambda w: ~w.isin(*DEDUP_STOPWORDS))


def concepts(text: Column) -> Column:
    """Distinct content terms in order of appearance."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9'-]*"), F.lit(0))
    stop = F.array(*map(F.lit, CONCEPT_STOPWORDS))
    folded = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(folded, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def overlap(query: Column, target: Column) -> Column:
    """Shared terms over the query's, of which eight at most are asked for."""
    n = F.size(F.array_intersect(query, target))
    return F.when(F.size(query) == 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.least(F.size(query), F.lit(8)))))


def has_number(text: Column) -> Column:
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+($|[^\p{{L}}\p{{N}}_])")


def numbers(text: Column) -> Column:
    """Number tokens in order, with decimals and percent signs."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)\d+(?:[.,]\d+)?%?(?!\w)"), F.lit(0))


def truncated(text: Column) -> Column:
    t = F.lower(F.rtrim(text))
    return t.endswith("...") | t.endswith("…") | t.contains("[truncated]")


def junk_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[�\x00-\x08\x0B\x0C\x0E-\x1F]"))


def speech_words(text: Column) -> Column:
    """Spoken words; apostrophes and hyphens join."""
    return F.regexp_count(text, F.lit(rf"{WORD}+(?:['’\-]{WORD}+)*"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# A motion's abbreviated or spelled-out opening.
MOTION_PREFIX = r"(?i)^\s*(?:TH(?:W|BT|P|R|S|O)\b|This\s+House\s+(?:Would|Believes\s+That|Prefers|Regrets|Supports|Opposes))\s*[:\-–—,.]?\s*"


def clean_motion(text: Column) -> Column:
    """A motion without its opening. The abbreviation must end as a word, so that "Those" keeps its letters."""
    t = collapse(F.regexp_replace(text, MOTION_PREFIX, ""))
    return F.regexp_replace(t, r"^[ .,:;–—-]+|[ .,:;–—-]+$", "")
