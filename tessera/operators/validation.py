"""Checks and rankings of generated material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.tables import materialize


def competition_rank(scores: DataFrame, total: str, key: str) -> DataFrame:
    """Adds rank: one more than the number of greater totals, so ties share; rows without a total come last.

    Distinct totals are dealt out by range, counted within their part, and each part starts after
    the rows of the parts above it, so no task orders all of them.
    """
    by_total = scores.groupBy(F.col(total).alias("value")).agg(F.count("*").alias("n"))
    dealt = by_total.repartitionByRange(F.desc_nulls_last("value")).select("value", "n", F.spark_partition_id().alias("part"))
    dealt = materialize(dealt, "totals")
    within = Window.partitionBy("part").orderBy(F.desc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    sums = dealt.groupBy("part").agg(F.sum("n").alias("many"))
    before = sums.select("part", F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranks = dealt.withColumn("above", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("above") + 1).alias("rank"))
    return scores.join(ranks, scores[total].eqNullSafe(F.col("value"))).drop("value")


def totals_in_order(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, total): sums of doubles taken one after the other in a stated order, so that no total depends on how rows are dealt out."""
    w = Window.partitionBy(key).orderBy(*order)
    running = rows.select(key, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"), F.row_number().over(w).alias("at"))
    return running.groupBy(key).agg(F.max_by("running", "at").alias("total"))


def quotes_within(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds held: whether the quote occurs word for word in the source it cites; a missing source holds nothing."""
    return quotes.join(sources.select("source_id", F.col("text").alias("source_text")), "source_id", "left").withColumn("held", F.coalesce(F.contains(T.collapse(F.lower("source_text")), T.collapse(F.lower("quote"))), F.lit(False))).drop("source_text")


def alike(items: DataFrame, least: float) -> DataFrame:
    """(first_id, second_id, jaccard) of pairs of word sets at least so alike; items: item_id, text.

    Alike sets share a word among the rarest of each: the prefix that a set can lose and still be
    alike. Pairs meet there and nowhere else.
    """
    sets = items.select("item_id", T.word_set(F.coalesce("text", F.lit(""))).alias("words"))
    df = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = sets.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word")).join(df, "word")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "word"))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("item_id", "word")
    pairs = prefix.select("word", F.col("item_id").alias("first_id")).join(prefix.select("word", F.col("item_id").alias("second_id")), "word").where("first_id < second_id").select("first_id", "second_id").distinct()
    a, b = sets.select(F.col("item_id").alias("first_id"), F.col("words").alias("a")), sets.select(F.col("item_id").alias("second_id"), F.col("words").alias("b"))
    scored = pairs.join(a, "first_id").join(b, "second_id").select("first_id", "second_id", T.jaccard(F.col("a"), F.col("b")).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least)


def word_limit(minutes: Column, reserve_seconds: int = 30, per_minute: int = 150) -> Column:
    return F.floor((minutes * 60 - reserve_seconds) * per_minute / 60)


def speech_seconds(words: Column, per_minute: int = 150) -> Column:
    return F.round(words * 60 / per_minute, 1)


def gaps(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected combinations that nothing covers; both have the same columns."""
    return expected.join(present.select(*expected.columns).distinct(), expected.columns, "left_anti")


def unresolved(findings: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Findings without an answer that resolves them; answers: key, resolved."""
    done = answers.where("resolved").select(key).distinct()
    return findings.join(done, key, "left_anti")


def unsupplied(cited: DataFrame, supplied: DataFrame, owner: str, cites: str) -> DataFrame:
    """(owner, cites) once for each citation of something that its owner was not given; null citations are violations too."""
    # one aggregation of both, combined on the map side, holds a pair once; a join would hold and sort it on both sides
    given = supplied.where(F.col(owner).isNotNull() & F.col(cites).isNotNull())
    flagged = cited.select(owner, cites, F.lit(False).alias("_given"), F.lit(True).alias("_cited")).unionByName(given.select(owner, cites, F.lit(True).alias("_given"), F.lit(False).alias("_cited")))
    each = flagged.groupBy(owner, cites).agg(F.max("_given").alias("_given"), F.max("_cited").alias("_cited"))
    return each.where("_cited and not _given").select(owner, cites)


#: Label of tricks in section types and headings, and phrases of automatic ballots.
TRICKS = r"(?i)\b(?:tricks?|a\s*priori|auto(?:matic)?[- ]win)\b"
AUTOMATIC_BALLOTS = (
    r"(?i)\b(?:automatic(?:ally)? win(?:s)?(?: the round)?|vote for (?:us|our (?:team|side)) regardless of (?:the )?motion"
    r"|drop (?:the|our) opponents? for (?:not wearing|their attire))\b"
)


def tricked(section_type: Column, heading_path: Column) -> Column:
    """Whether a section type or a heading above it is labelled as a trick; nulls are not."""
    return F.concat_ws(" ", section_type, heading_path).rlike(TRICKS)


def forbidden_phrases(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule) of texts that ask for an automatic ballot; null texts ask for nothing."""
    return texts.where(F.coalesce(F.col(text).rlike(AUTOMATIC_BALLOTS), F.lit(False))).select(key, F.lit("automatic-ballot phrase").alias("rule"))


def evaluation_violations(stated: DataFrame, key: str) -> DataFrame:
    """(key, rule) of evaluations whose stated total is not the sum of their parts, or whose rank is not one more than the number of greater totals.

    stated: key, parts (array of numbers), total, rank.
    """
    ranked = competition_rank(stated.withColumnRenamed("rank", "stated_rank"), "total", key)
    parts = F.aggregate(F.coalesce("parts", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    rules = F.array(F.when(~F.col("total").eqNullSafe(parts), "total"), F.when(~F.col("stated_rank").eqNullSafe(F.col("rank")), "rank"))
    return ranked.select(key, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
