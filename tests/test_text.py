from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


def test_normalized_keeps_numbers_and_drops_bullets(spark):
    assert one(spark, T.normalized, "• Inflation is 8.2%!\n- Regulation matters") == "inflation is 8 2% regulation matters"
    assert one(spark, T.normalized_exact, "Straße’s ﬁne") == "strasses fine"
    assert one(spark, T.normalized, "") == ""


def test_token_count_counts_words_and_symbols(spark):
    assert one(spark, T.token_count, "Über 5 cats, ok?") == 6
    assert one(spark, T.token_count, "") == 0


def test_concepts_are_distinct_and_ordered(spark):
    assert one(spark, T.concepts, "The US-led ban of the ban, it's 'done'") == ["us-led", "ban", "it's", "done"]


def test_clean_motion_keeps_words_that_begin_like_an_abbreviation(spark):
    assert one(spark, T.clean_motion, "THW ban corn.") == "ban corn"
    assert one(spark, T.clean_motion, "This House Believes That: trade  helps") == "trade helps"
    assert one(spark, T.clean_motion, "Those who wait") == "Those who wait"


def test_numbers(spark):
    assert one(spark, T.numbers, "GDP 3.5% in 2024, a1 7") == ["3.5%", "2024", "7"]
    assert one(spark, T.has_number, "no digits, a1b") is False


def test_truncated_and_junk(spark):
    assert one(spark, T.truncated, "and so on... ") is True
    assert one(spark, T.junk_characters, "a�b\x01") == 2


def test_speech_words(spark):
    assert one(spark, T.speech_words, "Don't over-think it") == 3


def test_the_fold_within_the_jvm_equals_the_full_one_for_every_character(spark):
    every = [f"A{chr(c)}b {chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["ﬁne ＡＢ１２％", "STRASSE straße", "İstanbul ΣΑΣ", "e\u0301tude", "\u212b", None]
    df = spark.createDataFrame([(t,) for t in every], "t string")
    full = T.normalized(T.compatible(F.col("t")))
    wrong = df.select("t", T.normalized_exact(F.col("t")).alias("a"), full.alias("b")).where("not (a <=> b)")
    assert [r["t"] for r in wrong.collect()] == []
    assert df.where(F.col("t").rlike(T.ODD)).count() < df.count() - 20_000
    fine = df.where("t like 'ﬁne%'").select(T.normalized_exact(F.col("t"))).first()[0]
    assert fine == "fine ab12%" or fine == "fine ab12 %" or fine.startswith("fine ab12")


def test_significant_words_in_one_pass(spark):
    norm = "about %about% 1234 12%34 %1234% ab%cd a%b xyz %wxyz% there theres über_ßß ١٢٣٤ abc1 _a_b x%%%y"
    assert one(spark, T.significant, norm) == ["12%34", "ab%cd", "wxyz", "theres", "über_ßß", "abc1", "_a_b", "x%%%y"]
    assert one(spark, T.significant, "") == []


def test_a_text_is_looked_through_for_odd_characters_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(T.normalized_exact(F.col("t")).alias("norm"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1
