from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import publishing, reports


def test_document_types(spark):
    rows = [("Case File x.docx", [], [], [], "masterfile"), ("fact sheet.md", [], [], [], "fact_sheet"), ("a.md", ["Theory Stuff"], [], [], "theory"), ("a.md", ["Ks"], [], [], "kritik"), ("a.md", [], ["kritik"], ["kritik"], "kritik"), ("a.md", [], ["answer"], ["answer"], "block"), ("a.md", [], ["contention"], ["contention"], "case"), ("a.md", [], [], [], "unknown")]
    df = spark.createDataFrame(rows, "f string, p array<string>, s array<string>, r array<string>, want string")
    got = df.select("want", reports.document_type(F.col("f"), F.col("p"), F.col("s"), F.col("r"), F.lit(False)).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_round_types(spark):
    rows = [(["value", "value_criterion"], "value"), (["value"], "unknown"), (["threshold_of_truth"], "fact"), (["plan"], "policy"), ([], "unknown")]
    got = spark.createDataFrame(rows, "s array<string>, want string").select("want", reports.round_type(F.col("s")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_failure_codes_and_usage(spark):
    d = spark.createDataFrame([("HTTP 429 quota",), ("Not logged in",), ("unknown option --x",), ("Model gpt not found",), ("boom",)], "t string")
    assert [r[0] for r in d.select(reports.failure_code(F.col("t"))).collect()] == ["rate_limit_or_quota", "cli_login", "cli_incompatible", "model_unavailable", "provider_error"]
    u = spark.createDataFrame([('{"usage":{"input_tokens":1,"output_tokens":2,"total_tokens":3}}',), ('{"usageMetadata":{"promptTokenCount":4}}',), ("[]",)], "t string")
    assert [tuple(r[0]) for r in u.select(reports.token_usage(F.col("t"))).collect()] == [(1, 2, 3), (4, None, None), (None, None, None)]


def test_result_limits():
    assert reports.result_limits(None) == (5, 18) and reports.result_limits(8) == (2, 6) and reports.result_limits(1) == (1, 0) and reports.result_limits(100) == (5, 95)


def test_exactly_once(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 1), ("b", 3), ("c", 1)], "k string, v int")
    assert {r["k"]: r["complete"] for r in reports.exactly_once(d, "k", "v", 3).collect()} == {"a": True, "b": False, "c": False}


def test_publish_names_a_whole_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    publishing.publish(spark.createDataFrame([(1,)], "x int"), root)
    publishing.publish(spark.createDataFrame([(2,), (3,)], "x int"), root)
    assert sorted(r["x"] for r in publishing.current(spark, root).collect()) == [2, 3]
    with pytest.raises(Exception, match="boom"):
        publishing.publish(spark.range(1).select(F.raise_error(F.lit("boom")).alias("x")), root)
    assert sorted(r["x"] for r in publishing.current(spark, root).collect()) == [2, 3]


def test_embedding_failures_stay_with_their_rows(spark):
    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] if t != "odd" else [1.0] for t in texts]

    d = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "odd"), (4, None)], "id long, text string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["error"]) for r in publishing.embedded(d, encode, 2).collect()}
    assert got[1] == ([2.0, 1.0], None) and got[4] == ([0.0, 1.0], None)
    assert got[2][0] is None and "RuntimeError" in got[2][1] and got[3] == (None, "1 dimensions")


def test_unit_length(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [[round(x, 6) for x in r[0]] for r in d.select(publishing.unit_length(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
