"""The pipeline's stages keep clean documents, drop what they decide on, and hand on the columns of documents."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.decontam import words_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir).toPandas()
        seen[name] = (set(at.toPandas()["doc_id"]), out)
        if name != "packing":
            assert list(out.columns) == docs.columns
            at = spark.createDataFrame(out, docs.schema)
    before, kept = seen["near_duplicates"]
    assert set(kept["doc_id"]) <= before and not kept["text"].duplicated().any()
    before, kept = seen["decontamination"]
    joined = [b" " + b" ".join(words_of(t)) + b" " for t in kept["text"]]
    assert not any(b" " + b" ".join(i) + b" " in t for i in bench if i for t in joined)
    before, kept = seen["secrets"]
    assert set(kept["doc_id"]) == before
    before, pieces = seen["packing"]
    assert set(pieces["doc_id"]) == before


def test_run_equals_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_no_documents(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
        assert at.count() == 0
