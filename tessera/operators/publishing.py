"""Snapshots that readers see whole, and writes of single rows that may fail."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.tables import materialize


def publish(df: DataFrame, root: str) -> str:
    """Write a new version of a table, then name it as the current one. A failure in between leaves the old one current."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    stamp = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    stamp.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was named last."""
    newest = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", "at").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/versions/{newest}")


def embedded(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """(id, embedding, error) of rows (id, text): batches through encode; a failing batch is retried row by row.

    A vector of the wrong length is an error of its row and of no other.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def safe(ids: list, texts: list[str]) -> list[tuple]:
        try:
            got = encode(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return [(i, list(map(float, v)), None) if len(v) == dimension else (i, None, f"{len(v)} dimensions") for i, v in zip(ids, got, strict=True)]
        except Exception as e:  # a row's failure is reported with the row
            if len(texts) == 1:
                return [(ids[0], None, f"{type(e).__name__}: {e}"[:300])]
            return [r for i, t in zip(ids, texts, strict=True) for r in safe([i], [t])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 32):
                q = p.iloc[at : at + 32]
                yield pd.DataFrame(safe(q["id"].tolist(), q["text"].fillna("").tolist()), columns=["id", "embedding", "error"])

    return rows.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>, error string")


def unit_length(vector: Column) -> Column:
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(vector, lambda x: (x / n).cast("float"))).otherwise(vector)


#: Counters of a synchronisation.
REPORT = ("chunks_found", "eligible", "duplicate_members_skipped", "invalid_skipped", "embedded", "updated", "already_current", "stale_deleted", "failures")


def configured(spark: SparkSession, root: str, settings: dict[str, str]) -> dict[str, tuple[str, str | None]]:
    """Settings that differ from those the index at root was made with: name, (wanted, found). None if there is no index yet."""
    try:
        made = {r["name"]: r["value"] for r in spark.read.parquet(f"{root}/settings").collect()}
    except AnalysisException:
        return {}
    return {k: (v, made.get(k)) for k, v in settings.items() if made.get(k) != v}


def synchronised(chunks: DataFrame, root: str, encode: Callable[[list[str]], list[list[float]]], dimension: int, settings: dict[str, str], rebuild: bool = False, limit: int | None = None) -> DataFrame:
    """Bring the vector index at root up to date with chunks, publish it whole, and report in one row of REPORT.

    chunks: chunk_id, text (as it is embedded), status (eligible, skipped or invalid; see vectors.index_status). New and changed
    texts are embedded, a failing batch row by row; a row that fails keeps the vector it had. Vectors of chunks that are gone or no longer
    eligible are deleted, whatever the limit, which holds for the eligible chunks of least id that are looked at. An index made
    with other settings is refused (ValueError) unless it is rebuilt. Doing the same again changes nothing and publishes nothing.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    spark = chunks.sparkSession
    if not rebuild and (other := configured(spark, root, settings)):
        raise ValueError("the index was made with other settings: " + ", ".join(f"{k}: wanted {w!r}, found {f!r}" for k, (w, f) in sorted(other.items())))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    try:
        state = None if rebuild else current(spark, root)
    except AnalysisException:
        state = None
    fresh = state is None
    if state is None:
        state = spark.createDataFrame([], f"chunk_id {kind}, fingerprint string, embedding array<float>")
    version = ",".join(f"{k}={v}" for k, v in sorted(settings.items()))
    c = materialize(chunks.select("chunk_id", "text", "status"), "chunks")
    eligible = c.where("status = 'eligible'").select("chunk_id", "text", vectors.fingerprint(version, F.col("text")).alias("fingerprint"))
    plan = vectors.sync_plan(eligible.select(F.col("chunk_id").alias("id"), "fingerprint"), state.select(F.col("chunk_id").alias("id"), "fingerprint"))
    if limit is not None:
        # the least ids are at most limit rows
        first = eligible.select(F.col("chunk_id").alias("id")).orderBy("id").limit(limit)
        plan = plan.where("action = 'stale'").unionByName(plan.where("action != 'stale'").join(first, "id", "left_semi"))
    plan = materialize(plan, "plan")
    todo = eligible.join(plan.where("action in ('new', 'changed')"), eligible["chunk_id"] == plan["id"]).select(F.col("chunk_id").alias("id"), "text", "fingerprint", "action")
    done = materialize(embedded(todo, encode, dimension).join(todo.select("id", "fingerprint", "action"), "id"), "embedded")
    ok = done.where("error is null")
    counts = {(r["what"], r["bad"]): r["n"] for r in plan.select(F.col("action").alias("what"), F.lit(False).alias("bad")).unionByName(done.select(F.concat(F.lit("done_"), "action").alias("what"), F.col("error").isNotNull().alias("bad"))).groupBy("what", "bad").agg(F.count("*").alias("n")).collect()}
    n = lambda what, bad=False: counts.get((what, bad), 0)
    statuses = {r["status"]: r["n"] for r in c.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if fresh or n("stale") or n("done_new") or n("done_changed"):
        out = plan.where("action = 'stale'").select(F.col("id").alias("chunk_id")).union(ok.select(F.col("id")))
        kept = state.join(out, "chunk_id", "left_anti").select("chunk_id", "fingerprint", "embedding")
        publish(kept.unionByName(ok.select(F.col("id").alias("chunk_id"), "fingerprint", "embedding")), root)
        if fresh:
            spark.createDataFrame(sorted(settings.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/settings")
    row = (sum(statuses.values()), statuses.get("eligible", 0), statuses.get("skipped", 0), statuses.get("invalid", 0), n("done_new"), n("done_changed"), n("current"), n("stale"), n("done_new", True) + n("done_changed", True))
    return spark.createDataFrame([row], ", ".join(f"{c} long" for c in REPORT))
