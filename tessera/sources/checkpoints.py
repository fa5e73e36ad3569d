"""Saved hand-offs: folders of JSON files whose fingerprints must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons why a folder can't be taken up again.
NO_STRATEGY = "A completed strategy is required."
NO_PACKET = "No packet matches the saved strategy fingerprint."
OTHER_EVALUATION = "Evaluation does not match the saved strategy and packet."
MALFORMED = "A saved file is not JSON."


def fingerprint(body: Column) -> Column:
    """SHA-256 of a JSON text whatever the order of its keys and its white space; null for other texts."""
    return F.sha2(F.to_json(F.try_parse_json(body)), 256)


def by_name(name: Column) -> Column:
    """What a file holds, by its name: strategy, packet, evaluation, or null."""
    return F.when(name == "strategy.json", "strategy").when(name.rlike(r"^packet.*\.json$"), "packet").when(name.rlike(r"^evaluation.*\.json$"), "evaluation")


def saved_files(spark: SparkSession, root: str, kind: Column | None = None) -> DataFrame:
    """(folder, name, kind, changed, body) of the files below root. kind: of columns path and name; by_name() where it isn't given."""
    m = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(m["file_path"].alias("path"), m["file_name"].alias("name"), m["file_modification_time"].alias("changed"), F.col("value").alias("body"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return rows.select(folder.alias("folder"), "name", (by_name(F.col("name")) if kind is None else kind).alias("kind"), "changed", "body").where("kind is not null")


def handoffs(files: DataFrame) -> DataFrame:
    """(folder, packet, evaluation, problem): one row for each folder of saved files.

    packet: the first by name whose fingerprint the strategy states. evaluation: the newest, of equal times the one of
    greatest name, and of equal names one that agrees; it must state the fingerprints of the strategy and its packet. problem: the first reason against a folder,
    null where it can be taken up.
    """
    said = lambda key: F.get_json_object("body", f"$.{key}")
    f = files.select("folder", "name", "kind", "changed", fingerprint(F.col("body")).alias("own"), said("status").alias("status"), said("packet_fingerprint").alias("packet_fp"), said("strategy_fingerprint").alias("strategy_fp"))
    # a folder holds a few files; its aggregates meet by folder
    strategy = f.where("kind = 'strategy'").groupBy("folder").agg(F.max_by(F.struct("own", "status", "packet_fp"), F.struct("changed", "name", "own")).alias("s"))
    packets = f.where("kind = 'packet'").join(strategy, "folder").where("own = s.packet_fp").groupBy("folder").agg(F.min("name").alias("packet"))
    stated = f.where("kind = 'evaluation'").join(strategy, "folder", "left")
    agrees = F.coalesce((F.col("packet_fp") == F.col("s.packet_fp")) & (F.col("strategy_fp") == F.col("s.own")), F.lit(False))
    newest = stated.withColumn("agrees", agrees).groupBy("folder").agg(F.max_by(F.struct("name", "agrees"), F.struct("changed", "name", "agrees")).alias("e"))
    broken = f.groupBy("folder").agg(F.max(F.col("own").isNull()).alias("broken"))
    rows = broken.join(strategy, "folder", "left").join(packets, "folder", "left").join(newest, "folder", "left")
    problem = F.when(F.col("broken"), MALFORMED).when(~F.coalesce(F.col("s.status") == "completed", F.lit(False)), NO_STRATEGY).when(F.col("packet").isNull(), NO_PACKET).when(~F.col("e.agrees"), OTHER_EVALUATION)
    return rows.select("folder", "packet", F.col("e.name").alias("evaluation"), problem.alias("problem"))


