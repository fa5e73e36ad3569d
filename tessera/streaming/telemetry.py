"""Telemetry events: batch roll-ups, and the same windows over a stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rollup(events: DataFrame) -> DataFrame:
    """(event_type, events, users, total, tokens): tokens from the events' JSON properties."""
    tokens = F.coalesce(F.get_json_object("props", "$.tokens"), F.get_json_object("props", "$.k")).cast("long")
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.sum(tokens).alias("tokens"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total) by tumbling windows; batch or stream."""
    ts = F.col("ts").cast("timestamp") if events.isStreaming else F.col("ts")
    w = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast(events.schema["ts"].dataType).alias("start"), "event_type", "events", "total")


def run_once(spark: SparkSession, folder: str, names: str, schema, sink: str, checkpoint: str, size: str = "1 hour") -> StreamingQuery:
    """Fold the files of folder that names fits into windows and append the closed ones to sink, from where the checkpoint left off."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
    return windowed(stream, size).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of documents (text, ts) without texts already seen within the watermark."""
    return docs.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])
