"""What of a packet is sent on: sources under a budget, excerpts, and rows that say what was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    archive: int = 24
    research: int = 8
    characters: int = 3000


# Remarks on what was left out, in order.
INELIGIBLE = "Ineligible archive material was omitted from strategy input."
ARCHIVE_FULL = "Archive source limit reached; some material was not sent."
SHORTENED = "Some source excerpts were shortened for the model context."
RESEARCH_FULL = "Research source limit reached; some sources were not sent."


def packed(items: DataFrame, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:
    """((request_id, kind, place, source_id, excerpt), (request_id, ordinal, warning)) of packets' sources.

    items: request_id, kind (archive or research), position, source_id, text, eligible (of archive items), internet (whether research may be
    used; null is no). Archive items are taken in order of position until the budget is full; what stands behind the first eligible
    one that finds no place isn't looked at, and gives no remark of its own. Excerpts are the first characters. A source that a
    packet names twice is taken once, at its first position. Each window holds one packet's items of one kind.
    """
    rows = items.select("request_id", "kind", "position", "source_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("eligible", F.lit(True)).alias("ok"), F.coalesce("internet", F.lit(False)).alias("internet"))
    first = Window.partitionBy("request_id", "kind", "source_id").orderBy("position")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1 and (kind = 'archive' or internet)")
    so_far = Window.partitionBy("request_id", "kind").orderBy("position", "source_id").rowsBetween(Window.unboundedPreceding, 0)
    most = F.when(F.col("kind") == "archive", budget.archive).otherwise(budget.research)
    good = F.col("ok") | (F.col("kind") != "archive")
    rows = rows.withColumn("place", F.count_if(good).over(so_far)).withColumn("good", good).withColumn("most", most)
    looked = rows.where(F.col("place") <= F.col("most"))
    kept = looked.where("good").select("request_id", "kind", (F.col("place") - 1).alias("place"), "source_id", F.substring("text", 1, budget.characters).alias("excerpt"), (F.length("text") > budget.characters).alias("cut"))
    said = lambda df, k, what: df.select("request_id", F.lit(k).alias("k"), F.lit(what).alias("warning")).distinct()
    full = rows.where("good and place > most")
    remarks = said(looked.where("not good"), 0, INELIGIBLE).unionByName(said(kept.where("cut and kind = 'archive'"), 1, SHORTENED)).unionByName(said(full.where("kind = 'archive'"), 2, ARCHIVE_FULL)).unionByName(said(full.where("kind = 'research'"), 3, RESEARCH_FULL))
    ordinal = F.row_number().over(Window.partitionBy("request_id").orderBy("k")) - 1
    return kept.drop("cut"), remarks.select("request_id", ordinal.alias("ordinal"), "warning")
