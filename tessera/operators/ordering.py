"""Places of rows in their groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import materialize


def ordinals(rows: DataFrame, group: str, key: str, name: str = "member_index") -> DataFrame:
    """Adds the place of each row in its group, from 0, by key.

    Rows are dealt out by ranges of group and key, numbered within their part, and a part of a group
    starts after that group's rows in the parts before, so a hot group is spread over many tasks.
    """
    dealt = materialize(rows.repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part", group).agg(F.count("*").alias("_n"))
    # one row for each part that a group touches
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", group, before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", group).orderBy(key)) - 1
    return dealt.withColumn("_place", place).join(starts, ["_part", group]).withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
