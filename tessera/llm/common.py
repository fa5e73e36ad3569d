"""Shared helpers of the training-corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.tables import materialize, shared_dir, ship, table

__all__ = ["LOWER_AZ", "fold", "materialize", "shared_dir", "ship", "small_table", "table", "texts"]

#: Folds A-Z in UTF-8 bytes; every byte of a non-ASCII character is above 0x7F and stays.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table of the driver's rows by way of Arrow; a list of rows would start Python workers beside those of the other steps."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table({n: pa.array(list(c)) for n, c in zip(schema.names, columns, strict=True)}), schema)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of the input can't clash; null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
