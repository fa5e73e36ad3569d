"""Snapshot tables: filters, counts, change-only upserts, replacement, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import equal


def listed(df: DataFrame, filters: dict, allowed: tuple[str, ...], order: list[str], limit: int = -1, offset: int = 0) -> DataFrame:
    """Rows that meet the filters, in order; limit -1: all."""
    out = df.where(equal(filters, allowed)).orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit < 0 else out.limit(limit)


def contains_text(col: Column, needle: str) -> Column:
    """Literal substring in either case; %, _ and the backslash mean themselves."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col.ilike(f"%{escaped}%")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def count_by(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(value, total), null as (none)."""
    if column not in allowed:
        raise ValueError(f"unknown column: {column}")
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("total"))


def upsert_changed(old: DataFrame, new: DataFrame, key: str, stamp: Column) -> DataFrame:
    """The next snapshot, and how each row came there: inserted, updated, unchanged or kept.

    old has the columns of new and created_at, updated_at. A row of new that is equal to the old
    one, nulls included, keeps both times. Rows of old that new doesn't have are kept.
    """
    cols = [c for c in new.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("o"), "created_at", "updated_at")
    n = new.select(key, F.struct(*cols).alias("n"))
    both = o.join(n, key, "full_outer")
    how = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated")
    fresh = how.isin("inserted", "updated")
    return both.select(key, *[F.coalesce(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")), F.when(F.col("n").isNull(), F.col(f"o.{c}"))).alias(c) for c in cols], F.when(how == "inserted", stamp).otherwise(F.col("created_at")).alias("created_at"), F.when(fresh, stamp).otherwise(F.col("updated_at")).alias("updated_at"), how.alias("change"))


def replace_set(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """Rows of old outside the scopes that new names, and all of new."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children all, with the foreign key null where the parent is gone."""
    there = parents.select(F.col(key).alias("_there")).distinct()
    kept = children.join(there, F.col(foreign) == F.col("_there"), "left")
    return kept.withColumn(foreign, F.when(F.col("_there").isNotNull(), F.col(foreign))).drop("_there")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness: an empty result is what a writer asserts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1 or " + f"`{key}` is null")


def stats(df: DataFrame, columns: tuple[str, ...], measure: Column) -> DataFrame:
    """(level, value, total, measured): a count and a sum for each column's values and for all rows, in one pass."""
    sets = [[c] for c in columns] + [[]]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("total"), F.sum(measure).alias("measured"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    level = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, c) for i, c in enumerate(columns)], F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for i, c in enumerate(columns)], F.lit("all"))
    return grouped.select(level.alias("level"), value.alias("value"), "total", "measured")


def replace_all(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): what making new the complete set does to each row: deleted, inserted, unchanged or updated."""
    cols = [c for c in new.columns if c != key]
    both = old.select(key, F.struct(*cols).alias("o")).join(new.select(key, F.struct(*cols).alias("n")), key, "full_outer")
    same = F.col("o").eqNullSafe(F.col("n"))
    return both.select(key, F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "inserted").when(same, "unchanged").otherwise("updated").alias("change"))


def resolved(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Distinct asked ids with the columns of their rows and found; ids without a row are kept and reported, not dropped."""
    there = df.withColumn("_found", F.lit(True))
    return ids.select(key).distinct().join(there, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def subset_in_order(df: DataFrame, ids: DataFrame, key: str, order: str, limit: int = -1) -> DataFrame:
    """Rows of the named ids in the table's own order, then the first of them; limit -1: all."""
    out = by_ids(df, ids, key).orderBy(order, key)
    return out if limit < 0 else out.limit(limit)
