"""Upserts, updates and deletes as new versions of a table, written by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the table has are dropped."""
    return table.unionByName(new.join(table.select(*key), key, "left_anti"))


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is true; unknown keeps."""
    return table.where(~F.coalesce(where, F.lit(False)))


def merge_sources(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of (key, source) in which explicit stays and snapshot never replaces another source."""
    t, n = table.select(key, F.col("source").alias("old")), new.select(key, F.col("source").alias("new"))
    keep = F.col("new").isNull() | (F.col("old") == "explicit") | (F.col("new") == "snapshot")
    return t.join(n, key, "full_outer").select(key, F.when(F.col("old").isNull(), F.col("new")).when(keep, F.col("old")).otherwise(F.col("new")).alias("source"))


def enqueue(queue: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items replace queued ones of the same key, whose attempts stay; new ones start at 0."""
    old = queue.select(key, F.col("attempts").alias("had"))
    new = items.join(old, key, "left").select(*items.columns, F.coalesce("had", F.lit(0).cast("bigint")).alias("attempts"))
    return queue.join(items.select(key), key, "left_anti").unionByName(new.select(*queue.columns))
