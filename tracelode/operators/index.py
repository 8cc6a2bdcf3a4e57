"""Incremental maintenance of tables: differences, upserts, cascades, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): new, removed, changed or unchanged. Null versions are equal to each other."""
    a, b = old.select(key, F.col(version).alias("was"), F.lit(True).alias("in_old")), new.select(key, F.col(version).alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Old rows with those of a given key replaced, and new ones added."""
    return old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def insert_missing(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Old rows, and the given ones whose key is not there yet."""
    return old.unionByName(rows.join(old.select(key), key, "left_anti"))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key; the group is never gathered, only its greatest row kept."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("x")).select(key, "x.*")


def ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, ancestor, depth) of every folder above each path."""
    parts = F.split(path, "/")
    rows = paths.select(path, parts.alias("parts")).where(F.size("parts") > 2)
    deep = rows.select(path, "parts", F.explode(F.sequence(F.lit(2), F.size("parts") - 1)).alias("depth"))
    return deep.select(path, F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("ancestor"), "depth")
