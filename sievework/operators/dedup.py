"""Keyed merging of rows. Every choice has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq, with `position`: the least seq of the key, where the key first came in; a column of that name is replaced.

    Pre-aggregated: max_by over whole rows combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != "position"]
    merged = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"), F.min(seq).alias("position"))
    return merged.select(*keys, "__row.*", "position")


def not_selected(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose id is not there yet, nor their (path, name) where the existing name is known."""
    named = existing.where(F.col("name").isNotNull()).select("path", "name").distinct()
    return candidates.join(existing.select("id").distinct(), "id", "left_anti").join(named, ["path", "name"], "left_anti")


def with_fallback(blocks: DataFrame, fallback: DataFrame, path: list[str]) -> DataFrame:
    """The blocks, and of the fallback those of files that have no block; rows with a null path column are in no such file."""
    return blocks.unionByName(fallback.join(blocks.select(*path).distinct(), path, "left_anti"))
