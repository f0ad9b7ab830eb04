"""Ordered listings and signals for a judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename


def important_names(knowledge: DataFrame, key_paths: DataFrame | None = None) -> DataFrame:
    """(vuln_id, name): file names in the diff that end in .java or .py, and the base names of the key spans' paths."""
    found = knowledge.where("patch_diff IS NOT NULL").select("vuln_id", F.explode(F.regexp_extract_all("patch_diff", F.lit(r"[A-Za-z0-9_]+\.java|[A-Za-z0-9_]+\.py"), F.lit(0))).alias("name"))
    if key_paths is not None:
        found = found.unionByName(key_paths.select("vuln_id", basename(F.col("path")).alias("name")).where("name <> ''"))
    return found.distinct()


def listing(blocks: DataFrame, names: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """The first `limit` blocks of each scope: those in an important file first, then by file name, path, start and key."""
    named = blocks.withColumn("base", basename(F.col("file_path")))
    marked = named.join(names.select(F.col("name").alias("base")).distinct().withColumn("__hit", F.lit(0)), "base", "left").withColumn("priority", F.coalesce("__hit", F.lit(1))).drop("__hit")
    w = Window.partitionBy(*scope).orderBy("priority", "base", "file_path", "start_line", "block_key")
    return marked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def signals(blocks: DataFrame, text: str, needles: dict[str, str], scope: list[str]) -> DataFrame:
    """For each scope and needle, whether any text holds it; null texts hold nothing."""
    return blocks.groupBy(*scope).agg(*[F.coalesce(F.bool_or(F.col(text).contains(n)), F.lit(False)).alias(name) for name, n in needles.items()])
