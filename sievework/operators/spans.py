"""Joins and slices of line ranges. A path is always part of the key, so no range join lacks an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import line_slice

#: Lines of a bucket by which ranges meet; long files spread over many.
BUCKET = 256


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    a, b = F.floor(F.col(start) / BUCKET), F.floor(F.greatest(F.col(end), F.col(start)) / BUCKET)
    return df.withColumn("__bucket", F.explode(F.sequence(a, b)))


def overlapping(nodes: DataFrame, blocks: DataFrame, path: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Rows of nodes whose range meets a range of blocks on the same path. Rows with a null path, start or end meet nothing."""
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    # equal rows are one row with a count: no row number, which a recomputed task could give differently
    left = _bucketed(nodes.where(known).groupBy(*nodes.columns).agg(F.count("*").alias("__n")), start, end)
    right = _bucketed(blocks.where(known).select(*path, F.col(start).alias("__s"), F.col(end).alias("__e")).distinct(), "__s", "__e")
    met = left.join(right, [*path, "__bucket"]).where((F.col(end) >= F.col("__s")) & (F.col("__e") >= F.col(start)))
    return met.select(*nodes.columns, "__n").distinct().select(*nodes.columns, F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int"))).alias("__one")).drop("__one")


def meeting(left: DataFrame, right: DataFrame, path: list[str], left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """(path columns without the last, left_keys, right_keys): distinct keys of the rows whose ranges meet on the same path."""
    known = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    a = _bucketed(left.where(known).select(*path, *left_keys, "start_line", "end_line"), "start_line", "end_line")
    b = _bucketed(right.where(known).select(*path, *right_keys, F.col("start_line").alias("__s"), F.col("end_line").alias("__e")), "__s", "__e")
    met = a.join(b, [*path, "__bucket"]).where((F.col("end_line") >= F.col("__s")) & (F.col("__e") >= F.col("start_line")))
    return met.select(*path[:-1], *left_keys, *right_keys).distinct()


def first_enclosing(points: DataFrame, blocks: DataFrame, path: list[str], at: str, key: str, order: list[str]) -> DataFrame:
    """The first block, by order, that holds each point; points outside all blocks are left out."""
    b = _bucketed(blocks, "start_line", "end_line")
    p = points.withColumn("__bucket", F.floor(F.col(at) / BUCKET))
    met = p.join(b, [*path, "__bucket"]).where((F.col("start_line") <= F.col(at)) & (F.col(at) <= F.col("end_line")))
    w = Window.partitionBy(key).orderBy(*order)
    return met.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__bucket")


def cut(ranges: DataFrame, files: DataFrame, path: list[str]) -> DataFrame:
    """Ranges (path, first, last) with the lines of their file; only files of the catalogue are read, so unknown paths drop out."""
    return ranges.join(files.select(*path, F.col("content").alias("__text")), path).withColumn("content", line_slice(F.col("__text"), F.col("first"), F.col("last"))).drop("__text")


def crop(blocks: DataFrame, segments: DataFrame, path: list[str], key: str, outermost: bool = False) -> DataFrame:
    """Each block widened to the segment that holds its first line: the innermost one, or the outermost.

    segments: (path, seq, start_line, end_line, content). Blocks in no segment stay as they are; `cropped` tells which.
    """
    s = segments.select(*path, "seq", F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"), F.col("content").alias("s_content"))
    s = s.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("s_start") / BUCKET), F.floor(F.greatest("s_end", "s_start") / BUCKET))))
    met = blocks.withColumn("__bucket", F.floor(F.col("start_line") / BUCKET)).join(s, [*path, "__bucket"]).where("s_start <= start_line AND start_line <= s_end")
    size = F.col("s_end") - F.col("s_start")
    w = Window.partitionBy(key).orderBy(size.desc() if outermost else size, "seq")
    found = met.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, "s_start", "s_end", "s_content")
    out = blocks.join(found, key, "left")
    pick = lambda new, old: F.coalesce(new, old).alias(old)
    rest = [c for c in blocks.columns if c not in ("start_line", "end_line", "content")]
    return out.select(*rest, pick("s_start", "start_line"), pick("s_end", "end_line"), pick("s_content", "content"), F.col("s_start").isNotNull().alias("cropped"))
