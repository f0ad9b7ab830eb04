"""Matching of file paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename, common_suffix, norm_path, strip_diff_prefix
from ..sources.tables import materialize
from .skew import salted_join


def same_basename(targets: DataFrame, refs: DataFrame, path: str = "file_path") -> DataFrame:
    """Targets whose file name some reference has."""
    names = refs.select(basename(F.col(path)).alias("__base")).where("__base <> ''").distinct()
    return targets.withColumn("__base", basename(F.col(path))).join(names, "__base", "left_semi").drop("__base")


def resolve(wanted: DataFrame, catalogue: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, wanted, path, tier): the catalogue's path for each wanted one of its scope; unknown ones are left out.

    1: the same path. 2: the only file of that name. 3: of several files of the name, the one with the longest common end.
    4: the name in other case, by the longest common end. Ties go to the shorter path, then the least. Only files of one
    name meet, so no pair of all paths is formed; names of very many files are split over several tasks.
    """
    scope = scope or []
    w = wanted.select(*scope, "wanted").where("wanted IS NOT NULL").distinct().withColumn("norm", norm_path(strip_diff_prefix(F.col("wanted")))).withColumn("base", basename(F.col("norm"))).withColumn("key", F.lower("base"))
    files = catalogue.select(*scope, norm_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    c = files.withColumn("name", basename(F.col("path"))).withColumn("key", F.lower("name"))
    single = c.groupBy(*scope, "name").agg(F.count("*").alias("n_name"))
    asked = w.join(single.withColumnRenamed("name", "base"), [*scope, "base"], "left")
    met = salted_join(c, asked, [*scope, "key"], F.col("path")).withColumn("score", common_suffix(F.col("norm"), F.col("path")))
    tier = F.when(F.col("norm") == F.col("path"), 1).when((F.col("base") == F.col("name")) & (F.col("n_name") == 1), 2).when(F.col("base") == F.col("name"), 3).otherwise(4)
    # the best is kept as rows are combined, before any shuffle by wanted path
    best = F.min_by(F.struct("path", "tier"), F.struct("tier", -F.col("score"), F.length("path"), F.col("path")))
    return met.withColumn("tier", tier).groupBy(*scope, "wanted").agg(best.alias("x")).select(*scope, "wanted", "x.path", "x.tier")


def file_tree(files: DataFrame, scope: list[str], max_entries: int | None = None) -> DataFrame:
    """(scope, entry, depth, is_dir, position): directories and files in path order; with max_entries only that many of each scope."""
    paths = files.select(*scope, norm_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    dirs = paths.where(F.size(parts) > 1).select(*scope, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("entry")).distinct().withColumn("is_dir", F.lit(1))
    rows = dirs.unionByName(paths.select(*scope, F.col("path").alias("entry")).withColumn("is_dir", F.lit(0)))
    rows = rows.withColumn("depth", F.size(F.split("entry", "/")) - 1)
    if max_entries is not None:
        w = Window.partitionBy(*scope).orderBy("entry", F.desc("is_dir"))
        return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_entries)
    return numbered(rows, scope, ["entry", "-is_dir"])


def numbered(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The rows with `position`, from 1 within each scope by the expressions of a total order; no scope is sorted in one task.

    Rows are cut into ranges over all scopes together; how many rows of a scope stand in the ranges before one is added to
    their numbers within it.
    """
    keys = [F.col(c) for c in scope] + [F.expr(e) for e in order]
    sorted_ = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33).alias("__part")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in scope]
    ranges = sorted_.groupBy(*scope, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "ranges")
    met = sorted_.withColumn("__part", part).alias("a").join(ranges.alias("b"), [*same("a", "b"), F.col("a.__part") == F.col("b.__part")])
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int").alias("position"))
