"""Writing results: the cache of reconstructed patterns, verdicts, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_write(df: DataFrame, path: str) -> None:
    """Rows with a cache_key, partitioned by it; only the partitions written are replaced. `:` stands as `_` in folder names."""
    df.withColumn("cache_key", F.replace("cache_key", F.lit(":"), F.lit("_"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)


def cache_read(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows of a key, reading its partition alone; None for a missing or unreadable cache."""
    try:
        found = spark.read.parquet(path).where(F.col("cache_key") == key.replace(":", "_"))
        return None if found.isEmpty() else found
    except Exception:
        return None


def cache_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a cache holds; empty for a missing or unreadable one."""
    try:
        return spark.read.parquet(path)
    except Exception:
        return spark.createDataFrame([], schema)


def graph_json(adjacency: DataFrame, path: str) -> None:
    """One JSON object per caller with its ordered callees."""
    adjacency.select("src", F.split("dsts", ",").alias("dsts")).write.mode("overwrite").json(path)


def fasten_json(nodes: DataFrame, edges: DataFrame, product: str, path: str, bases: DataFrame | None = None, requirements: DataFrame | None = None) -> None:
    """A call graph by module: names with their URIs, and calls inside and across modules.

    bases: (module, node, base), the class hierarchy, as `cha`; requirements: (product, constraint), as `depset` of every row.
    """
    uri = lambda c: F.concat(F.lit(f"//{product}/"), F.col("module"), F.lit("/"), F.col(c))
    names = nodes.groupBy("module").agg(F.array_sort(F.collect_set(uri("node"))).alias("namespace"))
    inside = F.col("src_module") == F.col("dst_module")
    calls = edges.groupBy(F.col("src_module").alias("module")).agg(F.array_sort(F.collect_set(F.when(inside, F.struct("src", "dst")))).alias("internal"), F.array_sort(F.collect_set(F.when(~inside, F.struct("src", "dst")))).alias("external"))
    out = names.join(calls, "module", "left")
    if bases is not None:
        parents = bases.groupBy("module", "node").agg(F.array_sort(F.collect_set("base")).alias("bases"))
        out = out.join(parents.groupBy("module").agg(F.array_sort(F.collect_list(F.struct(uri("node").alias("name"), "bases"))).alias("cha")), "module", "left")
    if requirements is not None:
        # one small row: the requirements of one product
        deps = requirements.agg(F.array_sort(F.collect_set(F.struct("product", "constraint"))).alias("depset")).withColumn("__one", F.lit(1))
        out = out.withColumn("__one", F.lit(1)).join(deps, "__one").drop("__one")
    out.write.mode("overwrite").json(path)


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    """The printed form of verdicts, one line each."""
    return verdicts.select(F.concat_ws(" ", F.col("vuln_id"), F.col("tree_id"), F.when(F.col("has_vuln"), "YES").otherwise("NO"), F.format_number("confidence", 2), F.col("reason")).alias("line"))
