"""Command line: judge trees against knowledge tables."""

from __future__ import annotations

import argparse
import pathlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.context import Code
from .plans.run import run
from .sources import builders, segment, trees
from .sources.sinks import verdict_lines


def description(text: str) -> str:
    """The argument itself, or the content of the .txt or .md file it names."""
    path = pathlib.Path(text)
    return path.read_text(encoding="utf-8", errors="ignore") if path.suffix in (".txt", ".md") and path.exists() else text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievework")
    p.add_argument("--vuln-id", required=True)
    p.add_argument("--patch", required=True, help="file with a unified diff")
    p.add_argument("--desc", required=True, help="text, or a .txt or .md file")
    p.add_argument("--target-root", required=True, action="append", help="folder of a tree; may be given more than once")
    p.add_argument("--vuln-root", help="folder of the vulnerable tree")
    p.add_argument("--fix-root", help="folder of the fixed tree")
    p.add_argument("--lang", help="language of the call graph; by default Python, C, C++ and Java")
    p.add_argument("--cache", help="folder of reconstructed references and patterns")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sievework").getOrCreate()
    patch = pathlib.Path(a.patch).read_text(encoding="utf-8", errors="ignore")
    knowledge = spark.createDataFrame([(1, a.vuln_id, description(a.desc), patch, a.vuln_root, a.fix_root)], "knowledge_key long, vuln_id string, desc_text string, patch_diff string, vuln_proj_root string, fix_proj_root string")
    scanned = []
    for root in dict.fromkeys([*a.target_root, *filter(None, (a.vuln_root, a.fix_root))]):
        files = trees.files(spark, root).select(F.lit(root).alias("tree_id"), F.col("path").alias("file_path"), F.col("text").alias("content"))
        scanned.append(files)
    files = reduce(DataFrame.unionByName, scanned)
    found = segment.blocks(files).withColumn("block_key", F.xxhash64("tree_id", "file_path", "start_line", "end_line", "kind", "name"))
    edges = builders.whole_graph(files) if a.lang is None else builders.builder_of(a.lang).edges(files)
    code = Code(files.select("tree_id", F.col("tree_id").alias("proj_root")).distinct(), found, edges)
    targets = found.where(F.col("tree_id").isin(a.target_root)).select("tree_id", "block_key", "file_path", "content")
    for row in verdict_lines(run(knowledge, targets, code, cache=a.cache)).toLocalIterator():
        print(row.line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
