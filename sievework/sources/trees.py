"""Code trees as tables of files: listing, decoding, packages, requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

import pandas as pd

from ..functions.columns import DEFAULT_EXTENSIONS, has_extension, module_name, version_range


@pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 with bad bytes dropped, all line ends as LF. Spark's own decode fails on bad bytes."""
    return pd.Series([None if c is None else bytes(c).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in content], dtype=object)


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = DEFAULT_EXTENSIONS) -> DataFrame:
    """(path, text) of the files below a folder whose names end in one of the extensions, the case counting.

    Paths are relative to the folder. Nothing is ignored; unreadable files are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.substring_index(F.col("path"), f"{base}/", -1)
    rows = raw.select(path.alias("path"), "content")
    if extensions is not None:
        rows = rows.where(has_extension(F.col("path"), extensions))
    return rows.select("path", decode("content").alias("text"))


def packages(tree: DataFrame) -> DataFrame:
    """(path, module) of the Python files of a tree."""
    return tree.where(F.col("path").endswith(".py")).select("path", module_name(F.col("path")).alias("module"))


def requirements(lines: DataFrame, line: Column) -> DataFrame:
    """(product, constraint) of requirement lines; empty lines, comments and options dropped."""
    parsed = lines.select(version_range(line).alias("r")).select("r.*")
    return parsed.where("product <> ''").distinct()
