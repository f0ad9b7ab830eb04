"""Call graph builders by language: the function blocks and the call edges of the files of trees.

A builder is any object with `blocks(files)` and `edges(files)`; `register` adds one or replaces one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_name
from . import braces, facts, flows, segment

EDGES = "tree_id string, src string, dst string, edge_kind string"


def python_blocks(files: DataFrame) -> DataFrame:
    """The functions of Python files with their qualified names, lines and texts, as `braces.BLOCKS`. Files that do not parse give none."""
    defs = facts.facts(files).where("fact = 'def'").select("tree_id", "module", F.col("name").alias("qualname"), F.col("line").alias("start_line")).distinct()
    found = segment.blocks(files.where(F.col("file_path").endswith(".py"))).where("name IS NOT NULL AND NOT heuristic").withColumn("module", module_name(F.col("file_path")))
    met = found.join(defs, ["tree_id", "module", "start_line"]).where(F.element_at(F.split("qualname", r"\."), -1) == F.col("name"))
    return met.select("tree_id", "file_path", "qualname", F.col("name").alias("func_name"), "start_line", "end_line", "content")


def _none(files: DataFrame, schema: str) -> DataFrame:
    return files.sparkSession.createDataFrame([], schema)


@dataclass(frozen=True)
class Builder:
    """Blocks in the form of `braces.BLOCKS` and edges in the form of EDGES, of files (tree_id, file_path, content)."""

    blocks: Callable[[DataFrame], DataFrame]
    edges: Callable[[DataFrame], DataFrame]


#: For other languages: an empty graph, with which every stage that needs one leaves its input as it is.
NONE = Builder(lambda files: _none(files, braces.BLOCKS), lambda files: _none(files, EDGES))
_PYTHON = Builder(python_blocks, flows.resolved_edges)
_BRACES = Builder(braces.blocks, lambda files: braces.symbol_edges(braces.facts(files)))
_BUILDERS = {"py": _PYTHON, "python": _PYTHON, "c": _BRACES, "cpp": _BRACES, "c++": _BRACES, "java": _BRACES}


def register(language: str, builder: Builder) -> None:
    _BUILDERS[language.lower()] = builder


def builder_of(language: str | None) -> Builder:
    """The builder of a language, whatever the case of its name; NONE for an unknown one."""
    return _BUILDERS.get((language or "").strip().lower(), NONE)


def whole_graph(files: DataFrame, languages: tuple[str, ...] = ("python", "c")) -> DataFrame:
    """The distinct edges of several languages together; C stands for all that are read by their braces."""
    out = _none(files, EDGES)
    for language in languages:
        out = out.unionByName(builder_of(language).edges(files).select(*[c.split()[0] for c in EDGES.split(", ")]))
    return out.distinct()
