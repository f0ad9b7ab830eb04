"""Code around blocks: the functions that graph nodes stand for, their neighbours, the best ranked ones, whole functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import line_slice, lines, module_name, norm_path
from ..operators import graph, spans
from ..operators.skew import rows_of
from ..sources import braces, facts, segment
from ..sources.tables import materialize

#: Kinds of blocks that are one whole function.
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef", "FUNCTION_DECL", "CXX_METHOD", "CONSTRUCTOR", "DESTRUCTOR", "FUNCTION_TEMPLATE", "MethodDeclaration", "ConstructorDeclaration")


@dataclass(frozen=True)
class Code:
    """The scanned trees.

    trees: (tree_id, proj_root). blocks: (tree_id, block_key, file_path, start_line, kind, name, content), rows of one key being equal; kind
    `file` is a whole file. edges: (tree_id, src, dst), a node being a dotted name.
    """

    trees: DataFrame
    blocks: DataFrame
    edges: DataFrame


def ranged(blocks: DataFrame, *columns: str) -> DataFrame:
    """(tree_id, block_key, path, kind, name, start_line, end_line, the columns): the normal path, the end by the content. Distinct."""
    text = F.coalesce("content", F.lit(""))
    n = F.size(lines(text)) - text.endswith("\n").cast("int")
    end = (F.col("start_line") + F.greatest(n, F.lit(1)) - 1).cast("int").alias("end_line")
    return blocks.select("tree_id", "block_key", norm_path(F.col("file_path")).alias("path"), "kind", "name", "start_line", end, *columns).distinct()


def _module(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def named(blocks: DataFrame) -> DataFrame:
    """(tree_id, qualname, func_name, block): named blocks, and the functions inside whole files.

    block: (block_key, path, start_line, end_line), with the key of the block that holds the function. Texts stay where they are read.
    """
    ok = "tree_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL"
    block = F.struct("block_key", "path", "start_line", "end_line").alias("block")
    own = ranged(blocks.where(f"{ok} AND name IS NOT NULL AND coalesce(kind, '') <> 'file'")).select("tree_id", F.concat(_module(F.col("path")), F.lit("."), "name").alias("qualname"), F.col("name").alias("func_name"), block)
    whole = blocks.where(f"{ok} AND kind = 'file'").withColumn("path", norm_path(F.col("file_path")))
    files = whole.select(F.col("block_key").cast("string").alias("tree_id"), F.col("path").alias("file_path"), "content")
    places = ["key", "qualname", "func_name", "start_line", "end_line"]
    by_braces = braces.blocks(files).withColumnRenamed("tree_id", "key").select(places)
    defs = facts.facts(files).where("fact IN ('def', 'class')").select("tree_id", F.col("name").alias("full"), F.col("line").alias("start_line")).withColumn("name", F.element_at(F.split("full", r"\."), -1)).distinct()
    py = segment.blocks(files.where(F.col("file_path").endswith(".py"))).where("name IS NOT NULL").select("tree_id", "file_path", "name", "start_line", "end_line").join(defs, ["tree_id", "start_line", "name"], "left")
    py = py.select(F.col("tree_id").alias("key"), F.coalesce("full", F.concat(module_name(F.col("file_path")), F.lit("."), "name")).alias("qualname"), F.col("name").alias("func_name"), "start_line", "end_line")
    inner = whole.select("tree_id", "block_key", "path", F.col("start_line").alias("first"), F.col("block_key").cast("string").alias("key")).distinct().join(by_braces.unionByName(py).distinct(), "key")
    shift = F.col("first") - 1
    inner = inner.withColumn("start_line", (F.col("start_line") + shift).cast("int")).withColumn("end_line", (F.col("end_line") + shift).cast("int"))
    return own.unionByName(inner.select("tree_id", "qualname", "func_name", block))


def nodes(code: Code) -> DataFrame:
    """(tree_id, node, block_key, path, start_line, end_line): the nodes that a block stands for. Written."""
    e = code.edges.where("tree_id IS NOT NULL")
    all_nodes = e.select("tree_id", F.col("src").alias("node")).unionByName(e.select("tree_id", F.col("dst").alias("node"))).where("node IS NOT NULL").distinct()
    return materialize(graph.align(all_nodes, named(code.blocks), ["tree_id"]).where("block IS NOT NULL").select("tree_id", "node", "block.*"), "nodes")


def with_text(places: DataFrame, code: Code) -> DataFrame:
    """Distinct places (.., block_key, start_line, end_line) with these lines as `content`, for block_key."""
    texts = rows_of(code.blocks.select("block_key", F.col("start_line").alias("__first"), F.col("content").alias("__text")), "block_key", places.select("block_key")).dropDuplicates(["block_key"])
    out = places.join(texts, "block_key")
    return out.withColumn("content", line_slice(F.col("__text"), F.col("start_line") - F.col("__first") + 1, F.col("end_line") - F.col("__first") + 1)).drop("block_key", "__first", "__text")


def _near(code: Code) -> DataFrame:
    """(tree_id, node, near): both directions of the edges."""
    e = code.edges.where("tree_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("tree_id", "src", "dst").distinct()
    return e.toDF("tree_id", "node", "near").union(e.select("tree_id", "dst", "src")).distinct()


def linked(code: Code, known: DataFrame) -> DataFrame:
    """(block_key, other): the blocks of functions one undirected edge from a function that a block meets."""
    b = ranged(code.blocks).select("tree_id", "path", "start_line", "end_line", "block_key")
    at = spans.meeting(b, known.select("tree_id", "path", "start_line", "end_line", "node"), ["tree_id", "path"], ["block_key"], ["node"])
    far = known.select("tree_id", F.col("node").alias("near"), F.col("block_key").alias("other"))
    return at.join(_near(code), ["tree_id", "node"]).join(far, ["tree_id", "near"]).select("block_key", "other").where("block_key <> other").distinct()


def around(spots: DataFrame, code: Code, known: DataFrame) -> DataFrame:
    """(vuln_id, role, block_key, path, start_line, end_line): functions one undirected edge from those that the spots meet.

    spots: (vuln_id, role, tree_id, path, start_line, end_line).
    """
    at = spans.meeting(spots, known.select("tree_id", "path", "start_line", "end_line", "node"), ["tree_id", "path"], ["vuln_id", "role"], ["node"])
    near = at.join(_near(code), ["tree_id", "node"]).select("vuln_id", "role", "tree_id", F.col("near").alias("node")).distinct()
    return near.join(known, ["tree_id", "node"]).select("vuln_id", "role", "block_key", "path", "start_line", "end_line")


def best_ranked(roots: DataFrame, code: Code, known: DataFrame, k: int = graph.TOP_K) -> DataFrame:
    """(vuln_id, role, block_key, path, start_line, end_line): the k best blocks by HITS of the tree of each (vuln_id, role, tree_id)."""
    used = code.edges.join(roots.select("tree_id").distinct(), "tree_id", "left_semi").select("tree_id", "src", "dst")
    of = known.select("tree_id", "node", F.struct("block_key", "path", "start_line", "end_line").alias("block"))
    top = graph.top_blocks(graph.hits(used, ["tree_id"]), of, ["tree_id"], k)
    return roots.join(top, "tree_id").select("vuln_id", "role", "block.*")


def widened(blocks: DataFrame) -> DataFrame:
    """(tree_id, block_key, path, start_line, end_line, whole_key): blocks cropped to whole functions, whole_key the block that is shown.

    A block inside a function of its file becomes that function; one that no function holds whole stays as it is.
    """
    b = ranged(blocks).dropDuplicates(["block_key"]).drop("name")
    whole = F.coalesce(F.col("kind").isin(*FUNCTIONS), F.lit(False))
    # the key travels in place of the text
    b = b.withColumn("content", F.col("block_key"))
    functions = b.where(whole & F.col("tree_id").isNotNull()).withColumn("seq", F.col("block_key"))
    before = b.where(~whole).withColumn("own", F.struct("start_line", "end_line", "content"))
    cropped = spans.crop(before, functions, ["tree_id", "path"], "block_key")
    pick = lambda c: F.when(F.col("end_line") >= F.col("own.end_line"), F.col(c)).otherwise(F.col(f"own.{c}")).alias(c)
    out = b.where(whole).drop("kind").unionByName(cropped.select("tree_id", "block_key", "path", pick("start_line"), pick("end_line"), pick("content")))
    return out.withColumnRenamed("content", "whole_key")


def shown_apart(chosen: DataFrame, code: Code) -> tuple[DataFrame, DataFrame]:
    """(chosen (.., block_key) with text_key, file_path, start_line and end_line of the whole functions, their (text_key, content)). Written.

    Each text is there once, however many rows show it.
    """
    wide = widened(code.blocks).select("block_key", F.col("whole_key").alias("text_key"), "start_line", "end_line")
    known = materialize(chosen.join(wide, "block_key"), "places")
    texts = materialize(rows_of(code.blocks.select(F.col("block_key").alias("text_key"), "file_path", "content"), "text_key", known.select("text_key")).dropDuplicates(["text_key"]), "texts")
    return known.join(texts.select("text_key", "file_path"), "text_key"), texts.select("text_key", "content")


def shown(chosen: DataFrame, code: Code) -> DataFrame:
    """chosen (.., block_key) with file_path, start_line, end_line and content of the whole functions; the key stays."""
    known, texts = shown_apart(chosen, code)
    return known.join(texts, "text_key").drop("text_key")
