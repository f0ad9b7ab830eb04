"""What a judge adds: further spans of the reference trees and further functions of the targets, read from its answers.

Answers are untrusted: only well-formed items count, and only paths of the scanned trees are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FALLBACK_EXTENSIONS, extension, lines, norm_path, symbolic_summary
from ..functions.python import object_list, shorten
from ..operators import dedup, paths, similarity
from . import judge as judges
from .decide import Limits, _joined
from .judge import Judge, ask, prompt

SPANS = "array<struct<file_path: string, start_line: int, end_line: int, brief_reason: string>>"
FUNCTIONS = "array<struct<file_path: string, function: string, method: string, name: string>>"


def items(raw: Column, schema: str) -> Column:
    """The items of a judge's list, fenced, wrapped in prose or with trailing commas; an empty list for anything else."""
    return F.coalesce(F.from_json(object_list(raw), schema), F.from_json(F.lit("[]"), schema))


def reference_extensions(references: DataFrame, vulns: DataFrame) -> DataFrame:
    """(vuln_id, ext): the extensions of a vulnerability's reference blocks, or the fallback ones where it has none."""
    own = references.select("vuln_id", extension(F.col("path")).alias("ext")).where("ext <> ''").distinct()
    bare = vulns.select("vuln_id").distinct().join(own, "vuln_id", "left_anti")
    return own.unionByName(bare.select("vuln_id", F.explode(F.array(*map(F.lit, FALLBACK_EXTENSIONS))).alias("ext")))


def rendered_tree(files: DataFrame, scope: list[str], limits: Limits = Limits()) -> DataFrame:
    """(scope, files): the first entries of each tree, one a line, indented by depth; `... (truncated)` where there are more."""
    rows = paths.file_tree(files, scope, limits.tree + 1)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at(F.split("entry", "/"), -1), F.when(F.col("is_dir") == 1, "/").otherwise(""))
    text = F.when(F.col("position") > limits.tree, "... (truncated)").otherwise(line)
    return _joined(rows.withColumn("__line", text), scope, "position", F.col("__line"), limits.tree + 1, "files")


def listed_files(files: DataFrame, scope: list[str], limits: Limits = Limits()) -> DataFrame:
    """(scope, files): the first paths of each tree, one a line."""
    known = files.select(*scope, norm_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    return _joined(known, scope, "path", F.col("path"), limits.tree, "files")


def spans(knowledge: DataFrame, references: DataFrame, roots: DataFrame, files: DataFrame, judge: Judge, limits: Limits = Limits()) -> DataFrame:
    """(vuln_id, role, path, first, last, reason): the lines of each side's tree that a judge adds to the reference blocks.

    knowledge: (vuln_id, desc_text, patch_diff); roots: (vuln_id, role, tree_id); files: (tree_id, path). Items without a path or
    with lines that are none are dropped; so are paths that the tree does not have.
    """
    scope = ["vuln_id", "role"]
    snippet = F.concat("path", F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("\n"), shorten(F.coalesce("content", F.lit("")), F.lit(limits.snippet_width)))
    shown = _joined(references.withColumn("order", F.struct("path", "start_line", "end_line")), scope, "order", snippet, limits.snippets, "snippets")
    trees = roots.join(listed_files(files, ["tree_id"], limits), "tree_id").groupBy(*scope).agg(F.min("files").alias("files"))
    asked = roots.select(*scope).distinct().join(knowledge, "vuln_id").join(shown, scope, "left").join(trees, scope, "left")
    answers = ask(asked.select(*scope, prompt(judges.EXPAND, DESCRIPTION=F.col("desc_text"), PATCH=F.col("patch_diff"), SNIPPETS=F.col("snippets"), FILES=F.col("files")).alias("prompt")), judge)
    found = answers.select(*scope, F.explode(items(F.col("raw"), SPANS)).alias("x")).select(*scope, "x.*").where("file_path <> '' AND start_line >= 1 AND end_line >= start_line")
    known = roots.join(files.select("tree_id", norm_path(F.col("path")).alias("path")), "tree_id").select(*scope, "path").distinct()
    return found.select(*scope, norm_path(F.col("file_path")).alias("path"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("brief_reason").alias("reason")).join(known, [*scope, "path"], "left_semi").distinct()


def suggestions(knowledge: DataFrame, references: DataFrame, existing: DataFrame, files: DataFrame, judge: Judge, limits: Limits = Limits()) -> DataFrame:
    """(vuln_id, tree_id, file_path, name): the functions of target trees that a judge suggests.

    existing: candidates (vuln_id, tree_id, file_path, start_line, end_line, content); files: (tree_id, path) of the targets. The
    trees asked about are those with a candidate. Of their files those are shown whose extension a reference block has.
    """
    scope = ["vuln_id", "tree_id"]
    order = references.withColumn("order", F.struct("path", "start_line", "end_line"))
    refs = _joined(order, ["vuln_id"], "order", symbolic_summary(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")), limits.reference, "references")
    have = existing.withColumn("order", F.struct("file_path", "start_line", "end_line"))
    have = _joined(have, scope, "order", symbolic_summary(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")), limits.listing, "existing")
    exts = reference_extensions(references, knowledge)
    wanted = have.select(*scope).join(exts, "vuln_id").join(files.select("tree_id", "path", extension(F.col("path")).alias("ext")).distinct(), ["tree_id", "ext"])
    tree = listed_files(wanted, scope, limits)
    asked = have.join(knowledge, "vuln_id").join(refs, "vuln_id", "left").join(tree, scope, "left")
    body = prompt(judges.SUGGEST, DESCRIPTION=F.col("desc_text"), PATCH=F.col("patch_diff"), REFERENCES=F.col("references"), FILES=F.col("files"), EXISTING=F.col("existing"))
    answers = ask(asked.select(*scope, body.alias("prompt")), judge)
    found = answers.select(*scope, F.explode(items(F.col("raw"), FUNCTIONS)).alias("x")).select(*scope, "x.file_path", F.coalesce("x.function", "x.method", "x.name").alias("name"))
    return found.where("file_path <> ''").distinct()


def suggested_blocks(wanted: DataFrame, blocks: DataFrame, references: DataFrame, files: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """(vuln_id, tree_id, block_key, file_path, start_line, end_line, content, how): the blocks that suggestions stand for.

    wanted: (vuln_id, tree_id, file_path, name). The path is resolved in its tree, as `paths.resolve` does; one that no file
    fits gives nothing. `name`: blocks of the file with the name; else `similar`: blocks of the file like a reference block of
    the vulnerability; else, for a file without a block, `file`: the whole file, without a key. blocks: (tree_id, block_key,
    file_path, name, start_line, end_line, content); files: (tree_id, path, content).
    """
    named = wanted.withColumnRenamed("file_path", "wanted")
    at = paths.resolve(named.select("tree_id", "wanted"), files.select("tree_id", "path"), ["tree_id"]).select("tree_id", "wanted", "path")
    spots = named.join(at, ["tree_id", "wanted"]).select("vuln_id", "tree_id", "path", "name").distinct()
    own = blocks.withColumn("path", norm_path(F.col("file_path")))
    columns = ["vuln_id", "tree_id", "block_key", "file_path", "start_line", "end_line", "content", "how"]
    by_name = spots.join(own, ["tree_id", "path", "name"])
    rest = spots.join(by_name.select("vuln_id", "tree_id", "path", "name").distinct(), ["vuln_id", "tree_id", "path", "name"], "left_anti").select("vuln_id", "tree_id", "path").distinct()
    near = rest.join(own, ["tree_id", "path"])
    refs = references.select("vuln_id", F.xxhash64("vuln_id", "role", "path", "start_line", "end_line").alias("ref"), "content")
    (mt, t), (mr, r) = similarity.classes(near, "block_key", "content"), similarity.classes(refs, "ref", "content")
    pairs = similarity.class_pairs(t, r, threshold).join(mt.select(F.col("id").alias("block_key"), F.col("rep").alias("t_rep")), "t_rep").join(mr.select(F.col("id").alias("ref"), F.col("rep").alias("r_rep")), "r_rep").join(refs.select("vuln_id", "ref"), "ref")
    similar = near.join(pairs.select("vuln_id", "block_key").distinct(), ["vuln_id", "block_key"], "left_semi")
    whole = rest.join(own.select("tree_id", "path").distinct(), ["tree_id", "path"], "left_anti").join(files.select("tree_id", norm_path(F.col("path")).alias("path"), "content"), ["tree_id", "path"])
    whole = whole.select("vuln_id", "tree_id", F.lit(None).cast("long").alias("block_key"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.size(lines(F.col("content"))).alias("end_line"), "content", F.lit("file").alias("how"))
    out = by_name.withColumn("how", F.lit("name")).select(columns).unionByName(similar.withColumn("how", F.lit("similar")).select(columns)).unionByName(whole.select(columns))
    order = [F.array_position(F.array(*map(F.lit, ("name", "similar", "file"))), F.col("how"))]
    return dedup.first_wins(out, ["vuln_id", "tree_id", "file_path", "start_line", "end_line"], [*order, F.col("block_key")])


def new_blocks(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggested blocks that are no candidate yet: neither by key nor by place. existing: (vuln_id, tree_id, block_key, file_path, start_line, end_line)."""
    place = ["vuln_id", "tree_id", "file_path", "start_line", "end_line"]
    return found.join(existing.select("vuln_id", "tree_id", "block_key").distinct(), ["vuln_id", "tree_id", "block_key"], "left_anti").join(existing.select(*place).distinct(), place, "left_anti")

