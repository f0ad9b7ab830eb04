"""From knowledge and trees to verdicts, for many vulnerabilities and targets at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_path, verdict
from ..operators import dedup, similarity, spans
from ..operators.skew import salted_join
from ..sources.diffs import hunks
from ..sources.tables import materialize
from . import context
from .context import Code
from . import judge as judges
from .judge import Judge, ask, prompt, rule_judge


@dataclass(frozen=True)
class Config:
    """Constants of the pipeline."""

    threshold: float = 0.6
    candidates: int = 60
    snippet: int = 220


def diffs_of(knowledge: DataFrame) -> DataFrame:
    """(vuln_id, patch_diff, seq): the different diffs of all records; seq is the greatest knowledge_key, 0 where the table has none."""
    key = F.col("knowledge_key") if "knowledge_key" in knowledge.columns else F.lit(0)
    return knowledge.where("vuln_id IS NOT NULL AND patch_diff IS NOT NULL").groupBy("vuln_id", "patch_diff").agg(F.max(key.cast("long")).alias("seq"))


def hunk_blocks(knowledge: DataFrame) -> DataFrame:
    """(vuln_id, role, path, start_line, end_line, content): both sides of each hunk with lines; the last of equal spans wins."""
    h = hunks(diffs_of(knowledge).withColumn("key", F.struct("vuln_id", "seq")), "key", "patch_diff").select("*", "key.vuln_id", "key.seq")
    side = lambda role, s: h.where((F.col(f"{s}_length") > 0) & F.col(f"{s}_path").isNotNull()).select("vuln_id", F.lit(role).alias("role"), norm_path(F.col(f"{s}_path")).alias("path"), F.col(f"{s}_start").alias("start_line"), (F.col(f"{s}_start") + F.col(f"{s}_length") - 1).alias("end_line"), F.col(f"{s}_text").alias("content"), F.struct("seq", "file_no", "hunk_no", F.col(f"{s}_text").alias("text")).alias("order"))
    both = side("vuln", "source").unionByName(side("fix", "target"))
    return both.groupBy("vuln_id", "role", "path", "start_line", "end_line").agg(F.max_by("content", "order").alias("content"))


def reference_blocks(knowledge: DataFrame, code: Code | None = None, nodes: DataFrame | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """(vuln_id, role, path, start_line, end_line, content): the hunks; with code also what the trees of both roots add.

    That is, in the vulnerable tree for role vuln and the fixed one for fix: functions one call from those a hunk meets, the
    best blocks by HITS, and the lines of expanded (vuln_id, role, path, first, last), a judge's spans. Of equal spans a hunk
    wins, then the others in this order.
    """
    found = hunk_blocks(knowledge)
    if code is None:
        return found
    nodes = context.nodes(code) if nodes is None else nodes
    found = materialize(found, "hunks")
    root = lambda role: knowledge.where("vuln_id IS NOT NULL AND patch_diff IS NOT NULL").select("vuln_id", F.lit(role).alias("role"), F.col(f"{role}_proj_root").alias("proj_root"))
    roots = materialize(root("vuln").unionByName(root("fix")).join(code.trees.select("tree_id", "proj_root"), "proj_root").select("vuln_id", "role", "tree_id").distinct(), "roots")
    keys = ["vuln_id", "role", "path", "start_line", "end_line"]
    added = context.around(found.join(roots, ["vuln_id", "role"]), code, nodes).unionByName(context.best_ranked(roots, code, nodes))
    added = materialize(added.groupBy(*keys).agg(F.min("block_key").alias("block_key")), "added")
    parts = [found, context.with_text(added, code)]
    if expanded is not None:
        files = code.blocks.where("kind = 'file'").select("tree_id", norm_path(F.col("file_path")).alias("path"), "content")
        wanted = expanded.withColumn("path", norm_path(F.col("path"))).join(roots, ["vuln_id", "role"])
        parts.append(spans.cut(wanted, files, ["tree_id", "path"]).select("vuln_id", "role", "path", F.col("first").alias("start_line"), F.col("last").alias("end_line"), "content"))
    merged = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        merged = part if merged is None else merged.unionByName(part)
    return materialize(dedup.first_wins(merged, keys, [F.col("part"), F.col("content")]).drop("part"), "references")


def one_each(knowledge: DataFrame) -> DataFrame:
    """(vuln_id, desc_text, patch_diff): the last description, and the different diffs of all records in the order of the records."""
    key = F.col("knowledge_key") if "knowledge_key" in knowledge.columns else F.lit(0)
    diffs = diffs_of(knowledge).groupBy("vuln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "patch_diff"))), lambda x: x["patch_diff"]), "\n").alias("patch_diff"))
    return knowledge.where("vuln_id IS NOT NULL").groupBy("vuln_id").agg(F.max_by("desc_text", F.when(F.col("desc_text").isNotNull(), key)).alias("desc_text")).join(diffs, "vuln_id", "left")


#: Reasons of candidates, the first of several wins.
REASONS = ("similar", "same name", "suggested", "one hop")


def candidates(refs: DataFrame, targets: DataFrame, config: Config = Config(), code: Code | None = None, nodes: DataFrame | None = None, suggestions: DataFrame | None = None) -> DataFrame:
    """(vuln_id, tree_id, block_key, reason, similarity): target blocks like a reference block, or in a file of the same name.

    targets: (tree_id, block_key, file_path, content). With code, whose blocks include the targets, also the blocks one call
    from any of these; each stands for its whole function, and of equal spans the first by reason, similarity and key is kept.
    suggestions: (vuln_id, block_key), blocks that a judge named.
    """
    r = refs.select("vuln_id", "path", F.xxhash64("vuln_id", "role", "path", "start_line", "end_line").alias("ref"), "content")
    mt, mr, sets = similarity.near_classes(targets, r, "block_key", "content", "ref", config.threshold)
    near = sets.select("t_rep", "r_rep", similarity.jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= config.threshold - 1e-9)
    t = targets.select("tree_id", "block_key", "file_path").distinct().join(mt.select(F.col("id").alias("block_key"), F.col("rep").alias("t_rep")), "block_key")
    r = r.select("vuln_id", "path", "ref").join(mr.select(F.col("id").alias("ref"), F.col("rep").alias("r_rep")), "ref")
    by_class = near.join(r.select("vuln_id", "r_rep").distinct(), "r_rep").groupBy("vuln_id", "t_rep").agg(F.max("similarity").alias("similarity"))
    scored = by_class.join(t.select("tree_id", "block_key", "t_rep"), "t_rep")
    similar = scored.groupBy("vuln_id", "tree_id", "block_key").agg(F.max("similarity").alias("similarity")).withColumn("reason", F.lit("similar"))
    named = r.select("vuln_id", F.element_at(F.split("path", "/"), -1).alias("base")).distinct()
    based = t.withColumn("base", F.element_at(F.split(norm_path(F.col("file_path")), "/"), -1))
    same = salted_join(based, named, ["base"], F.col("block_key")).select("vuln_id", "tree_id", "block_key", F.lit(None).cast("double").alias("similarity"), F.lit("same name").alias("reason"))
    both = similar.unionByName(same)
    own = targets.select("tree_id", "block_key").distinct()
    if suggestions is not None:
        both = both.unionByName(suggestions.join(own, "block_key").select("vuln_id", "tree_id", "block_key", F.lit(None).cast("double").alias("similarity"), F.lit("suggested").alias("reason")))
    order = [F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), F.desc_nulls_last("similarity"), F.col("block_key")]
    first = dedup.first_wins(both, ["vuln_id", "tree_id", "block_key"], order)
    if code is None:
        return first
    first = materialize(first, "candidates")
    nodes = context.nodes(code) if nodes is None else nodes
    near = context.linked(code, nodes).join(own.select(F.col("block_key").alias("other"), "tree_id"), "other")
    hops = first.join(near, ["tree_id", "block_key"]).select("vuln_id", "tree_id", F.col("other").alias("block_key"), F.lit(None).cast("double").alias("similarity"), F.lit("one hop").alias("reason")).distinct()
    merged = dedup.first_wins(first.unionByName(hops), ["vuln_id", "tree_id", "block_key"], order)
    # a block without a path shares its span with no other
    place = context.widened(code.blocks).select("block_key", F.struct(F.coalesce("path", F.col("block_key").cast("string")).alias("path"), "start_line", "end_line").alias("span"))
    return dedup.first_wins(merged.join(place, "block_key"), ["vuln_id", "tree_id", "span"], order).drop("span")


def verify(knowledge: DataFrame, targets: DataFrame, judge: Judge = rule_judge, config: Config = Config(), code: Code | None = None) -> DataFrame:
    """(vuln_id, tree_id, n_blocks, has_vuln, confidence, reason): a verdict for every vulnerability and tree with candidates.

    The first `candidates` blocks by similarity, then reason and key, are shown to the judge; that limit is part of the prompt's
    form. With code the stages of reference_blocks and candidates that need it run, and blocks are shown as whole functions.
    """
    nodes = None if code is None else context.nodes(code)
    chosen = candidates(reference_blocks(knowledge, code, nodes), targets, config, code, nodes)
    w = Window.partitionBy("vuln_id", "tree_id").orderBy(F.desc_nulls_last("similarity"), F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), "block_key")
    shown = chosen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= config.candidates)
    shown = shown.join(targets.select("block_key", "content").dropDuplicates(["block_key"]), "block_key") if code is None else context.shown(materialize(shown, "shown"), code)
    cases = shown.groupBy("vuln_id", "tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n").alias("code"), F.count("*").alias("n_blocks"))
    prompts = cases.join(one_each(knowledge), "vuln_id").select("vuln_id", "tree_id", "n_blocks", prompt(judges.DECIDE, DESCRIPTION=F.col("desc_text"), PATCH=F.col("patch_diff"), CODE=F.col("code")).alias("prompt"))
    return ask(prompts, judge).withColumn("v", verdict(F.col("raw"))).select("vuln_id", "tree_id", "n_blocks", "v.*")
