"""The whole run: references and patterns of each vulnerability, which may be cached; candidates and verdicts for each target."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cache_key, norm_path
from ..operators import rank
from ..sources import sinks
from ..sources.tables import materialize
from . import context, decide, expand, pipeline
from .context import Code
from .decide import Limits
from .judge import Judge, rule_judge
from .pipeline import Config

REFERENCES = ["vuln_id", "role", "path", "start_line", "end_line", "content"]


def run_key(config: Config, limits: Limits) -> Column:
    """The cache key of a row (desc_text, patch_diff, both roots): it depends on all inputs of the reconstruction."""
    parts = [F.col(c) for c in ("vuln_id", "desc_text", "patch_diff", "vuln_proj_root", "fix_proj_root")]
    return cache_key(*[F.concat(F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts], F.lit(str((astuple(config), astuple(limits)))))


def reconstruct(knowledge: DataFrame, code: Code, judge: Judge = rule_judge, config: Config = Config(), limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(references, patterns) of the vulnerabilities: hunks, one-hop context, best ranked blocks, the judge's spans; then its patterns."""
    nodes = context.nodes(code)
    one = materialize(pipeline.one_each(knowledge), "one")
    root = lambda role: knowledge.where("vuln_id IS NOT NULL AND patch_diff IS NOT NULL").select("vuln_id", F.lit(role).alias("role"), F.col(f"{role}_proj_root").alias("proj_root"))
    roots = root("vuln").unionByName(root("fix")).join(code.trees.select("tree_id", "proj_root"), "proj_root").select("vuln_id", "role", "tree_id").distinct()
    files = code.blocks.select("tree_id", F.col("file_path").alias("path"))
    spans = expand.spans(one, pipeline.hunk_blocks(knowledge), roots, files, judge, limits).select("vuln_id", "role", "path", "first", "last")
    references = pipeline.reference_blocks(knowledge, code, nodes, spans)
    return references, materialize(decide.patterns(one, references, judge, limits), "patterns")


def cached(knowledge: DataFrame, code: Code, path: str, judge: Judge = rule_judge, config: Config = Config(), limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """reconstruct by way of a cache folder: vulnerabilities whose key is there are read, the others are computed and written.

    The key is of a vulnerability's records together, so another diff, root or limit is another key.
    """
    spark = knowledge.sparkSession
    keyed = knowledge.withColumn("row_key", run_key(config, limits)).where("vuln_id IS NOT NULL").groupBy("vuln_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("row_key"))).alias("k")).select("vuln_id", cache_key(F.col("k")).alias("cache_key"))
    keyed = materialize(keyed.withColumn("cache_key", F.replace("cache_key", F.lit(":"), F.lit("_"))), "keys")
    known = sinks.cache_table(spark, f"{path}/done", "vuln_id string, cache_key string").select("cache_key").distinct()
    missing = materialize(keyed.join(known, "cache_key", "left_anti"), "missing")
    if not missing.isEmpty():
        todo = knowledge.join(missing.select("vuln_id"), "vuln_id", "left_semi")
        references, patterns = reconstruct(todo, code, judge, config, limits)
        sinks.cache_write(references.join(missing, "vuln_id"), f"{path}/references")
        sinks.cache_write(patterns.join(missing, "vuln_id"), f"{path}/patterns")
        sinks.cache_write(missing, f"{path}/done")  # last: what is not whole is computed again
    read = lambda name: spark.read.parquet(f"{path}/{name}").join(keyed.select("cache_key"), "cache_key", "left_semi").drop("cache_key")
    return read("references").select(*REFERENCES), read("patterns")


def run(knowledge: DataFrame, targets: DataFrame, code: Code, judge: Judge = rule_judge, config: Config = Config(), limits: Limits = Limits(), cache: str | None = None) -> DataFrame:
    """(vuln_id, tree_id, n_shown, n_chosen, has_vuln, confidence, reason): all stages, the judge being asked in each of them.

    targets: (tree_id, block_key, file_path, content), blocks of code. Suggested functions join the candidates.
    """
    references, patterns = reconstruct(knowledge, code, judge, config, limits) if cache is None else cached(knowledge, code, cache, judge, config, limits)
    references, one = materialize(references, "references"), materialize(pipeline.one_each(knowledge), "one")
    nodes = context.nodes(code)
    first = materialize(pipeline.candidates(references, targets, config), "first")
    known = context.ranged(code.blocks, "content").select("block_key", F.col("path").alias("file_path"), "name", "start_line", "end_line", "content").dropDuplicates(["block_key"])
    existing = first.select("vuln_id", "tree_id", "block_key").join(known, "block_key")
    in_targets = code.blocks.join(targets.select("tree_id").distinct(), "tree_id", "left_semi")
    files = in_targets.select("tree_id", F.col("file_path").alias("path"))
    wanted = expand.suggestions(one, references, existing, files, judge, limits)
    whole = in_targets.where("kind = 'file'").select("tree_id", norm_path(F.col("file_path")).alias("path"), "content").dropDuplicates(["tree_id", "path"])
    found = expand.suggested_blocks(wanted, known.join(targets.select("tree_id", "block_key").distinct(), "block_key"), references, files.distinct().join(whole, ["tree_id", "path"], "left"), config.threshold)
    suggested = expand.new_blocks(found, existing).where("block_key IS NOT NULL").select("vuln_id", "block_key").distinct()
    chosen = pipeline.candidates(references, targets, config, code, nodes, suggested).select("vuln_id", "tree_id", "block_key")
    shown = context.shown(materialize(chosen, "chosen"), code)
    names = rank.important_names(knowledge, references.select("vuln_id", "path"))
    return decide.decide(one, shown, names, judge, judge, limits, patterns)
