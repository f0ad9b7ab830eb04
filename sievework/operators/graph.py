"""Call graphs as edge tables: neighbours, authority scores, differences, names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import without_interior, without_scopes
from ..sources.tables import materialize

MAX_ITER = 50
TOLERANCE = 1e-6
TOP_K = 20
#: Most different edges of a graph that one task solves whole, and after how many rounds larger graphs look for their end.
LOCAL_EDGES = 500_000
CHECK_EVERY = 5


def one_hop(edges: DataFrame, starts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node): distinct nodes one undirected edge away from the start nodes; starts may come back as neighbours.

    Edges with a null end lead nowhere.
    """
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*scope, "src", "dst").distinct()
    out = both.join(starts.withColumnRenamed("node", "src"), [*scope, "src"], "left_semi").select(*scope, F.col("dst").alias("node"))
    back = both.join(starts.withColumnRenamed("node", "dst"), [*scope, "dst"], "left_semi").select(*scope, F.col("src").alias("node"))
    return out.unionByName(back).distinct()


def _solved(scope: list[str], max_iter: int, tolerance: float, fixed: bool):
    """The scores of one scope's whole graph."""

    def solve(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, code = np.unique(np.concatenate((rows["src"].to_numpy(object), rows["dst"].to_numpy(object))), return_inverse=True)
        src, dst, w, n = code[: len(rows)], code[len(rows) :], rows["w"].to_numpy(), len(nodes)
        authority = hub = np.full(n, 1 / np.sqrt(n))
        scaled = lambda x: x / norm if (norm := np.sqrt((x * x).sum())) > 0 else np.zeros(n)
        for _ in range(max_iter):
            a = np.bincount(dst, w * hub[src], n)
            hub = scaled(np.bincount(src, w * a[dst], n))
            old, authority = authority, scaled(a)
            if not fixed and np.abs(authority - old).max() < tolerance:
                break
        return pd.DataFrame({**{c: k for c, k in zip(scope, keys)}, "node": nodes, "authority": authority, "hub": hub})

    return solve


def _rounds(weights: DataFrame, scope: list[str], max_iter: int, tolerance: float, fixed: bool) -> DataFrame:
    """The scores of graphs of any size, by joins. The edges are kept partitioned by either end, so that only scores move."""
    by_src, by_dst = (weights.repartition(*scope, end).persist(StorageLevel.MEMORY_AND_DISK) for end in ("src", "dst"))
    nodes = weights.select(*scope, F.col("src").alias("node")).unionByName(weights.select(*scope, F.col("dst").alias("node"))).distinct()
    size = nodes.groupBy(*scope).agg((1 / F.sqrt(F.count("*"))).alias("h"))
    scores = materialize(nodes.join(size, scope).select(*scope, "node", F.col("h").alias("authority"), F.col("h").alias("hub")), "scores")
    for k in range(1, max_iter + 1):
        auth = by_src.join(scores.select(*scope, F.col("node").alias("src"), "hub"), [*scope, "src"]).groupBy(*scope, "dst").agg(F.sum(F.col("w") * F.col("hub")).alias("a"))
        hub = by_dst.join(auth, [*scope, "dst"]).groupBy(*scope, "src").agg(F.sum(F.col("w") * F.col("a")).alias("h"))
        new = scores.join(auth.withColumnRenamed("dst", "node"), [*scope, "node"], "left").join(hub.withColumnRenamed("src", "node"), [*scope, "node"], "left")
        new = materialize(new.select(*scope, "node", F.col("authority").alias("old"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")), "scores")
        norm = new.groupBy(*scope).agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("nh"))
        scaled = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
        moved = new.join(norm, scope).select(*scope, "node", "old", scaled("a", "na").alias("authority"), scaled("h", "nh").alias("hub"))
        if not fixed and (k % CHECK_EVERY == 0) and (moved.agg(F.max(F.abs(F.col("authority") - F.col("old")))).first()[0] or 0.0) < tolerance:
            scores = moved.drop("old")
            break
        scores = moved.drop("old")
    scores = materialize(scores, "scores")
    by_src.unpersist()
    by_dst.unpersist()
    return scores


def hits(edges: DataFrame, scope: list[str], max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, fixed: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(scope, node, authority, hub) for every node of an edge; parallel edges count as often as they come.

    authority' = sum of hubs over in-edges, hub' = sum of authority' over out-edges, then both are scaled to length 1 per
    scope. The rounds of a scope end when none of its authorities moves by the tolerance or more. Parallel edges are
    pre-aggregated to weights, so a hot callee is one row per caller. A scope of at most local_edges different edges is solved
    whole in one task, all such scopes in parallel; larger ones together by rounds of joins, where the end is looked for every
    CHECK_EVERY rounds. Either way gives the same scores.
    """
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").where(" AND ".join(f"{c} IS NOT NULL" for c in scope))
    weights = materialize(known.groupBy(*scope, "src", "dst").agg(F.count("*").cast("double").alias("w")), "weights")
    large = materialize(weights.groupBy(*scope).agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select(*scope), "large")
    kinds = ", ".join(f"`{c}` {weights.schema[c].dataType.simpleString()}" for c in scope)
    small = weights.join(large, scope, "left_anti").groupBy(*scope).applyInPandas(_solved(scope, max_iter, tolerance, fixed), f"{kinds}, node string, authority double, hub double")
    if large.isEmpty():
        return small
    return small.unionByName(_rounds(weights.join(large, scope, "left_semi"), scope, max_iter, tolerance, fixed))


def top_k(scores: DataFrame, scope: list[str], k: int = TOP_K) -> DataFrame:
    """The k nodes of the greatest authority of each scope; of equals the least name. Scores are compared at nine decimals."""
    w = Window.partitionBy(*scope).orderBy(F.desc(F.round("authority", 9)), "node")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_blocks(scores: DataFrame, blocks: DataFrame, scope: list[str], k: int = TOP_K) -> DataFrame:
    """(scope, block, node, rank): the k distinct blocks of the greatest authority of each scope, each by its best node.

    blocks: (scope, node, block). Nodes without a block are skipped before counting; scores are compared as in top_k.
    """
    known = scores.join(blocks.where("block IS NOT NULL"), [*scope, "node"])
    best = known.groupBy(*scope, "block").agg(F.min(F.struct((-F.round("authority", 9)).alias("a"), "node")).alias("best"))
    w = Window.partitionBy(*scope).orderBy("best.a", "best.node", "block")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*scope, "block", F.col("best.node").alias("node"), "rank")


def difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with `change`: added or removed."""
    a, b = old.select(*columns), new.select(*columns)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def align(nodes: DataFrame, blocks: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node, block): the block of each node by its qualified name, else by its last segment where only one block has that name."""
    last = F.element_at(F.split(F.element_at(F.split("node", r"\."), -1), ":"), -1)
    exact = blocks.select(*scope, F.col("qualname").alias("node"), "block").groupBy(*scope, "node").agg(F.min("block").alias("exact"))
    unique = blocks.groupBy(*scope, F.col("func_name").alias("last")).agg(F.min("block").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = nodes.join(exact, [*scope, "node"], "left").withColumn("last", last).join(unique, [*scope, "last"], "left")
    return out.select(*scope, "node", F.coalesce("exact", "only").alias("block"))


def clean_edges(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct edges between named functions: builtin and literal ends, control-flow segments, interior parts and self edges gone."""
    keep = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> ''").where(~F.col("src").startswith("<builtin>") & ~F.col("dst").startswith("<builtin>") & ~F.col("src").contains("<RETURN>") & ~F.col("dst").contains("<RETURN>") & ~F.col("dst").isin("<str>", "<int>"))
    named = keep.select(*scope, without_interior(without_scopes(F.col("src"))).alias("src"), without_interior(without_scopes(F.col("dst"))).alias("dst"))
    return named.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def constructor_links(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Edges X -> X.__init__ where both are nodes."""
    init = nodes.where(F.col("node").endswith(".__init__")).select(*scope, F.regexp_replace("node", r"\.__init__$", "").alias("src"), F.col("node").alias("dst"))
    return init.join(nodes.withColumnRenamed("node", "src"), [*scope, "src"], "left_semi").select(*scope, "src", "dst").distinct()


def adjacency(edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, src, n_dst, dsts): the distinct callees of each caller, ordered and joined by commas."""
    distinct = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*scope, "src", "dst").distinct()
    return distinct.groupBy(*scope, "src").agg(F.count("*").alias("n_dst"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("dsts"))


def method_edges(calls: DataFrame) -> DataFrame:
    """Edges of (package, owner, caller, callee) rows with the callee taken to be in the caller's own class."""
    full = lambda m: F.concat(F.when(F.coalesce("package", F.lit("")) != "", F.concat("package", F.lit("."))).otherwise(""), F.col("owner"), F.lit("#"), F.col(m))
    return calls.where("caller IS NOT NULL AND callee IS NOT NULL").select(full("caller").alias("src"), full("callee").alias("dst")).distinct()
