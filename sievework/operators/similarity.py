"""Similarity of blocks to reference blocks by token and token-pair sets, in four modes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grams, jaccard, least_sha1
from ..functions.items import item_sets, mix
from ..sources.tables import materialize
from .skew import bitmap, held, level, salted_join, sketch

THRESHOLD = 0.6
NUM_PERM = 64
#: Bands of the banded mode; NUM_PERM / BANDS rows each. A pair at the threshold 0.6 is missed with probability (1 - 0.6**2)**32 < 1e-6.
BANDS = 32


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        sets = list(item_sets(texts, 1))
        keep = np.array([s is not None for s in sets], np.bool_)
        sets = [s for s in sets if s is not None]
        digests = [blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(digests, pa.string()), items], names=["id", "digest", "items"])


def sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, items): the item hashes of each text, sorted, and the digest of the set. Null keys and texts without a token are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_set_rows, f"id {rows.schema['id'].dataType.simpleString()}, digest string, items array<long>")


def classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((id, rep) of every record with an item, (id, items) of the representatives): equal sets are a class, its least id stands for it.

    Only ids and digests are shuffled to find the classes. A key of several texts has the least digest.
    """
    known = materialize(sets(df, key, text), "sets")
    own = known.groupBy("id").agg(F.min("digest").alias("digest"))
    members = materialize(own.join(own.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep", "digest"), "members")
    reps = members.where("id = rep").select("id", "digest")
    one = known.join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "items")
    return members.select("id", "rep"), one


def _with_enough(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, n, known) of the sets of which at least the threshold's share may be among the items of the bitmap."""
    for batch in batches:
        lists = batch.column(1)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        hit = np.concatenate(([0], np.cumsum(held(shared, flat.view(np.uint64)))))
        n, known = np.diff(at), hit[at[1:]] - hit[at[:-1]]
        rows = np.flatnonzero((known >= threshold * n - 1e-9) & (n > 0))
        ok = np.diff(hit).astype(np.bool_)
        parts = [flat[at[k] : at[k + 1]][ok[at[k] : at[k + 1]]] for k in rows.tolist()]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n[rows].astype(np.int32)), items], names=["id", "n", "known"])


def class_pairs(t: DataFrame, r: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(t_rep, r_rep, similarity) of all sets (id, items) with a Jaccard similarity of at least the threshold > 0.

    Prefix filter: of a set of n items in one fixed order, the first n - ceil(t n) + 1 must hold a shared item. The order puts
    items that no reference has first: they meet nothing and are only counted. The others follow by their number of references.
    A target of which less than the threshold's share are items of references is dropped where it is read, by a bitmap of
    fixed size. Items of very many targets are split over several tasks.
    """
    kind = t.schema["id"].dataType.simpleString()
    t, r = (materialize(x.select("id", "items"), "sets") for x in (t, r))
    ref_items = r.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    shared = bitmap(ref_items.select("item"), "item")
    kept = t.mapInArrow(lambda b: _with_enough(b, shared, threshold), f"id {kind}, n int, known array<long>")
    counts = materialize(ref_items.groupBy("item").agg(F.count("*").alias("df")), "counts")

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        known = rows.join(counts, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("known"))
        lone = F.col("n") - F.size("known")
        take = F.greatest(F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - lone, F.lit(0)).cast("int")
        placed = known.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), lone.alias("lone"), F.posexplode(F.slice("known", F.lit(1), take)).alias("at", "x"))
        return placed.select(name, f"n_{name}", (F.col("n_" + name) - F.col("lone") - F.col("at")).alias(f"left_{name}"), F.col("x.item").alias("item"))

    posted = materialize(prefix(kept.select("id", "n", F.explode("known").alias("item")), "t_rep"), "postings")
    met = salted_join(posted, prefix(ref_items, "r_rep"), ["item"], F.col("t_rep"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_t_rep") + F.col("n_r_rep")) - 1e-9
    near = met.where((F.least("n_t_rep", "n_r_rep") >= threshold * F.greatest("n_t_rep", "n_r_rep") - 1e-9) & (F.least("left_t_rep", "left_r_rep") >= need)).select("t_rep", "r_rep").distinct()
    full = near.join(t.select(F.col("id").alias("t_rep"), F.col("items").alias("a")), "t_rep").join(r.select(F.col("id").alias("r_rep"), F.col("items").alias("b")), "r_rep")
    return full.select("t_rep", "r_rep", jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def _posting_rows(batches: Iterator[pa.RecordBatch], shared, levels, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, digest, n, lone, items) of each text with an item: items is the prefix of the set that must meet, empty where too few are in the bitmap.

    The order of items is: those that no reference has (lone ones, which are counted only), then by level, then by hash.
    """
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        sets = list(item_sets(texts, 1))
        keep = np.array([s is not None for s in sets], np.bool_)
        sets = [s for s in sets if s is not None]
        digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        n = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate(([0], np.cumsum(n)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        ok = held(shared, flat)
        hit = np.concatenate(([0], np.cumsum(ok)))
        lone = n - (hit[at[1:]] - hit[at[:-1]])
        take = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 - lone
        take[n - lone < threshold * n - 1e-9] = 0
        parts = []
        for k, m in enumerate(take.tolist()):
            own = flat[at[k] : at[k + 1]][ok[at[k] : at[k + 1]]] if m > 0 else flat[:0]
            parts.append(own[np.lexsort((own, level(levels, own)))[:m]] if m > 0 else own)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(parts) if parts else flat).view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), pa.array(lone.astype(np.int32)), items], names=["id", "digest", "n", "lone", "items"])


def _wanted_sets(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """(id, digest, items) of the texts whose hash of the id, the third column, is in the bitmap."""
    for batch in batches:
        batch = batch.filter(pa.array(held(wanted, batch.column(2).to_numpy().view(np.uint64))))
        for out in _set_rows(iter([batch])):
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array([bytes.fromhex(x) for x in out.column(1).to_pylist()], pa.binary()), out.column(2)], names=["id", "digest", "items"])


def near_classes(targets: DataFrame, refs: DataFrame, key: str, text: str, ref_key: str | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, rep) of the targets, (id, rep) of the references, (t_rep, r_rep, a, b)): `classes` of both and the sets of those pairs whose similarity may reach the threshold.

    The pairs are those of `class_pairs` and like it no pair that reaches the threshold is lost, but the targets' sets are neither written
    nor shuffled: where a text is read only its digest and, if enough of its items are items of references, its prefix goes on. Sets are
    made again for the targets in pairs.
    """
    mr, r = classes(refs, ref_key or key, text)
    r = materialize(r, "sets")
    ref_items = r.select(F.explode("items").alias("item"))
    shared, levels = bitmap(ref_items, "item"), sketch(ref_items, "item")
    rows = targets.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    known = materialize(rows.mapInArrow(lambda b: _posting_rows(b, shared, levels, threshold), f"id {kind}, digest binary, n int, lone int, items array<long>"), "postings")
    own = known.groupBy("id").agg(F.min("digest").alias("digest"))
    mt = materialize(own.join(own.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep", "digest"), "members")
    reps = mt.where("id = rep").select("id", "digest")

    def posted(df: DataFrame, name: str) -> DataFrame:
        at = df.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), "lone", F.posexplode("items").alias("at", "item"))
        return at.select(name, f"n_{name}", (F.col(f"n_{name}") - F.col("lone") - F.col("at")).alias(f"left_{name}"), "item")

    t_posted = materialize(posted(known.where("size(items) > 0").join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id"]), "t_rep"), "postings")
    r_kind = r.schema["id"].dataType.simpleString()
    r_posted = posted(r.mapInArrow(lambda b: _set_postings(b, levels, threshold), f"id {r_kind}, n int, lone int, items array<long>"), "r_rep")
    met = salted_join(t_posted, r_posted, ["item"], F.col("t_rep"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_t_rep") + F.col("n_r_rep")) - 1e-9
    near = met.where((F.least("n_t_rep", "n_r_rep") >= threshold * F.greatest("n_t_rep", "n_r_rep") - 1e-9) & (F.least("left_t_rep", "left_r_rep") >= need)).select("t_rep", "r_rep").distinct()
    near = materialize(near, "near")
    some = near.select(F.col("t_rep").alias("id")).distinct()
    wanted = bitmap(some.select(F.xxhash64("id").alias("h")), "h")
    again = rows.withColumn("h", F.xxhash64("id")).mapInArrow(lambda b: _wanted_sets(b, wanted), f"id {kind}, digest binary, items array<long>")
    t = again.join(reps.join(some, "id", "left_semi"), ["id", "digest"], "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("t_rep"), F.col("items").alias("a"))
    pairs = near.join(t, "t_rep").join(r.select(F.col("id").alias("r_rep"), F.col("items").alias("b")), "r_rep").select("t_rep", "r_rep", "a", "b")
    return mt.select("id", "rep"), mr, pairs


def _set_postings(batches: Iterator[pa.RecordBatch], levels, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, n, lone, items) of the references' (id, items), as `_posting_rows` has them; no item is lone."""
    for batch in batches:
        lists = batch.column(1)
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        n = np.diff(at)
        take = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        parts = []
        for k, m in enumerate(take.tolist()):
            own = flat[at[k] : at[k + 1]]
            parts.append(own[np.lexsort((own, level(levels, own)))[:m]])
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(parts) if parts else flat[:0]).view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(n), np.int32)), items], names=["id", "n", "lone", "items"])


def exact(targets: DataFrame, refs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(target, ref, similarity) of all pairs of different keys that reach the threshold. Null and empty texts are in no pair.

    Equal sets are compared once and expanded at the end; `links` gives one row per target without expanding them.
    """
    (mt, t), (mr, r) = classes(targets, key, text), classes(refs, key, text)
    pairs = class_pairs(t, r, threshold).join(mt.select(F.col("id").alias("target"), F.col("rep").alias("t_rep")), "t_rep").join(mr.select(F.col("id").alias("ref"), F.col("rep").alias("r_rep")), "r_rep")
    return pairs.where("target <> ref").select("target", "ref", "similarity")


def links(records: DataFrame, refs: Callable[[Column], Column], key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(target, n_refs, ref, similarity): how many references each record is like, and the most similar; of equals the least.

    refs: tells of a column of keys which are those of references. Records without a like reference are left out; a
    record is not its own reference. Records of equal sets are counted, not expanded. Every text is read and hashed once.
    """
    members, reps = classes(records, key, text)
    is_ref = refs(F.col("id"))
    own = members.where(is_ref).groupBy("rep").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    second = members.where(is_ref).join(own, "rep").where("id <> first").groupBy("rep").agg(F.min("id").alias("second"))
    own = materialize(own.join(second, "rep", "left").withColumnRenamed("rep", "r_rep"), "references")
    pairs = class_pairs(reps, reps.join(own.select(F.col("r_rep").alias("id")), "id", "left_semi"), threshold)
    met = salted_join(members.select(F.col("id").alias("target"), F.col("rep").alias("t_rep")), pairs.join(own, "r_rep"), ["t_rep"], F.col("target"))
    ref = F.when(F.col("target") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    inside = (F.col("t_rep") == F.col("r_rep")) & refs(F.col("target"))
    met = met.select("target", "similarity", ref.alias("ref"), (F.col("size") - inside.cast("int")).alias("n")).where("n > 0")
    best = F.min_by(F.struct("ref", "similarity"), F.struct(-F.col("similarity"), F.col("ref")))
    return met.groupBy("target").agg(F.sum("n").alias("n_refs"), best.alias("x")).select("target", "n_refs", "x.ref", "x.similarity")


def as_shipped(targets: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Every distinct target if there is any reference, else none: signatures that never move agree with each other."""
    some = refs.limit(1).select(F.lit(1).alias("one"))
    return targets.select(key).distinct().withColumn("one", F.lit(1)).join(F.broadcast(some), "one", "left_semi").drop("one")


def shared_min(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(id, group_key, n_group): blocks by the least SHA-1 of their items; equal keys have estimated similarity 1.

    The keys are made where the texts are read; only they are shuffled. A key of several texts has the least of their keys.
    """
    own = blocks.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), least_sha1(grams(F.col(text))).alias("group_key")).where("group_key IS NOT NULL")
    keys = own.groupBy("id").agg(F.min("group_key").alias("group_key"))
    return keys.join(keys.groupBy("group_key").agg(F.count("*").alias("n_group")), "group_key").select("id", "group_key", "n_group")


def _signature_rows(batches: Iterator[pa.RecordBatch], num_perm: int, bands: int) -> Iterator[pa.RecordBatch]:
    """(id, signature, bands) of (id, items): the least of each of num_perm independent hashes, and a hash of each band of them."""
    seeds = mix(np.arange(1, num_perm + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = num_perm // bands
    for batch in batches:
        lists = batch.column(1)
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        n = batch.num_rows
        signature = np.empty((n, num_perm), np.uint64)
        if n:
            for k, seed in enumerate(seeds):
                signature[:, k] = np.minimum.reduceat(mix(flat ^ seed), at[:-1])
        band = np.zeros((n, bands), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rows):
                band = mix(band * np.uint64(31) + signature[:, k::rows][:, :bands])
        fixed = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(x.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), fixed(signature, num_perm), fixed(np.ascontiguousarray(band), bands)], names=["id", "signature", "bands"])


def _agreeing_rows(batches: Iterator[pa.RecordBatch], num_perm: int, bands: int) -> Iterator[pa.RecordBatch]:
    """(t_rep, r_rep, similarity, estimate) of (t_rep, r_rep, similarity, a, b) whose sets agree on a band of their signatures."""
    for batch in batches:
        (sa, ba), (sb, bb) = (
            [np.array(x.column(k).values.to_numpy()).reshape(x.num_rows, -1) if x.num_rows else np.zeros((0, 1)) for k in (1, 2)]
            for side in (3, 4)
            for x in _signature_rows(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(side)], names=["id", "items"])]), num_perm, bands)
        )
        rows = pa.array((ba == bb).any(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((sa == sb).mean(axis=1))], names=["t_rep", "r_rep", "similarity", "estimate"]).filter(rows)


def minhash(targets: DataFrame, refs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """(target, ref, estimate, similarity): pairs that agree on a band of their signatures, verified exactly. May miss pairs near the threshold.

    Bands so short that no pair is missed agree for nearly all pairs of sets with a third in common. So sets do not meet by them
    but by their prefixes, once for equal sets, and signatures are made and compared for the pairs that reach the threshold.
    """
    mt, mr, sets_of = near_classes(targets, refs, key, text, threshold=threshold)
    kinds = ", ".join(f"{c} {sets_of.schema[c].dataType.simpleString()}" for c in ("t_rep", "r_rep"))
    like = sets_of.withColumn("similarity", jaccard(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold - 1e-9).select("t_rep", "r_rep", "similarity", "a", "b")
    pairs = like.mapInArrow(lambda b: _agreeing_rows(b, num_perm, bands), f"{kinds}, similarity double, estimate double")
    out = pairs.join(mt.select(F.col("id").alias("target"), F.col("rep").alias("t_rep")), "t_rep").join(mr.select(F.col("id").alias("ref"), F.col("rep").alias("r_rep")), "r_rep")
    return out.where("target <> ref").select("target", "ref", "estimate", "similarity")
