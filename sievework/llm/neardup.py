"""Near-duplicate records: all pairs of different texts whose item sets have a Jaccard similarity of at least a threshold.

Items are the distinct tokens of a text and its distinct pairs of adjacent tokens. The search is exact:

1. Equal texts collapse to the record with the least key.
2. A counting sketch of fixed size tells how rare each item is; it covers all records. Any fixed order of items is
   correct for the prefix filter, so collisions in the sketch cost time only.
3. Each record is posted under the rarest items of its prefix (two similar records share at least one of them). Items that no
   other record can have are not posted, and postings without another of a fitting size and place are dropped. Items that are
   posted for more than TILE records are cut into cells of two parts of their records, for different tasks; how many parts
   the sketch tells while it has room, and beyond that a count of the items that may be so frequent.
4. The others get a parity bitmap of their record's items. Under each item the bitmaps are compared in tiles with exclusive-or
   and bit counts. The bitmaps of two sets differ in no more bits than the sets differ in items, so the radius
   (1-t)/(1+t) * (|a|+|b|) loses no pair. Tiles are cut from the records in the order of their population counts; pairs of
   tiles, and then of records, whose population counts differ by more than the radius are skipped unseen.
5. The pairs that are left are compared exactly on their item sets, gathered in bins; large bins are cut into cells in the same way.

Texts are read where they lie, again for each step, and tables of keys go to them: up to FEW keys whole, of more a bitmap of
fixed size. The texts that move are those of records in pairs that are left, and beyond FEW copies those of the copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.items import item_sets
from ..operators.skew import bitmap, held, salted_join
from ..sources.tables import discard, materialize, release

THRESHOLD = 0.6
MIN_TOKENS = 40
#: The sketch has 2**CELL_BITS cells of four bits, whatever the size of the data: this bounds what is broadcast.
CELL_BITS = 27
SLICE_BITS = 16
#: Most records of one item that a task compares with as many others.
TILE = 2048
#: Most records whose sets one task holds to verify their pairs.
BIN = 5000
#: Items a cell of the sketch from which its bounds are not near enough to the items' own counts.
LOAD = 1.0
#: Rows of a tile of bitmaps.
ROWS = 64
BASE_BITS = 512
#: Keys up to which a table of them is broadcast to the texts; a bitmap tells of more.
FEW = 100_000


def encode_counts(counts: np.ndarray) -> np.ndarray:
    """Counts as four bits, two cells a byte: themselves up to 7, powers of two from 8 on, at most 15. Keeps the order."""
    code = np.minimum(counts, 7).astype(np.uint8)
    high = counts >= 8
    code[high] = np.minimum(8 + np.floor(np.log2(counts[high] / 8)).astype(np.int64), 15)
    return code[::2] | code[1::2] << 4


class Sketch:
    """The dense sketch: codes of cells, and the greatest count of each slice, which bounds counts beyond the codes."""

    def __init__(self, slices: list[tuple[int, int, bytes]], bits: int = CELL_BITS):
        self.bits = bits
        self.codes = np.zeros(1 << bits - 1, np.uint8)
        self.most = np.zeros(1 << bits - SLICE_BITS, np.int64)
        half = 1 << SLICE_BITS - 1
        for s, most, packed in slices:
            self.codes[s * half : (s + 1) * half] = np.frombuffer(zlib.decompress(packed), np.uint8)
            self.most[s] = most

    def code(self, items: np.ndarray) -> np.ndarray:
        cells = (items >> np.uint64(64 - self.bits)).astype(np.int64)
        return self.codes[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8) & np.uint8(15)

    def at_most(self, items: np.ndarray, code: np.ndarray) -> np.ndarray:
        """An upper bound of the counts of items with these codes."""
        most = self.most[(items >> np.uint64(64 - self.bits + SLICE_BITS)).astype(np.int64)]
        return np.where(code < 8, code, np.where(code < 15, (16 << np.maximum(code.astype(np.int64) - 8, 0)) - 1, most))


def parity(items: np.ndarray, width: int) -> np.ndarray:
    """Bit b is the parity of the number of items that end in b."""
    odd = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """The parity bitmap of a smaller width from that of a larger one."""
    while len(bits) * 8 > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def width_of(n: int) -> int:
    return max(BASE_BITS, 1 << (2 * n - 1).bit_length())


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary()).to_pylist()
    return keys, [t or b"" for t in texts]


def sketch_part(batches: Iterator[pa.RecordBatch], least: int, bits: int = CELL_BITS) -> Iterator[pa.RecordBatch]:
    """Counts of the sketch's cells over one partition, as sparse slices."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
        slices = (cells >> np.uint64(SLICE_BITS)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(slices, prepend=-1))
        low, counts = (cells & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint16), np.minimum(counts, 65535).astype(np.uint16)
        ends = [*cuts[1:], len(cells)]
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(slices[cuts], pa.int32()), pack(low), pack(counts)], names=["slice", "cells", "counts"])

    for batch in batches:
        for items in item_sets(_texts(batch)[1], least):
            if items is not None:
                held.append(items)
                size += len(items)
            if size > 8_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole slices of the sketch from the parts of this partition, which holds all parts of its slices, ordered by slice."""
    at, total = -1, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(total.max())], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([zlib.compress(encode_counts(total).tobytes(), 1)], pa.binary())], names=["slice", "most", "sum", "codes"])

    for batch in batches:
        for s, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if s != at:
                if total is not None:
                    yield done()
                at, total = s, np.zeros(1 << SLICE_BITS, np.int64)
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint16)
    if total is not None:
        yield done()


def _sketch(broadcast) -> Sketch:
    """The dense sketch, unpacked once in each Python worker."""
    dense = getattr(broadcast, "dense", None)
    if dense is None:
        dense = broadcast.dense = Sketch(*broadcast.value)
    return dense


def posting_rows(batches: Iterator[pa.RecordBatch], least: int, threshold: float, sketch) -> Iterator[tuple[np.ndarray, ...]]:
    """(items, records, sizes, places, bounds of the items' counts) of the prefix items of each batch of records."""
    counts = _sketch(sketch)
    for batch in batches:
        keys, texts = _texts(batch)
        out: list[list] = [[], [], [], [], []]
        for key, items in zip(keys, item_sets(texts, least)):
            if items is None:
                continue
            n = len(items)
            code = counts.code(items)
            prefix = n - int(np.ceil(threshold * n - 1e-9)) + 1
            order = np.argsort((code.astype(np.uint64) << np.uint64(56)) | (items >> np.uint64(8)), kind="stable")[:prefix]
            place = np.flatnonzero(code[order] > 1)
            if not len(place):
                continue
            own = items[order[place]]
            for col, x in zip(out, (own.view(np.int64), np.full(len(own), key, np.int64), np.full(len(own), n, np.int32), place.astype(np.int32), counts.at_most(own, code[order[place]]))):
                col.append(x)
        if out[0]:
            yield tuple(np.concatenate(c) for c in out)


def postings(batches: Iterator[pa.RecordBatch], least: int, threshold: float, sketch, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """(item, rec, n, place, tiles): tiles by the bound of the item's count."""
    for item, rec, n, place, most in posting_rows(batches, least, threshold, sketch):
        tiles = np.maximum(1, -(-most // tile)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rec), pa.array(n), pa.array(place), pa.array(tiles)], names=["item", "rec", "n", "place", "tiles"])


def hot_counts(batches: Iterator[pa.RecordBatch], least: int, threshold: float, sketch, tile: int) -> Iterator[pa.RecordBatch]:
    """(item, n): how often items that may have more than `tile` postings are posted."""
    for item, _, _, _, most in posting_rows(batches, least, threshold, sketch):
        items, n = np.unique(item[most > tile], return_counts=True)
        if len(items):
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(n.astype(np.int64))], names=["item", "n"])


POSTING = "item long, ta int, tb int, rec long, n int, place int"


def tile_of(key: str, tiles: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(tiles)).cast("int")


def cells(df: DataFrame, key: str, tiles: str) -> DataFrame:
    """The rows once for each cell (ta, tb) of two tiles that holds their key's tile; null tiles are one cell."""
    own, other = tile_of(key, tiles), F.explode(F.coalesce(F.sequence(F.lit(0), F.col(tiles) - 1), F.array(F.lit(0)))).alias("__u")
    spread = df.select("*", F.coalesce(own, F.lit(0)).alias("__t"), other)
    return spread.withColumn("ta", F.least("__t", "__u").cast("int")).withColumn("tb", F.greatest("__t", "__u").cast("int")).drop("__t", "__u", tiles)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least that many rows that never cut a run of equal (item, ta, tb)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([(x := t.column(k).to_numpy()) == x[-1] for k in range(3)])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        count = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def strips(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, radius): rows of one group whose sizes and places in the prefix admit the threshold, one strip of tiles at a time.

    A strip is all rows of all groups against those s rows further on. Rows come by size, so a row whose s-th follower is
    too large is done. Within cells of two tiles only rows of different tiles are compared.
    """
    need = threshold / (1 + threshold)
    item, ta, tb, rec, n, place = (t.column(k).to_numpy() for k in range(6))
    new = np.ones(len(item), np.bool_)
    new[1:] = (item[1:] != item[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
    group = np.cumsum(new)
    i, s = np.arange(len(item)), 1
    while len(i):
        i = i[i + s < len(item)]
        j = i + s
        on = (group[i] == group[j]) & (n[i] >= threshold * n[j] - 1e-9)
        i = i[on]
        j = i + s
        overlap = np.ceil(need * (n[i].astype(np.int64) + n[j]) - 1e-9).astype(np.int64)
        ok = (n[i] - place[i] >= overlap) & (n[j] - place[j] >= overlap) & (rec[i] != rec[j])
        yield i[ok], j[ok], (n[i].astype(np.int64) + n[j] - 2 * overlap)[ok]
        s += 1


def with_partner(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The postings that have any admissible other under their item. The rows come ordered by item, tiles and size."""
    for t in whole_groups(batches):
        keep = np.zeros(t.num_rows, np.bool_)
        for i, j, _ in strips(t, threshold):
            keep[i] = keep[j] = True
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def tiles_of(pop: np.ndarray, size: np.ndarray, first: int, need: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of one large group, pair of tiles by pair of tiles, as offsets from `first`.

    Tiles are so many rows in the order of population counts. A tile meets those behind it until the least count of one is
    further off than any radius allows: radius <= (1 - 2 need) (|a| + |b|).
    """
    order = np.argsort(pop, kind="stable")
    starts = np.arange(0, len(pop), rows)
    low, high = pop[order[starts]], pop[order[np.minimum(starts + rows, len(pop)) - 1]]
    most = np.maximum.reduceat(size[order], starts)
    for a in range(len(starts)):
        gap = low[a:] - high[a]
        for b in (a + np.flatnonzero(gap <= (1 - 2 * need) * (most[a] + most[a:]) + 1e-9)).tolist():
            x, y = order[starts[a] : starts[a] + rows], order[starts[b] : starts[b] + rows]
            if a == b:
                k, m = np.triu_indices(len(x), 1)
                i, j = x[k], x[m]
            else:
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
            yield i + first, j + first


def admissible(t: pa.Table, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, radius) of the pairs of rows whose sizes, places and tiles admit the threshold; i is the smaller set."""
    need = threshold / (1 + threshold)
    ta, tb, rec, n, place = (t.column(k).to_numpy() for k in range(1, 6))
    swap = n[i] > n[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    overlap = np.ceil(need * (n[i].astype(np.int64) + n[j]) - 1e-9).astype(np.int64)
    ok = (n[i] >= threshold * n[j] - 1e-9) & (n[i] - place[i] >= overlap) & (n[j] - place[j] >= overlap) & (rec[i] != rec[j])
    return i[ok], j[ok], (n[i].astype(np.int64) + n[j] - 2 * overlap)[ok]


def compare_tiles(batches: Iterator[pa.RecordBatch], threshold: float, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius under each item; postings with bitmaps, ordered by item, tiles and size."""
    need = threshold / (1 + threshold)
    for t in whole_groups(batches):
        rec, n = t.column(3).to_numpy(), t.column(4).to_numpy().astype(np.int64)
        bitmaps = [np.frombuffer(b, np.uint8) for b in t.column(6).to_pylist()]
        base = np.stack([fold(b, BASE_BITS) for b in bitmaps]).view(np.uint64)
        pop = np.bitwise_count(base).sum(axis=1, dtype=np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def done() -> pa.RecordBatch:
            """The different pairs held, compared once more in the wider bitmaps of large sets."""
            i, j = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
            swap = rec[i] > rec[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((rec[j], rec[i]))
            i, j = i[order], j[order]
            new = np.ones(len(i), np.bool_)
            new[1:] = (rec[i[1:]] != rec[i[:-1]]) | (rec[j[1:]] != rec[j[:-1]])
            i, j = i[new], j[new]
            near = np.ones(len(i), np.bool_)
            for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
                width = min(len(bitmaps[a]), len(bitmaps[b])) * 8
                if width > BASE_BITS:
                    radius = n[a] + n[b] - 2 * np.ceil(need * (n[a] + n[b]) - 1e-9)
                    near[k] = np.bitwise_count(fold(bitmaps[a], width) ^ fold(bitmaps[b], width)).sum(dtype=np.int64) <= radius
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rec[i[near]]), pa.array(rec[j[near]])], names=["a", "b"])

        for i, j, radius in candidates(t, pop, threshold, rows):
            ok = np.abs(pop[i] - pop[j]) <= radius
            i, j, radius = i[ok], j[ok], radius[ok]
            ok = np.bitwise_count(base[i] ^ base[j]).sum(axis=1, dtype=np.int32) <= radius
            held.append((i[ok], j[ok]))
            count += int(ok.sum())
            if count > 1_000_000:
                yield done()
                count = 0
        yield done()


def candidates(t: pa.Table, pop: np.ndarray, threshold: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Admissible pairs of rows: of groups of one tile all at once, of larger groups by pairs of tiles."""
    item, ta, tb, _, n, _ = (t.column(k).to_numpy() for k in range(6))
    new = np.ones(len(item), np.bool_)
    new[1:] = (item[1:] != item[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(item)))
    small = np.repeat(size <= rows, size)
    if small.all():
        yield from strips(t, threshold)
        return
    where = np.flatnonzero(small)
    for i, j, radius in strips(t.filter(pa.array(small)).combine_chunks(), threshold):
        yield where[i], where[j], radius
    for a, k in zip(first[size > rows].tolist(), size[size > rows].tolist()):
        for i, j in tiles_of(pop[a : a + k], n[a : a + k].astype(np.int64), a, threshold / (1 + threshold), rows):
            yield admissible(t, i, j, threshold)


def keys_of(df: DataFrame, *key: str):
    """A broadcast bitmap of the keys, for held_rows."""
    return bitmap(df.select(F.xxhash64(*key).alias("hash")), "hash")


def held_rows(batches: Iterator[pa.RecordBatch], shared, yes: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose hash, the last column, the bitmap has: all rows of its keys and few others. With yes=False those that it lacks."""
    for batch in batches:
        last = batch.num_columns - 1
        keep = held(shared, batch.column(last).to_numpy().view(np.uint64)) == yes
        yield batch.select(list(range(last))).filter(pa.array(keep))


def bit_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = _texts(batch)
        rows = [(int(k), parity(s, width_of(len(s))).tobytes()) for k, s in zip(keys, item_sets(texts, least)) if s is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))], names=["rec", "bits"])


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(common, all) items of two sets of distinct hashes."""
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return common, len(both) - common


def _similar(out: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])


def verify_bins(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell that reach the threshold. A cell's texts (b null) come before its pairs; only one cell's sets are held."""
    at, sets = None, {}
    for batch in batches:
        out = []
        found = item_sets([t for t in batch.column(5).cast(pa.large_binary()).to_pylist() if t is not None], 1)
        for own, ta, tb, a, b in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if (own, ta, tb) != at:
                at, sets = (own, ta, tb), {}
            if b is None:
                sets[a] = next(found)
            else:
                common, union = similarity(sets[a], sets[b])
                if common >= threshold * union - 1e-9:
                    out.append((a, b, common / union))
        yield _similar(out)


def verified(near: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """The near pairs that are similar, by their whole sets.

    Pairs gather in bins by the least record that their records are near to, so that a record's text travels once or
    little more. Bins of more than BIN records are cut into parts, and their pairs are verified in cells of two parts, so
    that a text travels once for each part of its bin and no task holds more than BIN sets at once. one: (key, text, hash).
    """
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "bins")
    of = lambda c, to: label.select(F.col("a").alias(c), F.col("label").alias(to))
    pairs = materialize(near.join(of("a", "la"), "a").join(of("b", "lb"), "b").select(F.least("la", "lb").alias("bin"), "a", "b"), "binned")
    members = materialize(pairs.select("bin", F.explode(F.array("a", "b")).alias("key")).distinct(), "members")
    big = materialize(members.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > BIN).select("bin", F.ceil(2 * F.col("n") / BIN).cast("int").alias("tiles")), "big")
    placed = cells(members.join(big, "bin", "left"), "key", "tiles").distinct()
    shared = keys_of(label, "a")
    texts = one.mapInArrow(lambda b: held_rows(b, shared), "key long, text string").join(placed, "key")
    split = pairs.join(big, "bin", "left").withColumn("x", F.coalesce(tile_of("a", "tiles"), F.lit(0))).withColumn("y", F.coalesce(tile_of("b", "tiles"), F.lit(0)))
    split = split.select("bin", F.least("x", "y").alias("ta"), F.greatest("x", "y").alias("tb"), "a", "b", F.lit(None).cast("string").alias("text"))
    rows = texts.select("bin", "ta", "tb", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "text").unionByName(split)
    keys = ("bin", "ta", "tb")
    out = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first(), "a").mapInArrow(lambda it: verify_bins(it, threshold), "a long, b long, similarity double")
    out = materialize(out.distinct(), "similar")
    discard(label, pairs, members, big)
    return out


def copies(df: DataFrame, key: str, text: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without copies, one each of equal texts; (rep, key) of every record that has copies, itself included).

    version tells rows of one key apart, so that only one delivery of a record stays. Only digests are shuffled, and beyond
    FEW rows to leave out once the texts of these and of rows that their bitmap can't tell from them.
    """
    df = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    df = df.select(F.col(key).cast("long").alias("key"), (F.xxhash64(version) if version else F.lit(0).cast("long")).alias("version"), F.col(text).alias("text"))
    digest = materialize(df.select("key", "version", F.sha1("text").alias("digest")), "digests")
    group = digest.groupBy("digest").agg(F.min(F.struct("key", "version")).alias("rep"), F.count("*").alias("n")).where("n > 1")
    more = materialize(digest.join(group, "digest").select("rep", "key", "version").distinct(), "copies")
    others = materialize(more.where("key <> rep.key or version <> rep.version").select("key", "version"), "others")
    members = more.select(F.col("rep.key").alias("rep"), "key").distinct()
    if others.count() <= FEW:
        return df.join(F.broadcast(others), ["key", "version"], "left_anti").select("key", "text"), members
    shared = keys_of(others, "key", "version")
    hashed = df.withColumn("hash", F.xxhash64("key", "version"))
    doubtful = hashed.select("key", "version", "text", "hash").mapInArrow(lambda b: held_rows(b, shared), "key long, version long, text string")
    rest = materialize(doubtful.join(others, ["key", "version"], "left_anti").select("key", "text"), "rest")
    release(df.sparkSession)
    return hashed.select("key", "text", "hash").mapInArrow(lambda b: held_rows(b, shared, False), "key long, text string").unionByName(rest), members


def similar_texts(records: DataFrame, key: str, text: str, version: str | None = None, threshold: float = THRESHOLD, least: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of representatives with their similarity; (rep, key) of the copies).

    Null texts and texts of fewer than `least` tokens are in no pair. A row delivered again counts once. Equal texts
    under different keys are copies: they are in `members`, with the least key as their representative.
    """
    one, members = copies(records, key, text, version)
    spark, bits, tile_rows = records.sparkSession, CELL_BITS, ROWS
    parts = one.mapInArrow(lambda b: sketch_part(b, least, bits), "slice int, cells binary, counts binary")
    summed = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(sketch_sum, "slice int, most long, sum long, codes binary")
    # at most 2**(CELL_BITS - SLICE_BITS) slices of 2**(SLICE_BITS - 1) bytes
    summed_rows = summed.collect()
    slices = [(r.slice, r.most, bytes(r.codes)) for r in summed_rows]
    most, loaded = max((m for _, m, _ in slices), default=0), sum(r.sum for r in summed_rows) > LOAD * 2**bits
    sketch = spark.sparkContext.broadcast((slices, bits))
    del parts, summed
    release(spark)
    keys = ("item", "ta", "tb")
    tile = TILE
    posted = one.mapInArrow(lambda b: postings(b, least, threshold, sketch, tile), "item long, rec long, n int, place int, tiles int")
    if most > TILE and loaded:
        # the bounds count other items too: true counts of the items that may be posted for more records than a tile holds
        counted = one.mapInArrow(lambda b: hot_counts(b, least, threshold, sketch, tile), "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
        hot = materialize(counted.where(F.col("n") > TILE).select("item", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "hot")
        posted = cells(posted.drop("tiles").join(hot, "item", "left"), "rec", "tiles")
    elif most > TILE:
        posted = cells(posted, "rec", "tiles")
    else:
        posted = posted.withColumn("ta", F.lit(0)).withColumn("tb", F.lit(0))
    posted = posted.select("item", "ta", "tb", "rec", "n", "place")
    posted = materialize(posted.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(lambda b: with_partner(b, threshold), POSTING), "postings")
    release(spark)
    wanted = materialize(posted.select(F.col("rec").alias("key")).distinct(), "wanted")
    hashed = one.select("key", "text", F.xxhash64("key"))
    shared = keys_of(wanted, "key")
    bits = materialize(hashed.mapInArrow(lambda b: bit_rows(held_rows(b, shared), least), "rec long, bits binary"), "bits")
    release(spark)
    near = posted.join(bits, "rec").select(*posted.columns, "bits").repartition(*keys).sortWithinPartitions(*keys, "n")
    near = materialize(near.mapInArrow(lambda b: compare_tiles(b, threshold, tile_rows), "a long, b long").distinct(), "near")
    discard(posted, wanted, bits)
    release(spark)
    pairs = verified(near, hashed, threshold)
    discard(near)
    return pairs, members


def among(records: DataFrame, key: str, text: str, members: DataFrame) -> DataFrame:
    """(key, text) of the records that have copies, and of few others if more than FEW have; no text is shuffled."""
    rows, keys = records.select(key, text), members.select(F.col("key").alias(key))
    if keys.count() <= FEW:
        return rows.join(F.broadcast(keys), key, "left_semi")
    shared = keys_of(keys, key)
    return rows.where(F.col(key).isNotNull()).withColumn("__hash", F.xxhash64(F.col(key).cast("long"))).mapInArrow(lambda b: held_rows(b, shared), rows.schema)


def long_enough(records: DataFrame, key: str, text: str, least: int = MIN_TOKENS) -> DataFrame:
    """Keys of the texts with at least that many tokens, by whole texts."""
    tokens = F.regexp_count(F.col(text), F.lit("[A-Za-z0-9_]+"))
    return records.where(tokens >= least).select(F.col(key).alias("key"))


def expand(pairs: DataFrame, members: DataFrame, eligible_copies: DataFrame) -> DataFrame:
    """All pairs of records from the pairs of representatives and the copies: (key_a, key_b), key_a < key_b, distinct."""
    own = members.select(F.col("rep").alias("r"), F.col("key").alias("k"))
    side = lambda df, col, other, to: salted_join(df, own.withColumnRenamed("r", col).withColumnRenamed("k", to), [col], F.col(other)).unionByName(df.join(own.select(F.col("r").alias(col)), col, "left_anti").withColumn(to, F.col(col)))
    across = side(side(pairs.select("a", "b"), "a", "b", "ka"), "b", "ka", "kb")
    ok = own.join(eligible_copies.select(F.col("key").alias("k")), "k", "left_semi")
    within = salted_join(ok.select("r", F.col("k").alias("ka")), ok.select("r", F.col("k").alias("kb")), ["r"], F.col("ka")).where("ka < kb")
    both = across.select("ka", "kb").unionByName(within.select("ka", "kb"))
    return both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the pairs (a, b). Labels spread and jump until none changes."""
    spark = pairs.sparkSession
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = materialize(spread.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), "labels")
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        release(spark)
        if not changed:
            return labels


def groups(pairs: DataFrame, members: DataFrame, eligible_copies: DataFrame) -> DataFrame:
    """(key, group_id, n_links): every record that is similar or equal to another, its group, and how many records it is similar to.

    group_id is the least key of the group. Copies are counted, not expanded into pairs.
    """
    own = members.join(eligible_copies, "key", "left_semi")
    size = own.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(size.withColumnRenamed("rep", "b"), "b", "left").groupBy("a").agg(F.sum(F.coalesce("n", F.lit(1))).alias("links"))
    roots = components(pairs)
    reps = roots.select(F.col("node").alias("rep"), "root").join(links.withColumnRenamed("a", "rep"), "rep", "full").join(size, "rep", "full")
    reps = reps.select("rep", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"))
    return reps.join(own, "rep", "left").select(F.coalesce("key", "rep").alias("key"), F.col("root").alias("group_id"), F.col("n_links").cast("long").alias("n_links"))
