"""Joins on keys of which some have very many rows, and bitmaps of keys of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Rows of one key on the many side from which it is split over SALTS tasks.
HOT = 20_000
SALTS = 32
#: A bitmap has 2**CELL_BITS bits, however many keys it holds: this bounds what is broadcast (16 MB).
CELL_BITS = 27
SLICE_BITS = 16
#: A sketch has 2**LEVEL_BITS cells of a byte (16 MB).
LEVEL_BITS = 24


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: Column, counts: DataFrame | None = None, hot_from: int | None = None) -> DataFrame:
    """The inner join of two tables on non-null columns; keys with at least hot_from rows in `many` are split.

    Rows of a hot key in `many` go to one of SALTS tasks by the hash of `spread`, and its rows in `few` to all of them. counts:
    (the columns, n), where the caller has them; else they are counted, combined before the shuffle.
    """
    counts = many.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = materialize(counts.where(F.col("n") >= (HOT if hot_from is None else hot_from)).select(*on, F.lit(True).alias("__hot")), "hot")
    if hot.isEmpty():
        return many.join(few, on)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.sequence(F.lit(0), F.when(F.col("__hot"), SALTS - 1).otherwise(0))
    left = many.join(hot, on, "left").withColumn("__salt", salt).drop("__hot")
    right = few.join(hot, on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [*on, "__salt"]).drop("__salt")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, bits) of distinct (slice, cell) rows that come ordered by slice."""
    at, bits = -1, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        s, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(s, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(s)]):
            if s[i] != at:
                if bits is not None:
                    yield done()
                at, bits = int(s[i]), np.zeros(1 << SLICE_BITS, np.uint8)
            bits[cell[i:j]] = 1
    if bits is not None:
        yield done()


def bitmap(keys: DataFrame, key: str):
    """A broadcast bitmap of 64-bit hashes; `held` asks it. A key that it lacks is in no row; one that it has may be in none."""
    cell = F.shiftrightunsigned(key, 64 - CELL_BITS)
    cells = keys.select(F.shiftright(cell, SLICE_BITS).cast("int").alias("slice"), cell.bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int").alias("cell")).distinct()
    # at most 2**(CELL_BITS - SLICE_BITS) rows of 2**(SLICE_BITS - 3) bytes
    rows = cells.repartition("slice").sortWithinPartitions("slice").mapInArrow(_slices, "slice int, bits binary").collect()
    return keys.sparkSession.sparkContext.broadcast([(r.slice, bytes(r.bits)) for r in rows])


def held(shared, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) a broadcast bitmap has. It is unpacked once in each Python worker."""
    dense = getattr(shared, "dense", None)
    if dense is None:
        dense = np.zeros(1 << CELL_BITS - 3, np.uint8)
        part = 1 << SLICE_BITS - 3
        for s, bits in shared.value:
            dense[s * part : (s + 1) * part] = np.frombuffer(zlib.decompress(bits), np.uint8)
        shared.dense = dense
    cell = (keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return (dense[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(np.bool_)


def _level_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, bits) of (slice, cell, level) rows that come ordered by slice: the levels of a slice's cells, compressed."""
    at, cells = -1, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        s, cell, lev = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero(np.diff(s, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(s)]):
            if s[i] != at:
                if cells is not None:
                    yield done()
                at, cells = int(s[i]), np.zeros(1 << SLICE_BITS, np.uint8)
            cells[cell[i:j]] = lev[i:j]
    if cells is not None:
        yield done()


def sketch(rows: DataFrame, key: str):
    """A broadcast sketch of how many rows 64-bit hashes have; `level` asks it. It orders hashes, rare ones first, and need not be exact for that."""
    cell = F.shiftrightunsigned(key, 64 - LEVEL_BITS)
    counts = rows.groupBy(cell.alias("c")).agg(F.least(F.ceil(F.log2(F.count("*").cast("double")) * 4) + 1, F.lit(255)).cast("int").alias("level"))
    placed = counts.select(F.shiftright("c", SLICE_BITS).cast("int").alias("slice"), F.col("c").bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int").alias("cell"), "level")
    # at most 2**(LEVEL_BITS - SLICE_BITS) rows of 2**SLICE_BITS bytes
    found = placed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_level_slices, "slice int, bits binary").collect()
    return rows.sparkSession.sparkContext.broadcast([(r.slice, bytes(r.bits)) for r in found])


def level(shared, keys: np.ndarray) -> np.ndarray:
    """The levels of hashes (uint64) in a broadcast sketch, 0 for those it lacks. It is unpacked once in each Python worker."""
    dense = getattr(shared, "dense", None)
    if dense is None:
        dense = np.zeros(1 << LEVEL_BITS, np.uint8)
        part = 1 << SLICE_BITS
        for s, cells in shared.value:
            dense[s * part : (s + 1) * part] = np.frombuffer(zlib.decompress(cells), np.uint8)
        shared.dense = dense
    return dense[(keys >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]


def rows_of(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the keys (key), each once there or more often. A bitmap drops nearly all others before anything is shuffled."""
    wanted, names = bitmap(keys.select(F.xxhash64(key).alias("h")), "h"), rows.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.filter(pa.array(held(wanted, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], names=names)

    return rows.withColumn("__h", F.xxhash64(key)).mapInArrow(kept, rows.schema).join(keys.select(key).distinct(), key, "left_semi")
