"""Long exact spans shared between records: seed and extend on winnowed anchors.

1. Every text is winnowed: of each run of least-ANCHOR+1 consecutive ANCHOR-character hashes the least one is an anchor (the
   rightmost of equal ones), so two texts that share a span of `least` characters share an anchor inside it, at the same place in the span.
2. Anchors that only one record has are dropped; the count is pre-aggregated before the shuffle.
3. Equal texts collapse to one record first. Around each shared anchor, every window of `least` characters that holds the
   anchor is hashed. Windows that occur in two records under an anchor are the extension of the match both ways, as far as `least` characters reach; windows of
   neighbouring anchors and starts join to the maximal span. Each window names one partner, the least other record of its
   class of equal windows, and spans with one partner are kept at their whole length. No other pair of records is formed, so a
   stretch that a third of all records share costs what its occurrences cost.
4. The windows are compared on 64-bit hashes of their characters together with the anchor's own 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, release
from ..functions.items import mix, powers
from .neardup import copies

LEAST = 200
ANCHOR = 64
_PIECE = 1 << 20


def gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of that many characters."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    p, q = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=total[1:])
        return mix((total[length:] - total[:-length]) * q[: len(total) - length])


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places of the least hash of each run of that many, ascending; the rightmost of equal ones."""
    n = len(hashes)
    if n < run:
        return np.zeros(0, np.int64)
    least = hashes
    width = 1
    while 2 * width <= run:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < run:
        least = np.minimum(least[: n - run + 1], least[run - width :][: n - run + 1])
    # A place is chosen if it is the rightmost least one of some run: that is so if its run's minimum equals it and the next equal one is too far.
    at = np.flatnonzero(np.diff(least, prepend=~least[0]) != 0)
    value, ends = least[at], np.concatenate((at[1:], [len(least)])) - 1
    chosen = []
    for v, a, b in zip(value, at, ends):
        place = np.flatnonzero(hashes[a : b + run] == v) + a
        if len(place) == 1:
            chosen.append(place)
        else:
            starts = np.arange(a, b + 1)
            chosen.append(np.unique(place[np.searchsorted(place, starts + run - 1, side="right") - 1]))
    return np.unique(np.concatenate(chosen))


def codes_of(text: str) -> np.ndarray:
    """The code points of a text; one byte each where that suffices."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(text: str, least: int = LEAST, length: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text. Very long texts are winnowed in overlapping pieces; the anchors are the same."""
    codes = codes_of(text)
    run = least - length + 1
    places, found = [], []
    for begin in range(0, max(1, len(codes) - least + 1), _PIECE):
        h = gram_hashes(codes[begin : begin + _PIECE + least - 1], length)
        at = winnow(h, run)
        places.append(at + begin)
        found.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(found)[first]


def contexts(text: str, places: np.ndarray, least: int = LEAST, length: int = ANCHOR) -> list[tuple[int, str]]:
    """For each anchor: the first start of a window of `least` characters that holds it, and the text of all such windows together."""
    spans = ((max(0, p + length - least), min(p, len(text) - least) + least) for p in places.tolist())
    return [(a, text[a:b]) for a, b in spans]


def union_length(intervals: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(intervals):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _rows(batch: pa.RecordBatch):
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def anchor_rows(batches: Iterator[pa.RecordBatch], least: int, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recs, hashes = [], []
        for rec, text in _rows(batch):
            if text is not None and len(text) >= least:
                h = np.unique(anchors(text, least, length)[1])
                recs.append(np.full(len(h), rec, np.int64))
                hashes.append(h.view(np.int64))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([cat(hashes), cat(recs)], names=["anchor", "rec"])


def window_rows(batches: Iterator[pa.RecordBatch], least: int, length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, rec, start of the first window, text of the windows) for rows of (rec, text, shared anchors)."""
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for rec, text, shared in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at, h = anchors(text, least, length)
            mine = np.isin(h.view(np.int64), np.array(shared, np.int64))
            for value, (start, around) in zip(h[mine].view(np.int64).tolist(), contexts(text, at[mine], least, length)):
                for col, x in zip(cols, (value, rec, start, around)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["anchor", "rec", "start", "context"])


def shared_starts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(rec, begin, end, partner) of the runs of windows that another record has too. Rows come with all of an anchor's occurrences, ordered by anchor."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        anchor, rec, start = (t.column(k).to_numpy() for k in range(3))
        hashes = [gram_hashes(codes_of(x), least) for x in t.column(3).to_pylist()]
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        row = np.repeat(np.arange(len(hashes)), size)
        with np.errstate(over="ignore"):
            h = np.concatenate(hashes) ^ mix(anchor.view(np.uint64))[row]
        at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) + start[row]
        order = np.argsort(h, kind="stable")
        group = np.cumsum(np.diff(h[order], prepend=h[order[:1]]) != 0)
        r = rec[row[order]]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        low, high = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
        other = np.empty(len(h), np.int64)
        other[order] = np.where(r == low[group], high[group], low[group])
        ok = order[(low != high)[group]]
        ok.sort()
        rows, at, other = row[ok], at[ok], other[ok]
        new = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1) | (np.diff(other, prepend=-1) != 0))
        last = np.concatenate((new[1:], [len(ok)])) - 1
        if not len(ok):
            new = last = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rec[rows[new]], pa.int64()), pa.array(at[new], pa.int64()), pa.array(at[last] + least, pa.int64()), pa.array(other[new], pa.int64())], names=["rec", "begin", "end", "partner"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < 20_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        a = t.column(0).to_numpy()
        cut = int(np.searchsorted(a, a[-1]))
        if cut:
            yield compare(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        count = t.num_rows - cut
    if held:
        yield compare(pa.Table.from_batches(held).combine_chunks())


#: Records of one anchor from which its windows are compared one by one over all tasks instead of in one.
HOT = 20_000


def single_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per window of each distinct context of an anchor with very many occurrences."""
    for batch in batches:
        anchor, low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        hashes = [gram_hashes(codes_of(x), least).view(np.int64) for x in batch.column(1).to_pylist()]
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        row = np.repeat(np.arange(len(hashes)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        digest = batch.column(4).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor[row], digest[row], low[row], high[row], at, flat)], names=["anchor", "digest", "low", "high", "at", "hash"])


def hot_starts(found: DataFrame, least: int) -> DataFrame:
    """shared_starts for anchors of very many records: equal contexts collapse before the shuffle, then windows meet by hash."""
    found = found.withColumn("digest", F.xxhash64("context"))
    distinct = found.groupBy("anchor", "context").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).withColumn("digest", F.xxhash64("context"))
    single = distinct.mapInArrow(lambda b: single_windows(b, least), "anchor long, digest long, low long, high long, at long, hash long")
    twice = single.groupBy("anchor", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("anchor", "hash", F.col("low").alias("least"), F.col("high").alias("most"))
    ok = single.select("anchor", "digest", "at", "hash").join(twice, ["anchor", "hash"]).groupBy("anchor", "digest").agg(F.collect_set(F.struct("at", "least", "most")).alias("x"))
    starts = found.join(ok, ["anchor", "digest"]).select("rec", "start", F.explode("x").alias("x")).select("rec", (F.col("start") + F.col("x.at")).alias("begin"), "x.least", "x.most")
    return starts.select("rec", "begin", (F.col("begin") + least).alias("end"), F.when(F.col("rec") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("partner"))


def joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec, partner, begin, end): windows of a record and a partner that overlap are one span."""
    for batch in batches:
        rows = [(rec, partner, a, b) for rec, partner, x in zip(*(c.to_pylist() for c in batch.columns)) for a, b in joined([(s["begin"], s["end"]) for s in x])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["rec", "partner", "begin", "end"])


def coverage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recs, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        total = [union_length([(s["begin"], s["end"]) for s in x]) for x in spans]
        yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array(total, pa.int64())], names=["rec", "shared_chars"])


def shared_spans(records: DataFrame, least: int = LEAST, length: int = ANCHOR, hot_from: int = HOT) -> DataFrame:
    """(rec, begin, end, partner): stretches of records' texts, of `least` characters or more, that other records hold too.

    records: (key bigint, text string), texts all different. Stretches of a record may overlap; their union is what it
    shares. Null texts and texts under `least` characters share nothing.
    """
    spark = records.sparkSession
    records = records.select(F.col("key").alias("rec"), "text").where(F.length("text") >= least)
    seen = materialize(records.mapInArrow(lambda b: anchor_rows(b, least, length), "anchor long, rec long"), "seen")
    stats = seen.groupBy("anchor").agg(F.min("rec").alias("low"), F.max("rec").alias("high"), F.count("*").alias("n")).where("low <> high")
    shared = materialize(stats.select("anchor", "n"), "anchors")
    release(spark)
    own = materialize(seen.join(shared, "anchor").groupBy("rec").agg(F.collect_set("anchor").alias("shared")), "own")
    release(spark)
    few = materialize(own.select("rec"), "sharing")  # small enough to broadcast at first, so that only these texts are shuffled
    found = records.join(few, "rec", "left_semi").join(own, "rec").select("rec", "text", "shared").mapInArrow(lambda b: window_rows(b, least, length), "anchor long, rec long, start int, context string")
    hot = materialize(shared.where(F.col("n") >= hot_from).select("anchor"), "hot")
    rest = found.join(hot, "anchor", "left_anti") if (any_hot := not hot.isEmpty()) else found
    common = rest.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: shared_starts(b, least), "rec long, begin long, end long, partner long")
    return common.unionByName(hot_starts(found.join(hot, "anchor", "left_semi"), least)) if any_hot else common


def shared_lengths(records: DataFrame, key: str, text: str, version: str | None = None, least: int = LEAST, length: int = ANCHOR, hot_from: int = HOT) -> DataFrame:
    """(rec, shared_chars): how many characters of each record lie in spans of `least` or more that another record holds too.

    Records that share nothing are left out. Copies of one text share all of it. A row delivered again counts once.
    """
    one, members = copies(records, key, text, version)
    spans = materialize(shared_spans(one, least, length, hot_from).distinct(), "spans")
    lengths = spans.groupBy("rec").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).mapInArrow(coverage, "rec long, shared_chars long")
    again = members.where("key <> rep").select("rep").distinct()
    whole = records.join(again.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("rec"), F.length(text).cast("long").alias("shared_chars")).where(F.col("shared_chars") >= least)
    lengths = lengths.unionByName(whole).groupBy("rec").agg(F.max("shared_chars").alias("shared_chars"))
    own = members.select(F.col("rep").alias("rec"), "key")
    return lengths.join(own, "rec", "left").select(F.coalesce("key", "rec").alias("rec"), "shared_chars")


def maximal_spans(records: DataFrame, key: str, text: str, version: str | None = None, least: int = LEAST, length: int = ANCHOR, hot_from: int = HOT) -> DataFrame:
    """(rec, begin, end, partner): the maximal spans of each text that others hold too, by character offsets, each with one partner.

    Of equal texts the record with the least key stands for all and is named as the partner; a text that has copies shares
    the whole of itself with the next of them. A span is given once for each partner that its windows name.
    """
    one, members = copies(records, key, text, version)
    found = shared_spans(one, least, length, hot_from).groupBy("rec", "partner").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    apart = found.mapInArrow(maximal, "rec long, partner long, begin long, end long")
    again = members.where("key <> rep").groupBy("rep").agg(F.min("key").alias("partner"))
    whole = records.select(F.col(key).alias("rep"), F.length(text).cast("long").alias("end")).where(F.col("end") >= least).join(again, "rep").select(F.col("rep").alias("rec"), "partner", F.lit(0).cast("long").alias("begin"), "end").distinct()
    return apart.unionByName(whole).select("rec", "begin", "end", "partner")
