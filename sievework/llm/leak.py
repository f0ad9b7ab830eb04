"""Held-out passages that leak into a corpus: documents that hold at least so many consecutive words of an item.

A prefix-filtered set join. A document and a window of `least` words of an item are sets of shingles, runs of SHINGLE words. A
document holds the window only if it holds all of its shingles, so the necessary prefix of a window, its shingles ordered by
their number in the whole corpus, is the rarest one alone.

1. Documents are posted under the shingles that some item has too; a bitmap of fixed size tells which these may be.
2. The postings of each shingle are counted. A window with a shingle that no document has is dropped; of each other window the
   rarest shingle goes into the items' index.
3. Postings and index are joined. What is left of document and item on both sides of the shingle bounds the run it may lie in.
   Shingles of very many documents are split over several tasks.
4. Of each candidate document the item-sized window at the place where the item would lie is cut out, and compared word by word.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import chunks, mix, powers
from ..operators.skew import bitmap, held, salted_join
from ..sources.tables import materialize, release

LEAST = 12
SHINGLE = 5

_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIVATE = 0x100000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and underscores, case folded."""
    return [w.casefold() for w in _WORD.findall(text)] if text else []


@cache
def _folding() -> tuple[np.ndarray, re.Pattern, dict[int, str]]:
    """By code point the folded one, 0 for what is in no word; the characters that fold to several, and what these become.

    That is what they fold to, or one character of a private plane where it is no word any more. Made once in each process.
    """
    fold, long = np.zeros(sys.maxunicode + 1, np.uint32), {}
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalnum() or s == "_":
            f = s.casefold()
            fold[c] = ord(f) if len(f) == 1 else c
            if len(f) > 1:
                long[c] = f
    own = np.arange(_PRIVATE, _PRIVATE + len(long))
    fold[own] = own
    several = {c: f if _WORD.fullmatch(f) else chr(_PRIVATE + k) for k, (c, f) in enumerate(long.items())}
    return fold, re.compile("[" + "".join(map(chr, long)) + "]"), several


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes of the words of a run of texts, offsets of its texts in them)."""
    fold, long, several = _folding()
    plain = [t.translate(several) if not t.isascii() and long.search(t) else t for t in (t or "" for t in texts)]
    for a, b in chunks(plain):
        codes = fold[np.frombuffer(("\n".join(plain[a:b]) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
        edge = np.diff((codes != 0).view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p, q = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * p[: len(codes)], out=total[1:])
            h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * _MULT)
        lengths = np.fromiter((len(t) + 1 for t in plain[a:b]), np.int64, b - a)
        yield a, h, np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))


def shingle_rows(texts: list[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingle, index of its text, place of its first word, words of its text) of runs of texts."""
    for first, h, at in word_hashes(texts):
        if len(h) < size:
            continue
        with np.errstate(over="ignore"):
            s = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k]
            s = mix(s)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(s)]
        place, n = np.arange(len(s)) - at[text], np.diff(at)[text]
        ok = place + size <= n
        yield s[ok], text[ok] + first, place[ok], n[ok]


POSTING = "shingle long, key long, place int, n int"


def _posting(shingle, key, place, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(key, pa.int64()), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], names=["shingle", "key", "place", "n"])


def posting_rows(batches: Iterator[pa.RecordBatch], size: int, filter=None) -> Iterator[pa.RecordBatch]:
    """The shingles of (key, text) rows; with a filter only those that its bitmap has."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for s, text, place, n in shingle_rows(batch.column(1).to_pylist(), size):
            if filter is not None:
                ok = held(filter, s)
                s, text, place, n = s[ok], text[ok], place[ok], n[ok]
            if len(s):
                yield _posting(s, keys[text], place, n)


def rarest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, place) of the rarest shingle of each window of `width` shingles that all occur; rows of (key, [(place, count)])."""
    for batch in batches:
        keys, places = [], []
        for key, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = np.fromiter((x["place"] for x in known), np.int64, len(known))
            count = np.fromiter((x["n"] for x in known), np.int64, len(known))
            order = np.argsort(at)
            at, count = at[order], count[order]
            if len(at) < width:
                continue
            whole = np.flatnonzero(at[width - 1 :] - at[: len(at) - width + 1] == width - 1)
            if len(whole):
                least = np.lib.stride_tricks.sliding_window_view(count, width)[whole].argmin(axis=1)
                chosen = np.unique(at[whole + least])
                keys.append(np.full(len(chosen), key, np.int64))
                places.append(chosen.astype(np.int32))
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        yield pa.RecordBatch.from_arrays([cat(keys, pa.int64()), cat(places, pa.int32())], names=["key", "place"])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, item, shift, words) for rows of (doc_id, text, [(item, shift, words of the item)]): the item-sized windows of a document."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    for batch in batches:
        out: list[tuple] = []
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            out += [(doc, x["item"], x["shift"], words[max(0, x["shift"]) : max(0, x["shift"] + x["n_item"])]) for x in places]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "item", "shift", "words"])


def longest_run(window: list[str], item: list[str], shift: int, least: int) -> int:
    """The most consecutive words that a window and an item share at one shift; 0 for fewer than `least`."""
    own = item[max(0, -shift) :]
    best = run = 0
    for a, b in zip(window, own):
        run = run + 1 if a == b else 0
        best = max(best, run)
    return best if best >= least else 0


def run_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
    for batch in batches:
        out = []
        for doc, item_id, shift, window, text in zip(*(c.to_pylist() for c in batch.columns)):
            item = words_of(text)
            if run := longest_run(window, item, shift, least):
                out.append((doc, item_id, run, len(item)))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "run_words", "item_words"])


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, run_words, item_words): documents with `least` or more consecutive words of an item, and the most of them.

    Null and empty texts and items under `least` words leak nothing; equal rows count once, and rows with a null id are left out.
    """
    spark = documents.sparkSession
    size = min(SHINGLE, least)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * least - 1))
    given = items.where(F.col("item_id").isNotNull() & (F.length("text") >= 2 * least - 1)).select("item_id", "text").distinct()
    given = materialize(given.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), "items")
    own = materialize(given.select("item", "text").mapInArrow(lambda b: posting_rows(b, size), POSTING), "shingles").withColumnRenamed("key", "item").withColumnRenamed("n", "n_item")
    filter = bitmap(own, "shingle")
    posted = docs.mapInArrow(lambda b: posting_rows(b, size, filter), POSTING).toDF("shingle", "doc_id", "place_doc", "n_doc")
    posted = materialize(posted, "postings")
    known = own.select("shingle").distinct()
    counts = materialize(posted.groupBy("shingle").agg(F.count("*").alias("n")).join(known, "shingle", "left_semi"), "counts")
    release(spark)
    listed = own.join(counts, "shingle").groupBy("item").agg(F.collect_list(F.struct("place", "n")).alias("known"))
    chosen = listed.mapInArrow(lambda b: rarest(b, least - size + 1), "item long, place int")
    index = own.join(chosen, ["item", "place"])
    met = salted_join(posted, index, ["shingle"], F.struct("doc_id", "place_doc"), counts)
    room = F.least("place_doc", "place") + F.least(F.col("n_doc") - F.col("place_doc"), F.col("n_item") - F.col("place"))
    near = met.where(room >= least).select("doc_id", "item", (F.col("place_doc") - F.col("place")).cast("long").alias("shift"), "n_item").distinct()
    near = materialize(near.groupBy("doc_id").agg(F.collect_list(F.struct("item", "shift", "n_item")).alias("places")), "candidates")
    release(spark)
    windows = docs.join(near, "doc_id").select("doc_id", "text", "places").mapInArrow(window_rows, "doc_id long, item long, shift long, words array<string>")
    pairs = windows.join(given, "item").select("doc_id", "item_id", "shift", "words", "text")
    runs = pairs.mapInArrow(lambda b: run_rows(b, least), "doc_id long, item_id string, run_words int, item_words int")
    return runs.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))
