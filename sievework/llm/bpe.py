"""Encoding of texts with a public byte-level BPE tokenizer.

A text is cut into words by the tokenizer's pattern. The different words of a batch lie in one flat array of symbols. In each
merge round the ranks of all adjacent pairs are found by binary search over the sorted pair keys, and in every word the
pairs of the word's lowest rank are merged; words without a mergeable pair are done. The ids do not depend on the batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the word pattern of this tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words that a worker keeps encoded; beyond it all are dropped and it begins anew. Memory only: the ids are the same.
KEPT = 200_000
_NONE = np.iinfo(np.int64).max


class Encoder:
    """Ids of byte strings by merge ranks, the content of a .tiktoken file (one `base64 rank` per line)."""

    def __init__(self, content: bytes):
        ranks = {}
        for line in content.splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, list[int]] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, which is also the id, of each pair; _NONE if it doesn't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, none empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE, np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(word)))
            finished = np.repeat(least == _NONE, span)
            if finished.any():
                done.append((word[finished], symbols[finished]))
            merge = (rank == np.repeat(least, span)) & ~finished
            # of overlapping equal pairs (aaa) the left one merges, then every second
            at = np.flatnonzero(merge)
            if len(at):
                run = np.cumsum(np.diff(at, prepend=-2) != 1)
                start = np.flatnonzero(np.diff(run, prepend=0))
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = rank[at]
            keep = ~finished
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        w = np.concatenate([d[0] for d in done])
        s = np.concatenate([d[1] for d in done])
        order = np.argsort(w, kind="stable")
        return np.split(s[order], np.cumsum(np.bincount(w, minlength=len(words)))[:-1])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.kept})
        fresh: dict[str, list[int]] = {}
        for k in range(0, len(new), 100_000):
            part = new[k : k + 100_000]
            fresh.update(zip(part, (x.tolist() for x in self.encode_words([w.encode("utf-8") for w in part]))))
        kept = self.kept
        out = [[i for w in words for i in (kept.get(w) or fresh[w])] for words in cut]
        kept.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        if len(kept) > KEPT:
            self.kept = {}
        return out


def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


@lru_cache(4)
def encoder_of(content: bytes) -> Encoder:
    """The encoder of a vocabulary, made once in each process and kept for later jobs."""
    return Encoder(content)


def id_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    e = encoder_of(shared.value)
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            ids = e.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of each text, whole, without special tokens; their strings are ordinary text.

    Empty and null texts have an empty list. One row per row of documents, no shuffle. The vocabulary is read by the driver and
    sent along, so executors need no file.
    """
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, about a megabyte
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: id_rows(b, shared), "doc_id long, ids array<int>")
