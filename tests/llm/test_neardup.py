import datetime as dt
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import neardup
from sievework.functions.items import item_sets, tokens


def items(text):
    t = re.findall("[A-Za-z0-9_]+", text or "")
    return set(t) | set(zip(t, t[1:])), len(t)


def brute(data, threshold, least):
    known = {k: items(t) for k, t, _ in data if t is not None}
    known = {k: s for k, (s, n) in known.items() if n >= least}
    return {(a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= threshold * len(known[a] | known[b]) - 1e-9}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 6)):
            t.insert(rng.randint(0, len(t)), rng.choice(words))
        texts.append(" ".join(t))
    texts += texts[:8] + ["", "a", None, "é ü " * 30, "x " * 200]
    t0 = dt.datetime(2024, 1, 1)
    data = [(k, t, t0) for k, t in enumerate(texts)]
    return data + [(k, t, t0 + dt.timedelta(days=1)) for k, t, _ in data[:5]] + data[10:12]


@pytest.mark.parametrize("threshold, least, tile, bits", [(0.6, 10, 2048, 27), (0.6, 10, 2, 17), (0.8, 3, 3, 16), (0.3, 5, 5, 16)])
def test_pairs_and_groups(rows, monkeypatch, threshold, least, tile, bits):
    """Small tiles, bins and sketches change how the work is cut, never the pairs."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "ROWS", tile)
    monkeypatch.setattr(neardup, "CELL_BITS", bits)
    monkeypatch.setattr(neardup, "LOAD", 0.0 if bits == 17 else 1.0)
    monkeypatch.setattr(neardup, "BIN", 5000 if tile == 3 else tile)
    data = corpus(tile)
    df = rows(data, "block_key long, content string, ingested_at timestamp")
    pairs, members = neardup.similar_texts(df, "block_key", "content", "ingested_at", threshold, least)
    eligible = neardup.long_enough(df, "block_key", "content", least).distinct()
    want = brute(data, threshold, least)
    assert {tuple(r) for r in neardup.expand(pairs, members, eligible).collect()} == want
    got = {r.key: (r.group_id, r.n_links) for r in neardup.groups(pairs, members, eligible).collect() if r.n_links}
    root = {k: k for p in want for k in p}
    for _ in range(len(root)):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: (r, sum(k in p for p in want)) for k, r in root.items()}


def test_tiles_far_apart_are_skipped():
    rng = np.random.default_rng(2)
    pop, size = rng.integers(0, 400, 500).astype(np.int32), rng.integers(50, 90, 500)
    seen = {tuple(sorted(p)) for i, j in neardup.tiles_of(pop, size, 0, 0.375, 16) for p in zip(i.tolist(), j.tolist())}
    need = {(a, b) for a in range(500) for b in range(a + 1, 500) if abs(int(pop[a]) - int(pop[b])) <= 0.25 * (size[a] + size[b])}
    assert need <= seen and len(seen) < 500 * 499 // 2 * 0.6


def test_postings_stay_bounded_when_the_sketch_is_full():
    """A full sketch posts at most the prefix of each record, in one cell unless the item's true count asks for more."""
    texts = [" ".join(f"w{(k * 7 + j * j) % 5000}" for j in range(60)).encode() for k in range(200)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([t.decode() for t in texts])], names=["key", "text"])
    parts = list(neardup.sketch_part([batch], 1, 16))
    slices = [(r["slice"], r["most"], r["codes"]) for b in neardup.sketch_sum(parts) for r in b.to_pylist()]

    class Shared:
        value = (slices, 16)

    posted = sum(b.num_rows for b in neardup.postings([batch], 1, 0.6, Shared()))
    assert posted <= sum(len(s) - int(np.ceil(0.6 * len(s))) + 1 for s in item_sets(texts, 1))


def test_empty_and_single(rows):
    df = rows([], "block_key long, content string, ingested_at timestamp")
    pairs, members = neardup.similar_texts(df, "block_key", "content", "ingested_at")
    assert not pairs.count() and not members.count()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab_ 1\n-é中", max_size=40), max_size=8))
def test_items(texts):
    raw = [t.encode() for t in texts]
    got = [0 if s is None else len(s) for s in item_sets(raw, 1)]
    assert got == [len(items(t)[0]) for t in texts]
    if raw:
        assert np.diff(tokens(raw)[1]).tolist() == [items(t)[1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_bitmaps_never_differ_more_than_the_sets(a, b):
    x, y = (neardup.parity(np.array(sorted(s), np.uint64), 1024) for s in (a | {1, 2}, b | {1, 2}))
    assert np.bitwise_count(x ^ y).sum() <= len((a | {1, 2}) ^ (b | {1, 2}))
    assert (neardup.fold(x, 512) == neardup.parity(np.array(sorted(a | {1, 2}), np.uint64), 512)).all()


def test_sketch_codes():
    counts = np.zeros(1 << neardup.SLICE_BITS, np.int64)
    counts[:6] = (0, 1, 7, 8, 31, 5000)
    import zlib

    s = neardup.Sketch([(0, 5000, zlib.compress(neardup.encode_counts(counts).tobytes()))])
    cells = np.arange(6).astype(np.uint64) << np.uint64(64 - neardup.CELL_BITS)
    code = s.code(cells)
    assert code.tolist() == [0, 1, 7, 8, 9, 15]
    assert (s.at_most(cells, code) >= counts[:6]).all()


def moved(spark):
    """Bytes that all shuffles of the session have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("few", [0, 100_000])
def test_texts_stay_where_they_are(rows, spark, monkeypatch, few):
    """Where no table of keys is small enough for Spark to broadcast, only texts in near pairs and of copies are shuffled; the pairs are the same."""
    monkeypatch.setattr(neardup, "FEW", few, raising=False)
    rng = random.Random(7)
    word = lambda size: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size))
    texts = [" ".join(word(500) for _ in range(50)) for _ in range(160)]
    texts += [t + " end" for t in texts[:2]] + texts[2:4]
    t0 = dt.datetime(2024, 1, 1)
    df = rows([(k, t, t0) for k, t in enumerate(texts)], "block_key long, content string, ingested_at timestamp").repartition(8).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = moved(spark)
        pairs, members = neardup.similar_texts(df, "block_key", "content", "ingested_at")
        eligible = neardup.long_enough(neardup.among(df, "block_key", "content", members), "block_key", "content")
        assert {tuple(r) for r in neardup.expand(pairs, members, eligible).collect()} == {(0, 160), (1, 161), (2, 162), (3, 163)}
        assert moved(spark) - start < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("threshold, least, tile, bits", [(0.6, 10, 2048, 27), (0.3, 5, 5, 16)])
def test_pairs_and_groups_by_bitmaps(rows, monkeypatch, threshold, least, tile, bits):
    """Bitmaps of keys in place of broadcast tables change no pair."""
    monkeypatch.setattr(neardup, "FEW", 0, raising=False)
    test_pairs_and_groups(rows, monkeypatch, threshold, least, tile, bits)
