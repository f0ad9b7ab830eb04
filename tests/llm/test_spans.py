import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import spans


def brute(data, least):
    where = {}
    known = {k: t for k, t in data if t is not None}
    for k, t in known.items():
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in known.items():
        covered = set()
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                covered.update(range(i, i + least))
        if covered:
            out[k] = len(covered)
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_shared_lengths(rows, hot):
    rng = random.Random(hot)
    alphabet = "abcdefgh \n\té中"
    stock = ["".join(rng.choices(alphabet, k=rng.randint(20, 90))) for _ in range(12)]
    head = "license " * 6
    data = []
    for k in range(60):
        parts = [head] * (k % 2) + [rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=30)) for _ in range(rng.randint(0, 6))]
        data.append((k, "".join(parts)))
    data += [(100, data[3][1]), (101, None), (102, ""), (103, "ab" * 200), (104, "ab" * 150)]
    df = rows(data + data[:4], "id long, body string")
    got = {r.rec: r.shared_chars for r in spans.shared_lengths(df, "id", "body", None, 40, 16, hot).collect()}
    assert got == brute(data, 40)


def test_empty(rows):
    assert not spans.shared_lengths(rows([], "id long, body string"), "id", "body").count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_winnow(values, run):
    h = np.array(values, np.uint64)
    want = sorted({max(i for i in range(a, a + run) if values[i] == min(values[a : a + run])) for a in range(len(values) - run + 1)})
    assert spans.winnow(h, run).tolist() == want


def test_long_texts_have_the_same_anchors(monkeypatch):
    text = "".join(random.Random(1).choices("abc", k=5000))
    whole = spans.anchors(text, 60, 20)
    monkeypatch.setattr(spans, "_PIECE", 500)
    parts = spans.anchors(text, 60, 20)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


@pytest.mark.parametrize("hot", [20_000, 2])
def test_maximal_spans(rows, hot):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    shared, twice = word(90), word(60)
    texts = ["x" + word(30) + shared + word(20), word(10) + shared + word(15) + twice, word(50) + twice + word(9), word(80), word(70)]
    data = list(enumerate(texts)) + [(9, texts[4]), (10, None), (11, ""), (0, texts[0])]
    df = rows(data, "rec long, text string", extra=("begin", "partner", "n"))
    got = {tuple(r) for r in spans.maximal_spans(df, "rec", "text", None, 40, 16, hot).select("rec", "begin", "end", "partner").collect()}
    by = dict(data)
    for rec, a, b, partner in got:
        piece = by[rec][a:b]
        assert len(piece) >= 40 and piece in by[partner] and rec != partner
    lengths = {(rec, partner): b - a for rec, a, b, partner in got}
    assert set(lengths) == {(0, 1), (1, 0), (1, 2), (2, 1), (4, 9)} and lengths[0, 1] >= 90 and lengths[1, 2] >= 60 and lengths[4, 9] == 70
