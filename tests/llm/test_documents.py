import json
import random

import pytest
from tokenizers import Tokenizer

from sievework.llm import bpe, cutoff, leak
from sievework.operators import skew

PATH = f"{bpe.TOKENIZERS}/{bpe.NAME}.tiktoken"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.NAME}.json")
    t.encode_special_tokens = True
    return t


def test_ids(rows, reference):
    rng = random.Random(3)
    pool = "abcdefghij  \n\t.,'é中文字🙂<|>0123"
    texts = ["", None, "<|endoftext|>", "a" * 5000, " " * 70, "it's we'll\n\n x", "Größe — 中文。"] + ["".join(rng.choices(pool, k=rng.randint(1, 200))) for _ in range(300)]
    df = rows(list(enumerate(texts)), "doc_id long, text string", extra=("ids", "n"))
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert got == {k: reference.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert not bpe.token_ids(df.limit(0)).count()


def test_words_come_back(reference):
    e = bpe.encoder(PATH)
    for t in ("aaaaaaaaaaa", "hello world", "🙂🙂"):
        assert reference.decode(e.encode([t])[0]) == t


def brute_leaks(docs, items, least):
    out = set()
    grams = {i: {tuple(w[a : a + least]) for a in range(len(w) - least + 1)} for i, t in items if (w := leak.words_of(t))}
    for d, t in docs:
        w = leak.words_of(t)
        own = {tuple(w[a : a + least]) for a in range(len(w) - least + 1)}
        out |= {(d, i) for i, g in grams.items() if g & own}
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_leaks(rows, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    rng = random.Random(4)
    words = ["Der", "Straße", "x_1", "the", "the", "a", "b", "c", "λ"]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(20)]
    docs = []
    for k in range(60):
        part = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(part) - 5))
        middle = rng.choice([" ", "\n - ", ", "]).join(part[a : a + rng.randint(1, 20)])
        docs.append((k, " ".join(rng.choices(words, k=9)) + " " + (middle.upper() if k % 3 == 0 else middle) + "; end"))
    docs += [(90, None), (91, ""), (92, "the " * 300), docs[0]]
    items += [("n", None), ("e", ""), (None, "the " * 20), items[0]]
    got = leak.leaks(rows(docs, "doc_id long, text string", extra=("item_id", "n")), rows(items, "item_id string, text string", extra=("doc_id",)), 6)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == brute_leaks(docs, [i for i in items if i[0]], 6) and all(r.run_words >= 6 for r in got.collect())
    assert not leak.leaks(rows([], "doc_id long, text string"), rows(items, "item_id string, text string"), 6).count()


def test_word_hashes_follow_the_words():
    rng = random.Random(5)
    pool = "aZéßẞİıŉǰΐﬁ_1٣ \n-e\u0301\u0307中文🙂Σςσ"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(300)] + ["", "a" * 3_000_000]
    seen = {}
    for first, h, at in leak.word_hashes(texts):
        for k in range(len(at) - 1):
            words = leak.words_of(texts[first + k])
            assert len(words) == at[k + 1] - at[k]
            for w, x in zip(words, h[at[k] : at[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def prose(rng):
    words = "the parser reads every header before another branch drops a small buffer near each open record".split()
    return " ".join(f"{' '.join(rng.choices(words, k=rng.randint(6, 12))).capitalize()}." for _ in range(rng.randint(3, 7)))


def test_contexts_keep_to_their_line():
    import numpy as np

    lines = ["a b", "", "Größe 12", "🙂中文 x", "ab"]
    cells = lambda own, lang="en": own.cells(lang, "prose", np.arange(len(own.char)))
    p = cutoff.Places(lines)
    assert p.stops.sum() == 4 and p.at.tolist() == [0, 3, 3, 11, 16, 18]
    for k, line in enumerate(lines):
        own = cutoff.Places([line])
        assert (cells(own) == cells(p)[:, p.at[k] : p.at[k + 1]]).all() and (own.stops == p.stops[p.at[k] : p.at[k + 1]]).all()
    assert cells(cutoff.Places([""])).shape == (6, 0) and cells(cutoff.Places([])).shape == (6, 0)
    assert (cells(p, "de")[1:3] == cells(p)[1:3]).all() and not np.array_equal(cells(p, "de")[3], cells(p)[3])


def test_thresholds_are_fitted():
    rows = [("en", False, -40, 1000), ("en", False, 5, 1), ("en", True, 30, 900), ("en", True, -50, 9), ("de", False, 0, 3), ("de", True, 9, 3)]
    got = cutoff.fitted(rows)
    assert list(got) == ["en"] and 6 * cutoff.BIN - 1e-9 <= got["en"] <= 30 * cutoff.BIN + 1e-9
    assert cutoff.fitted([]) == {} and cutoff.Model([], got).threshold("de") == 1.0


def test_cut_off(rows):
    rng = random.Random(9)
    data, cut = [], set()
    for k in range(400):
        text = "\n\n".join(prose(rng) for _ in range(2))
        source = ("plain", "limited", "marked")[k % 3]
        if source == "limited" and len(text) > 300 and k % 2:
            text, _ = text[:300], cut.add(k) if text[299] not in "." else None
        elif source == "marked" and len(text) > 240:
            text = text[:237].rstrip(".") [:237].ljust(237, "x") + "..."
            cut.add(k)
        elif k % 5 == 0:
            text += rng.choice(["\n\n- item one 7.15\n- item two 7.16", "\n\nRefs: #1234", "\n\n-- \nMaria", "\n\n```\nx = f(1)\n```", "\n\nSee also: https://a.example/b/12"])
        data.append((k, text, "en", source))
    mid = prose(rng)[:-9]
    data += [(900, mid, "en", "plain"), (901, None, "en", "plain"), (902, "", None, None), (903, " \n ", "xx", "plain"), (904, prose(rng), None, None), (905, prose(rng) + " Ein Te�", "de", "plain"), data[0]]
    cut |= {900, 905}
    df = rows(data, "doc_id long, text string, lang string, source string", extra=("unit", "n", "limit_chars_x"))
    got = {r.doc_id for r in cutoff.cut_off(df).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(cut), (sorted(got - cut)[:9], sorted(cut - got)[:9])
    assert {901, 902, 903, 904}.isdisjoint(got)
    rates = {r.source: (r.n_docs, r.n_cut) for r in cutoff.rates(df).collect()}
    assert rates[None] == (1, 0) and sum(n for n, _ in rates.values()) == 403
    assert not cutoff.cut_off(df.limit(0)).count()
    json.dumps(str(rates))
