"""Hashes of the tokens and token pairs of many texts at once, as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_CHUNK = 1 << 21
_IS_TOKEN = np.zeros(256, np.bool_)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_":
    _IS_TOKEN[_c] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, n of each at least."""
    size = max(_CHUNK, 1 << int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, np.uint64)
            p[0] = 1
            q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            q[0] = 1
            _POWERS[size] = np.cumprod(p), np.cumprod(q)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _CHUNK characters together: (first index, end index). One long text is a run of its own."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > _CHUNK:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each maximal run of ASCII letters, digits and underscores, in order, and the offsets of the texts in them."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(_IS_TOKEN[data].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, q = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * p[: len(data)], out=total[1:])
        h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * _MULT)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return h, np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))


def item_sets(texts: list[bytes], least: int) -> Iterator[np.ndarray | None]:
    """For each text: the sorted distinct hashes of its tokens and of its pairs of adjacent tokens, or None under `least` tokens."""
    for a, b in chunks(texts):
        h, at = tokens(texts[a:b])
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] * np.uint64(3) + h[1:] * _MULT + np.uint64(7)) if len(h) else h
        for k in range(b - a):
            i, j = at[k], at[k + 1]
            yield np.unique(np.concatenate((h[i:j], pair[i : max(i, j - 1)]))) if j - i >= max(1, least) else None
