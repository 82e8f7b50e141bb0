"""Hashes of bytes, words and runs of words, for whole texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def seeds(n: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


#: One for each byte, and a base (odd) with its inverse.
BYTE = seeds(256)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; as many as the longest text needed are kept."""
    if len(_held[0]) < n:
        for i, x in enumerate((BASE, INVERSE)):
            p = np.full(1 << max(16, (n - 1).bit_length()), x, np.uint64)
            p[0] = 1
            _held[i] = np.multiply.accumulate(p)
    return _held[0][:n], _held[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values times powers of the base before each position: (sums[j] - sums[i]) * inverse power i is a hash of
    values i to j, wherever they stand."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


#: Lower case for A-Z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text between white space, lower case for A-Z."""
    data = FOLD[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    sums, inverse = prefix_sums(BYTE[data]), powers(len(data))[1]
    return mix((sums[end] - sums[start]) * inverse[start]), start, end


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each position on, of the whole if there are fewer."""
    k = min(size, len(h))
    out = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return out


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of a text."""
    return np.unique(runs(words(text)[0], size))


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique() of a few values, without its overhead."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """shingles() of each of several texts, hashed together."""
    h, start, _ = words(b"\n".join(texts))
    edge = np.append(np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])), len(h)).tolist()
    whole = runs(h, size)
    return [distinct(whole[lo : hi - size + 1] if hi - lo >= size else runs(h[lo:hi], size)) for lo, hi in zip(edge, edge[1:], strict=False)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each position on."""
    out, k = x, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    rest = width - k
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
