"""Word shingles of whole texts as 64-bit hashes, worked out on arrays of bytes inside Arrow tasks."""

from __future__ import annotations

import numpy as np

from .common import buffers

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that end a word, and A-Z in lower case.
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_STEP = 0xD1342543DE82EF95
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


def words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text) of an Arrow array; words are runs of bytes that are not blank, A-Z in lower case.

    A word's hash is the difference of two prefix sums of value * STEP ** position, moved back to position 0.
    """
    data, ends = buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    dark = ~_BLANK[data]
    begins, stops = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1]
    stops[:-1] &= ~dark[1:]
    edges = ends[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = dark[inner]
    stops[inner - 1] = dark[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    power = np.full(len(data), _STEP, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[_LOWER[data]] * power)))
    back = np.full(len(data), _STEP_BACK, dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    hashes = mixed((sums[last + 1] - sums[first]) * back[first] + (last - first + 1).astype(np.uint64) * _A)
    return hashes, np.searchsorted(ends, first, side="right") - 1


def sets(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of word shingles of each text: (hashes, offsets); each text's are distinct and sorted.

    With fewer words than width, the whole sequence is the one shingle; a text without words has none.
    """
    hashes, owner = words(texts)
    n = np.bincount(owner, minlength=len(texts))
    acc, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        acc = hashes[: len(hashes) - width + 1].copy()
        for i in range(1, width):
            acc = mixed(acc * _C + hashes[i : len(hashes) - width + 1 + i])
        whole = owner[: len(acc)] == owner[width - 1 :]
        acc, own = acc[whole], owner[: len(whole)][whole]
    begin = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        tail = hashes[begin[short]].copy()
        for i in range(1, width - 1):
            more = n[short] > i
            tail[more] = mixed(tail[more] * _C + hashes[begin[short[more]] + i])
        acc, own = np.concatenate([acc, mixed(tail ^ _A)]), np.concatenate([own, short])
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    fresh = np.ones(len(acc), dtype=bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    acc, own = acc[fresh], own[fresh]
    return acc, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(texts)))))


def per_text(ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ufunc over each text's values; 0 where there are none."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        out[filled] = ufunc.reduceat(values, offsets[filled])
    return out
