"""Hashes of words, shingles and character n-grams, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: A fixed random number for each byte, so that sums of bytes times powers don't collide by their small values.
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Texts are hashed in pieces of about so many bytes, cut at white space: memory doesn't follow a text's length.
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(PIECE + 1, n).bit_length()
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:  # to the next white space
            space = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            end = end + int(space[0]) + 1 if len(space) else min(end + PIECE, len(data))
        yield data[at:end]
        at = end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes, A-Z lower-cased, between each start and end."""
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry than texts).

    A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z
    lower-cased.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, starts, offset = [], [], 0
    for piece in _pieces(data):
        space = _SPACE[piece]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        hashes.append(span_hashes(piece, start, end))
        starts.append(start + offset)
        offset += len(piece)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words.

    A text of fewer words gives its whole sequence as one shingle, one without words gives none.
    """
    words, begins = word_hashes(texts)
    out = []
    if len(words) >= size:
        runs = words[: len(words) - size + 1].copy()
        for i in range(1, size):
            runs = runs * np.uint64(_BASE) + words[i : len(words) - size + 1 + i]
        runs = mix64(runs)
    for a, b in zip(begins[:-1], begins[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = short * np.uint64(_BASE) + words[i : i + 1]
            out.append(mix64(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
