"""Vectorised word splitting and hashing of UTF-8 text inside Arrow batches.

A word is a longest run of ASCII letters and digits and of any characters beyond
ASCII; A to Z count as a to z. Working on bytes keeps every step in numpy: one
table look-up per byte, one sum per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of one vectorised block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(4096, 0x100000001B3, np.uint64))


def is_word(data: np.ndarray) -> np.ndarray:
    """Whether each byte is part of a word."""
    return _WORD[data]


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z as a to z."""
    return _LOWER[data]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    return mix(values + np.uint64((salt + 1) * int(_MULTIPLIER) % 2**64))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as (first row, bytes, start of each row and end of the last).

    A run stops at ``most`` bytes, or after one row that alone is longer. Null texts are empty.
    """
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a block, and the row it is in (counted from the block's first)."""
    inside = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a word may end one row and the next row begin with one
    edges = np.flatnonzero(edge)
    if len(cuts):
        edges = np.sort(np.concatenate([edges, cuts, cuts]), kind="stable")
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A to Z as a to z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = _LOWER[data[_WORD[data]]].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * _POWERS[within & 4095], first)
    return mix(sums + lengths.astype(np.uint64) * _MULTIPLIER)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words of a sequence that may span rows; the caller drops those that do."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within a row, with their rows; a row of fewer words is one run."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = runs(hashes, n)
    whole = rows[: len(found)] == rows[n - 1 :] if len(found) else np.zeros(0, bool)
    found, at = found[whole], rows[: len(whole)][whole]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    short = first[size < n]
    if len(short):
        sizes = size[size < n]
        value = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            there = sizes > i
            value[there] = value[there] * np.uint64(0x100000001B3) + hashes[short[there] + i]
        found, at = np.concatenate([found, mix(value + sizes.astype(np.uint64))]), np.concatenate([at, rows[short]])
        order = np.argsort(at, kind="stable")
        found, at = found[order], at[order]
    return found, at
