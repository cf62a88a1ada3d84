"""Texts of an Arrow batch as byte arrays, and their word shingles, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null text is empty."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 256) - 1, _BASE))))
    return _POWERS[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased (unless lower is false), in order, and the number of words in each text."""
    blank = _SPACE[data]
    word = ~blank
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    part = (_LOWER if lower else _AS_IS)[data[starts[0] :]]
    part[blank[starts[0] :]] = 0
    part *= _powers(int(lengths.max()))[place]
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(np.add.reduceat(part, starts - starts[0])), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words; all its words, if fewer."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    joined = np.full(max(0, len(words) - size + 1), np.uint64(size))
    for k in range(size):
        joined = joined * _STEP + words[k : k + len(joined)]
    joined = mix(joined)
    found = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            hashes = np.sort(joined[end - n : end - size + 1])
            found.append(hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))])
        elif n:
            short = np.array([n], dtype=np.uint64)
            for w in words[end - n : end]:
                short = short * _STEP + w
            found.append(mix(short))
        else:
            found.append(np.empty(0, dtype=np.uint64))
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
