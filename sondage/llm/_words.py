"""Hashes of the words of Arrow string columns, computed on whole batches of bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A value per byte, the same for a letter A-Z and its lower case; an odd base and its inverse modulo 2**64.
_VALUE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.empty(size, np.uint64)
        have[0], filled = 1, 1
        while filled < size:
            more = min(filled, size - filled)
            have[filled : filled + more] = have[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        if size > 1 << 18:  # a very long text: not kept
            return have
        _powers[base] = have
    return have[:n]


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(make):
    """A function of batches that gives freed memory back to the system when its task is done: workers serve many tasks."""

    def run(batches):
        yield from make(batches)
        give_back()

    return run


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    return data, at


def chunks(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is one by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (A-Z lowered), starts and ends of the words of consecutive texts, and the number of words before each."""
    base = int(offsets[0])
    a, at = data[base : int(offsets[-1])], offsets - base
    if not len(a):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    full = ~_IS_SPACE[a]
    cut = np.zeros(len(a) + 1, bool)
    cut[at] = True
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1] | cut[1:-1]
    end[:-1] &= ~full[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[a] * _power(_BASE, len(a)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(a))[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, at)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` word hashes (of neighbouring texts too; the caller keeps those within one)."""
    n = max(0, len(h) - k + 1)
    g = mix(h[:n])
    for j in range(1, k):
        g = mix(g + h[j : n + j] * np.uint64(2 * j + 1))
    return g


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a sequence of words shorter than a shingle."""
    g = np.array([len(h)], np.uint64)
    for x in h:
        g = mix(g * np.uint64(3) + x)
    return g


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
