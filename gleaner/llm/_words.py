"""Words and their 64-bit hashes for whole Arrow columns of text, with numpy.

A word is a run of bytes without ASCII space and the five blanks 0x09-0x0D, which is the same as
the run of characters, since UTF-8 keeps those bytes to themselves. A word's hash is a polynomial
over random numbers drawn for each byte value, taken from prefix sums and mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled at once; a longer document is handled by itself.
SLICE_BYTES = 1 << 20

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@cache
def _byte_codes(seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def tidy() -> None:
    """Gives freed memory back to the system at a task's end: workers live on."""
    pa.default_memory_pool().release_unused()
    if len(_powers) and len(_powers[0]) > 4 * SLICE_BYTES:
        _powers.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run``, a function for mapInArrow that keeps nothing from one batch to the next, with freed memory given back
    after each batch: beside a JVM that has taken its whole heap, two workers have little."""

    def each(batches):
        for batch in batches:
            yield from run(iter((batch,)))
            del batch
            tidy()

    return each


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, stop
        start = stop


def split(texts: pa.Array, lower: bool = False, blank: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first): document i has the words first[i] .. first[i+1]-1.
    ``blank`` says which bytes are no part of a word."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    if lower:
        raw = _lower[raw]
    n = len(raw)
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(blank[raw], out=word[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inside = word[1:-1]
    starts = np.flatnonzero(inside & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (~word[2:] | edge[1:])) + 1
    return raw, starts, ends, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 20240229) -> np.ndarray:
    """A 64-bit hash of each word; another ``seed`` gives an independent one."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    parts = sums[1:]  # everything in place: texts may be long
    np.take(_byte_codes(seed), raw, out=parts, mode="clip")
    np.multiply(parts, up[: len(raw)], out=parts)
    np.cumsum(parts, out=parts)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, over document ends too: the caller drops those."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.multiply(words, up[: len(words)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])
