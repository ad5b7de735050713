"""Vectorised words and hashes over whole Arrow batches of texts: no Python loop per word.

A batch's UTF-8 bytes are one array; words, their hashes and their shingles come from array
operations over it. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def step(i: int) -> np.uint64:
    """i times the golden step, modulo 2^64."""
    return U(i * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * GOLDEN)


PLACE = stream(12, 16) | U(1)
_FOLD = LOWER.astype(U)
_PLAIN = np.arange(256, dtype=U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes with their bytes and offsets; a longer text comes alone, whole."""
    data, offs = buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(f: Mapper) -> Mapper:
    """A mapper that hands its freed memory back at the end: idle Python workers stay beside the executor for later stages."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


@dataclass
class Words:
    """Word i is bytes start[i]:end[i]; text t has the words first[t]:first[t + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    inside = ~SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    some = offs[1:] > offs[:-1]
    begin[offs[:-1][some]] = inside[offs[:-1][some]]
    finish[offs[1:][some] - 1] = inside[offs[1:][some] - 1]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(finish) + 1, np.searchsorted(start, offs))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the runs of bytes start[i]:end[i], which are in order and do not overlap; with ``fold``, of A-Z lower-cased.

    The sum of a pseudo-random number for every byte and its place in the run, mixed with the length: unlike a polynomial of the bytes
    modulo a power of two, it has no pairs of runs that collide by their form.
    """
    length = end - start
    base = np.zeros(len(data) + 1, np.int64)  # differences of the running run start
    base[start[length > 0]] = np.diff(start[length > 0], prepend=0)
    place = np.arange(len(data)) - np.cumsum(base[:-1])
    total = np.zeros(len(data) + 1, U)
    np.cumsum(mix(((place.astype(U) << U(8)) | (_FOLD if fold else _PLAIN)[data]) + GOLDEN), dtype=U, out=total[1:])
    return mix(total[end] - total[start] + length.astype(U) * GOLDEN)


def word_hashes(data: np.ndarray, w: Words, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, of the word with A-Z lower-cased."""
    return run_hashes(data, w.start, w.end, fold)


def shingles(h: np.ndarray, w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words in order, and the texts' first places among them.

    A text with fewer words, but one, gives the hash of its whole sequence.
    """
    count = w.count
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(first[-1], U)
    text = np.repeat(np.arange(len(count)), n)
    at = w.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    have = np.minimum(count[text], k)
    for i in range(k):
        ok = have > i
        if ok.all():
            out += h[at + i] * PLACE[i]
        else:
            out[ok] += h[at[ok] + i] * PLACE[i]
    return mix(out + have.astype(U) * GOLDEN), first


def distinct(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values, sorted and without repeats, and the texts' new first places. Sorts ``x`` in place."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    starts = first[:-1][first[:-1] < len(x)]
    new[starts] = True
    return x[new], np.concatenate(([0], np.cumsum(new)))[first]
