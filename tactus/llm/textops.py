"""Arrow and numpy text primitives: byte views of string columns, words, hashes.

A *word* is a maximal run of bytes of a class.  As every byte of a multi-byte UTF-8
character is 0x80 or more, byte classes express the character classes used here.
Null texts are empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text handled at a time; bounds the memory of a task whatever the batch size.
CHUNK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: 0-9, a-z, and all from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False
#: everything but \n
NOTNEWLINE = np.ones(256, bool)
NOTNEWLINE[10] = False

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (overflow wraps)."""
    h = (h ^ (h >> _S)) * _M1
    return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """Some rows of a batch with the bytes of their texts; row i is data[offs[i]:offs[i+1]].
    data has 16 zero bytes more at its end."""

    rows: pa.RecordBatch
    data: np.ndarray
    offs: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split batches so that each chunk holds about ``size`` bytes of text (one row at least)."""
    for rows in batches:
        if not rows.num_rows:
            continue
        col = rows.column(rows.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            own = np.zeros(offs[to] - offs[at] + 16, np.uint8)
            own[: len(own) - 16] = data[offs[at] : offs[to]]
            yield Chunk(rows.slice(at, to - at), own, offs[at : to + 1] - offs[at])
            at = to


@dataclass
class Words:
    """Word i is data[start[i]:end[i]] with 64-bit hash[i]; those of row r are first[r]:first[r+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """The words of every row; ``data`` ends in 16 spare bytes."""
    n = len(data) - 16
    text = LOWER[data] if lower else data
    inside = kind[data[:n]]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offs[:-1][offs[1:] > offs[:-1]]
        begins[full] = inside[full]
        last = offs[1:][offs[1:] > offs[:-1]] - 1
        ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(text, start, end, hash_runs(text, start, end) if hashed else np.zeros(0, np.uint64), np.searchsorted(start, offs))


def hash_runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes a step."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    size = end - start
    h = mix(size.astype(np.uint64) + _M2)
    h = mix(h ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        h[at] = mix(h[at] * _M2 ^ (eight[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    return h


def kmers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, with row starts (rows + 1).
    A row of fewer than k words, but not none, has one shingle of all its words."""
    counts = w.counts()
    whole = (counts > 0) & (counts < k)
    n = np.where(whole, 1, np.maximum(counts - k + 1, 0))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    h = np.full(first[-1], 7, np.uint64)
    for j in range(k):
        h = mix(h * _M2 ^ w.hash[np.minimum(at + j, max(0, len(w.hash) - 1))]) if len(at) else h
    for r in np.flatnonzero(whole):
        v = np.array([11], np.uint64)
        for x in w.hash[w.first[r] : w.first[r + 1]]:
            v = mix(v * _M2 ^ x)
        h[first[r]] = v[0]
    return h, first


def occurrence(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones come before it in its row."""
    if not len(h):
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    codes = pd.factorize(mix(h ^ (row * _M1)))[0]
    return pd.Series(codes).groupby(codes, sort=False).cumcount().to_numpy()


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, the first place of each, and for each element its number."""
    code, values = pd.factorize(h)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values, first, code


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over values[first[i]:first[i+1]]; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def take_columns(rows: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [rows.column(rows.schema.get_field_index(c)) for c in names]


def give_back() -> None:
    """Unused memory goes back to the system: a worker lives on with other tasks and stages, and its allocators
    else keep what one of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task's function for mapInArrow, with its memory given back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
