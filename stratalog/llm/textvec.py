"""Words and rolling word windows of whole Arrow text columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """The words of ``n_docs`` texts: 64-bit hashes in text order, ``first[d]:first[d+1]`` being document d's."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string column; null counts as the empty text. ``lower`` folds A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    if n == 0 or texts.buffers()[2] is None:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty.astype(np.uint64), np.zeros(n + 1, dtype=np.int64), empty, empty, np.zeros(0, np.uint8))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    size = len(data)
    text = ~_SPACE[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(size, dtype=bool)
    before[1:] = ~text[:-1]
    starts = np.flatnonzero(text & (before | edge[:-1]))
    after = np.ones(size, dtype=bool)
    after[:-1] = ~text[1:]
    ends = np.flatnonzero(text & (after | edge[1:])) + 1
    up, down = _power_tables(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values, across document borders too; len(hashes) - k + 1 of them."""
    m = max(0, len(hashes) - k + 1)
    total = np.full(m, seed, dtype=np.uint64)
    for j in range(k):
        total = total * _U(_BASE) + hashes[j : j + m]
    return mix64(total)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Of the runs of ``k`` words, the word positions of those that lie inside one document."""
    n = int(first[-1])
    inside = np.zeros(n + 1, dtype=np.int32)
    full = np.diff(first) >= k
    np.add.at(inside, first[:-1][full], 1)
    np.add.at(inside, first[1:][full] - k + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:n]) > 0)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one document at least)."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column)
    if texts.null_count == n or texts.buffers()[2] is None:
        yield batch
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
