"""Whole texts as flat byte blocks, so that numpy can work on many documents at once.

A block is a run of whole documents of one Arrow batch: the UTF-8 bytes back to back and the
offsets at which each document begins. Blocks hold about ``BLOCK_BYTES`` (one longer document
makes a block of its own), so memory stays in proportion to that, or to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32



def by_table(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for 256 entries of a byte each, several times faster."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_ODD))


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


#: Workers are used again and again, so what they keep is small; longer tables are made when needed.
_KEPT = 5 << 18
_kept_powers = lru_cache(maxsize=1)(_make_powers)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers(-(-n // _KEPT) * _KEPT) if n <= 3 * _KEPT else _make_powers(n)


class SpanHasher:
    """64-bit hashes of byte spans of a block from one prefix sum; equal spans hash alike."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self._down = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


#: The low bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short spans, eight bytes at a time; equal spans hash alike in every block."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * np.uint64(_ODD) + (eight[starts] & _LOW[np.minimum(left, 8)]))
    some = np.flatnonzero(left > 8)
    for done in range(8, _LONG, 8):
        some = some[left[some] > done]
        if not len(some):
            break
        out[some] = mix(out[some] * _BASE + (eight[starts[some] + done] & _LOW[np.minimum(left[some] - done, 8)]))
    for i in np.flatnonzero(left > _LONG).tolist():
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes()))
    return out


@dataclass
class Block:
    """``rows``: the slice of the batch; ``offsets``: one more than there are documents."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each document's first (one more at the end)."""
        data = self.data if data is None else data
        space = np.ones(len(data) + 2, dtype=bool)
        space[1:-1] = by_table(data, SPACE)
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        # a document may begin right after the last word of the one before
        inner = np.unique(self.offsets[1:-1])
        cut = inner[~space[inner] & ~space[inner + 1]]
        if len(cut):
            starts, ends = np.insert(starts, np.searchsorted(starts, cut), cut), np.insert(ends, np.searchsorted(ends, cut), cut)
        return starts, ends, np.searchsorted(starts, self.offsets)


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each span of ``offsets``."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = string_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield Block(slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    # workers live long: what a batch needed goes back before the next one comes
    del data
    pa.default_memory_pool().release_unused()


def same_as_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs more than once; the key has occurred before."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    often, again = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order[1:][equal]] = True
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    return often, again
