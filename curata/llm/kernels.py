"""Array helpers that the operators share inside their tasks.

A *block* is some whole texts laid end to end as one byte array with offsets,
so numpy works on many texts at once.  Blocks hold about ``BLOCK_BYTES``; a
text is never cut, so one longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK64 = (1 << 64) - 1


@dataclass
class Block:
    """``rows``: the Arrow rows of the texts; text i is ``data[ends[i] : ends[i + 1]]``."""

    rows: pa.RecordBatch
    data: np.ndarray
    ends: np.ndarray

    def raw(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]].tobytes()


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks; a null text counts as an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            last = min(last, len(texts))
            yield Block(
                batch.slice(first, last - first),
                data[ends[first] : ends[last]],
                ends[first : last + 1] - ends[first],
            )
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@lru_cache(maxsize=8)
def letters(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407) + U64(seed * 7919 + 1))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.empty(size, U64)
            out[0] = 1
            have, step = 1, base
            while have < size:
                out[have : 2 * have] = out[:have] * U64(step)
                have, step = 2 * have, step * step & MASK64
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any stretch of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(letters(seed)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Raw hashes of ``data[start:end]``; equal bytes have equal hashes wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        """Raw hashes of every stretch of that length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values in the ranges, both ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of non-white bytes: not space and not 0x09 to 0x0D.
NOT_BLANK = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z as a to z; every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32))


def word_bounds(data: np.ndarray, ends: np.ndarray, inside: np.ndarray = NOT_BLANK):
    """Start, end and text number of each word; no word crosses from a text into the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    member = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | edge[1:-1]
    stop = member.copy()
    stop[:-1] &= ~member[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(ends, starts, "right") - 1


def per_text(counts_of: np.ndarray, texts: int) -> np.ndarray:
    """How often each text number occurs."""
    return np.bincount(counts_of, minlength=texts).astype(np.int64)


def longs(values) -> pa.Array:
    """64-bit codes as Arrow longs, whatever their sign."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema)],
        schema=schema,
    )
