"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

Texts are UTF-8, and all separators here are ASCII bytes, so words are found byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def _mixed(count: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but digits and letters.
NO_ALNUM = np.zeros(256, dtype=bool)
NO_ALNUM[:0x80] = True
NO_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_BYTE = _mixed(256, 11)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_BYTE_LOWER = _BYTE[_LOWER]
_FACTOR = 0x9FB21C651E98DF25


class Words(NamedTuple):
    """``first[r]:first[r + 1]`` are the words of text ``r``; ``start`` and ``end`` index ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def words_of(texts: pa.Array, separator: np.ndarray, lower: bool = False) -> Words:
    """Words of every text; a null text has none. Equal words have equal hashes of 64 bits."""
    data, offsets = _bytes(texts)
    n = len(data)
    inside = ~separator[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    length = end - start
    longest = int(length.max(initial=0))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(max(1, longest), _FACTOR, dtype=np.uint64))
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        value = (_BYTE_LOWER if lower else _BYTE)[data[inside]] * power[at]
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        stop = np.cumsum(length)
        hashed = mix(total[stop] - total[stop - length])
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, hashed, first)


def run_hash(hashed: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` numbers from each position on (shorter by ``length`` - 1)."""
    have, block, size, done = None, hashed, 1, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if have is None:
                    have, done = block, size
                else:
                    n = len(hashed) - done - size + 1
                    if n <= 0:
                        return hashed[:0]
                    have = mix(have[:n] * np.uint64(0xD6E8FEB86659FD93) + block[done : done + n])
                    done += size
            size *= 2
            if size > length:
                return have if len(hashed) >= length else hashed[:0]
            n = len(block) - size // 2
            if n <= 0:
                return hashed[:0]
            block = mix(block[:n] * np.uint64(0x9E3779B97F4A7C15) + block[size // 2 : size // 2 + n] + np.uint64(1))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``limit`` bytes, or one longer text."""
    _, offsets = _bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
