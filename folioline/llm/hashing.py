"""Words and rolling hashes of whole Arrow batches of text, without a Python loop over words.

A word is a longest run of bytes other than space and 0x09-0x0D. Hashes are polynomials
modulo 2**64 over random byte values, finished by a mixing step, so that the hash of any
stretch of words comes from two running sums (Rabin-Karp).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; one longer document is a piece of its own.
PIECE_BYTES = 1 << 20


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


_BYTES = _odd(11, 256)
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finish)."""
    x = np.asarray(x, dtype=U64) + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._up = self._down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self._up.size < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, dtype=U64), np.full(size, self.inverse, dtype=U64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self._up[:n], self._down[:n]


_CHARS = Powers(0xD6E8FEB86659FD93)
_WORDS = (Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB))


def running_hash(values: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and inverse powers from which ``stretch_hash`` reads any stretch."""
    up, down = _WORDS[which].upto(values.size + 1)
    sums = np.zeros(values.size + 1, dtype=U64)
    np.cumsum(values * up[: values.size], out=sums[1:])
    return sums, down


def stretch_hash(running, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, down = running
    return mixed((sums[stop] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of some documents: hash and byte range of each, and each document's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray


def stretch_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each byte range."""
    up, down = _CHARS.upto(data.size + 1)
    sums = np.zeros(data.size + 1, dtype=U64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * up[: data.size], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """``fold`` takes A-Z as a-z. ``offsets`` start at 0 and end at ``data.size``."""
    inside = ~_SEPARATOR[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    if data.size:
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(stretch_keys(data, starts, ends, fold), starts, ends, np.searchsorted(starts, offsets), data)


def give_back() -> None:
    """Return unused memory to the system: a worker would keep a batch's for its whole life."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column, null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = len(column)
    if not size:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + size + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < size:
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), size)
        own = offsets[row : end + 1]
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end
    give_back()


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, and where each document's begin.

    A document with fewer words has one: all of its words. Without words it has none.
    """
    count = np.diff(found.first)
    if not found.hashes.size:
        return np.zeros(0, dtype=U64), np.zeros(count.size + 1, dtype=np.int64)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    doc = np.repeat(np.arange(count.size), number)
    start = found.first[doc] + np.arange(bounds[-1]) - bounds[doc]
    stop = np.minimum(start + width, found.first[doc + 1])
    return stretch_hash(running_hash(found.hashes), start, stop), bounds
