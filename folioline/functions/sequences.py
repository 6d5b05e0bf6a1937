"""Ratcliff-Obershelp ratios of many pairs of strings at once, over arrays.

The longest common block of a pair comes from a table of run lengths, a row for each
character of the first string, for all pairs in step; then the pieces left and right of the block
are pairs of their own, until no block is left.
"""

from __future__ import annotations

import numpy as np

#: Cells of one row of all tables together.
_CELLS = 1 << 20
#: In second strings of this length or more, a character of more than one in a hundred places
#: begins no block (but may continue one).
LONG = 200


def _coded(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, a row each and filled up; lengths)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = int(lengths.max(initial=0)) + 1
    table = np.full((len(texts), width), filler, dtype=np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    table[np.arange(width)[None, :] < lengths[:, None]] = flat
    return table, lengths


def _begins(table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the characters of second strings may begin a block."""
    seeds = np.arange(table.shape[1])[None, :] < lengths[:, None]
    for row in np.flatnonzero(lengths >= LONG):
        own = table[row, : lengths[row]]
        values, number = np.unique(own, return_counts=True)
        seeds[row, : lengths[row]] &= ~np.isin(own, values[number > lengths[row] // 100 + 1])
    return seeds


def _longest(a, b, seeds, pair, alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of the longest block of each piece; the first in a, then in b."""
    width = int((bhi - blo).max())
    column = blo[:, None] + np.arange(width)[None, :]
    inside = column < bhi[:, None]
    column = np.minimum(column, b.shape[1] - 1)
    there, usable = b[pair[:, None], column], seeds[pair[:, None], column] & inside
    runs = np.zeros((pair.size, width + 1), dtype=np.int32)
    size, i, j = np.zeros(pair.size, dtype=np.int64), alo.copy(), blo.copy()
    every = np.arange(pair.size)
    for step in range(int((ahi - alo).max())):
        at = alo + step
        here = np.where(at < ahi, a[pair, np.minimum(at, a.shape[1] - 1)], -3)
        runs[:, 1:] = np.where((there == here[:, None]) & usable, runs[:, :-1] + 1, 0)
        end = runs[:, 1:].argmax(axis=1)
        longest = runs[every, end + 1]
        more = longest > size
        size[more] = longest[more]
        i[more], j[more] = (at - longest + 1)[more], (blo + end - longest + 1)[more]
    return i, j, size


def _extended(a, b, pair, alo, ahi, blo, bhi, i, j, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with the equal characters on either side, whatever these are."""
    while True:
        more = (i > alo) & (j > blo) & (a[pair, i - 1] == b[pair, j - 1])
        if not more.any():
            break
        i, j, size = i - more, j - more, size + more
    while True:
        x, y = i + size, j + size
        more = (x < ahi) & (y < bhi)
        more &= a[pair, np.minimum(x, a.shape[1] - 1)] == b[pair, np.minimum(y, b.shape[1] - 1)]
        if not more.any():
            return i, j, size
        size = size + more


def block_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The ratio of each pair: twice the characters in common blocks by the characters of both.

    Not symmetric: the wanted text comes first. Two empty strings have ratio 1.
    """
    found = np.ones(len(first))
    lengths = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], dtype=np.int64)
    # Pairs of similar sizes together.
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < order.size:
        most = max(1, _CELLS // (int(lengths[order[min(at + (1 << 14), order.size) - 1]]) + 1))
        rows = order[at : at + min(most, 1 << 14)]
        found[rows] = _ratios([first[r] for r in rows], [second[r] for r in rows])
        at += rows.size
    return found


def _ratios(first: list[str], second: list[str]) -> np.ndarray:
    (a, la), (b, lb) = _coded(first, -1), _coded(second, -2)
    seeds = _begins(b, lb)
    matched = np.zeros(len(first), dtype=np.int64)
    pair = np.flatnonzero((la > 0) & (lb > 0))
    alo, ahi, blo, bhi = np.zeros_like(pair), la[pair], np.zeros_like(pair), lb[pair]
    while pair.size:
        i, j, size = _longest(a, b, seeds, pair, alo, ahi, blo, bhi)
        long = lb[pair] >= LONG
        if long.any():
            own = [x[long] for x in (pair, alo, ahi, blo, bhi, i, j, size)]
            i[long], j[long], size[long] = _extended(a, b, *own)
        np.add.at(matched, pair, size)
        pieces = [(pair, alo, i, blo, j), (pair, i + size, ahi, j + size, bhi)]
        pair, alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*pieces, strict=True))
        going = np.concatenate([size, size]) > 0
        going &= (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = (x[going] for x in (pair, alo, ahi, blo, bhi))
    return 2 * matched / (la + lb)
