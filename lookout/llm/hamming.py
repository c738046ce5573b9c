"""Search of a bucket of 64-bit hash pairs (p, d) for all that lie within a threshold each, with arrays.

8 differing bits of d in three blocks leave a block with at most 2, and 2 in the three pieces of a block leave a piece
without any. So two close pairs share a piece, and differ in at most 2 bits of the rest of its block: a node becomes nine
rows, one for each piece, and all that remains is done inside a bucket. 10 differing bits of p in eleven parts leave a part
without any, which splits a bucket too large for one task. Each two are given by the first piece (and part) that they share
in this way, so once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

MAX_P, MAX_D = 10, 8
#: (first bit, bits). Three pieces of d make a block.
PIECES = (*((7 * i, 7) for i in range(8)), (56, 8))
PARTS = (*((6 * i, 6) for i in range(9)), (54, 5), (59, 5))
QUARTERS = tuple((16 * i, 16) for i in range(4))
#: Nodes up to which all pairs of a bucket are compared, and candidates that are compared at once: both change the speed only.
FEW, AT_ONCE = 1024, 1 << 18


def _bits(x: np.ndarray, at: int, width: int) -> np.ndarray:
    return ((x >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _ball(width: int) -> list[int]:
    """All masks of at most 2 bits."""
    ones = [1 << i for i in range(width)]
    return [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i])]


def _is_close(p: np.ndarray, d: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.flatnonzero(np.bitwise_count(d[left] ^ d[right]) <= MAX_D)
    left, right = left[near], right[near]
    near = np.bitwise_count(p[left] ^ p[right]) <= MAX_P
    return left[near], right[near]


def _every(d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs whose d is close, from every pair."""
    step = max(1, AT_ONCE // max(1, len(d)))
    for a in range(0, len(d), step):
        i, j = np.nonzero(np.bitwise_count(d[a : a + step, None] ^ d[None, a:]) <= MAX_D)
        later = j > i
        yield i[later] + a, j[later] + a


class _Index:
    """Nodes by a value of ``width`` bits, to be met by values that differ in at most 2 bits."""

    def __init__(self, value: np.ndarray, width: int):
        self.order, self.width = np.argsort(value, kind="stable"), width
        self.value = value[self.order]
        self.start = np.searchsorted(self.value, np.arange((1 << width) + 1))
        self.lower = [np.flatnonzero(self.value >> bit & 1 == 0) for bit in range(width)]

    def _meetings(self, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, the first that each meets, and how many: those of equal value that come later, or those of value ^ mask."""
        if not mask:
            rows = np.arange(len(self.value))
            return rows, rows + 1, self.start[self.value + 1] - rows - 1
        rows = self.lower[mask.bit_length() - 1]
        other = self.value[rows] ^ mask
        first = self.start[other]
        return rows, first, self.start[other + 1] - first

    def candidates(self) -> int:
        """The number of meetings, from the counts of values alone."""
        count, at = np.diff(self.start), np.arange(1 << self.width)
        return int(sum((count * count[at ^ mask]).sum() for mask in _ball(self.width))) // 2

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for mask in _ball(self.width):
            rows, first, many = self._meetings(mask)
            upto = np.cumsum(many)
            cuts = np.searchsorted(upto, np.arange(AT_ONCE, upto[-1] if len(upto) else 0, AT_ONCE)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if a < b and (total := many[a:b].sum()):
                    right = np.arange(total) + np.repeat(first[a:b] - upto[a:b] + many[a:b] + (upto[a - 1] if a else 0), many[a:b])
                    yield self.order[np.repeat(rows[a:b], many[a:b])], self.order[right]


def _first(i: np.ndarray, j: np.ndarray, x: np.ndarray, agree: Callable[[np.ndarray, int], np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Those index pairs that agree at ``wanted`` and at none before it."""
    off = x[i] ^ x[j]
    keep = agree(off, wanted)
    for k in range(wanted):
        keep &= ~agree(off, k)
    return i[keep], j[keep]


def _piece_agrees(off: np.ndarray, piece: int) -> np.ndarray:
    block = piece // 3 * 3
    at, width = PIECES[block][0], sum(w for _, w in PIECES[block : block + 3])
    return (_bits(off, *PIECES[piece]) == 0) & (np.bitwise_count(_bits(off, at, width)) <= 2)


def _part_agrees(off: np.ndarray, part: int) -> np.ndarray:
    return _bits(off, *PARTS[part]) == 0


def _quarter_agrees(off: np.ndarray, quarter: int) -> np.ndarray:
    return np.bitwise_count(_bits(off, *QUARTERS[quarter])) <= 2


def close_pairs(p: np.ndarray, d: np.ndarray, piece: int, part: int | None = None, most: int = 2000, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i, j of the close nodes among those that share a piece of d (and a part of p) and are given by it.

    The rest of the piece's block is the index; where it leaves more than ``most`` candidates a node, four quarters of p
    are, as 10 differing bits leave a quarter with at most 2.
    """
    p, d = p.view(np.uint64), d.view(np.uint64)
    n, out = len(d), []
    if n <= few:
        out = [_is_close(p, d, i, j) for i, j in _every(d)]
    else:
        rest, shift = np.zeros(n, np.int64), 0
        for k in range(piece // 3 * 3, piece // 3 * 3 + 3):
            if k != piece:
                rest |= _bits(d, *PIECES[k]) << shift
                shift += PIECES[k][1]
        index = _Index(rest, shift)
        if index.candidates() <= most * n:
            out = [_is_close(p, d, i, j) for i, j in index.meetings()]
        else:
            for k, quarter in enumerate(QUARTERS):
                out += [_first(*_is_close(p, d, i, j), p, _quarter_agrees, k) for i, j in _Index(_bits(p, *quarter), 16).meetings()]
    i, j = (np.concatenate([x[s] for x in out]) if out else np.empty(0, np.int64) for s in (0, 1))
    i, j = _first(i, j, d, _piece_agrees, piece)
    return (i, j) if part is None else _first(i, j, p, _part_agrees, part)
