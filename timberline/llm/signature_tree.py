"""Trees whose nodes hold OR-combined token bitmaps and size ranges, and their dual traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ARITY = 8
NARROWEST, WIDEST = 64, 1 << 17


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of at least two bits for each token, a power of two wide (within bounds)."""
    width = min(max(NARROWEST, 1 << int(2 * len(tokens) - 1).bit_length()), WIDEST)
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width: halves are OR-ed."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


@dataclass
class Level:
    """Nodes of one height: bitmaps, smallest and largest size, most tokens beyond the bits set."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    extra: np.ndarray


def tree(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the leaves to the root; rows are to be in the order of sizes."""
    levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1).astype(np.int64))]
    while len(levels[-1].low) > 1:
        below = levels[-1]
        cut = np.arange(0, len(below.low), ARITY)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.bits, cut, axis=0),
                np.minimum.reduceat(below.low, cut),
                np.maximum.reduceat(below.high, cut),
                np.maximum.reduceat(below.extra, cut),
            )
        )
    return levels


def may_hold(a: Level, i: np.ndarray, b: Level, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair of texts below the nodes may be similar: their sizes allow it, and the largest
    possible overlap, common bits and tokens beyond bits, reaches what the smallest sizes need."""
    fit = (100 * a.high[i] >= percent * b.low[j]) & (100 * b.high[j] >= percent * a.low[i])
    at = np.flatnonzero(fit)
    # A bounded number of words at once, however wide the bitmaps are.
    each = max(1, (1 << 21) // a.bits.shape[1])
    common = np.empty(len(at), np.int64)
    for k in range(0, len(at), each):
        part = at[k : k + each]
        common[k : k + each] = np.bitwise_count(a.bits[i[part]] & b.bits[j[part]]).sum(1)
    most = common + np.minimum(a.extra[i[at]], b.extra[j[at]])
    fit[at] = (100 + percent) * most >= percent * (a.low[i[at]] + b.low[j[at]])
    return fit


def traverse(a: list[Level], b: list[Level], percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that no pair of nodes above them rules out; i < j where both trees are one."""
    da, db = len(a) - 1, len(b) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = may_hold(a[da], i, b[db], j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or da == db == 0:
            if same:
                i, j = i[i < j], j[i < j]
            return i, j
        # Go down where the tree is higher, or in both.
        down_a, down_b = da >= db and da > 0, db >= da and db > 0
        step = np.arange(ARITY)
        if down_a:
            i = (i[:, None] * ARITY + step).ravel()
            j = np.repeat(j, ARITY)
            da -= 1
            real = i < len(a[da].low)
            i, j = i[real], j[real]
        if down_b:
            j = (j[:, None] * ARITY + step).ravel()
            i = np.repeat(i, ARITY)
            db -= 1
            real = j < len(b[db].low)
            i, j = i[real], j[real]
        if same:
            i, j = i[i <= j], j[i <= j]


def candidate_pairs(signatures: list[bytes], sizes: np.ndarray, percent: int, side: np.ndarray | None = None):
    """(i, j) rows that may be similar. ``side``: 0 or 1, only pairs across the two are wanted.

    One tree for each width of bitmaps, compared with all that are as wide or wider; sizes that don't
    allow similar texts end the comparison at the roots.
    """
    widths = np.fromiter(map(len, signatures), np.int64, len(signatures))
    groups = {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        bits = np.frombuffer(b"".join([signatures[r] for r in rows.tolist()]), np.uint64).reshape(len(rows), -1)
        for s in (None,) if side is None else (0, 1):
            of = rows if s is None else rows[side[rows] == s]
            if len(of):
                groups[w, s] = of, bits if s is None else bits[side[rows] == s], sizes[of]
    out = []
    for (w, s), (rows, bits, n) in groups.items():
        for (w2, s2), (rows2, bits2, n2) in groups.items():
            if w2 < w or (s is None and w2 == w and rows is not rows2) or (s is not None and s == s2):
                continue
            if s is not None and w == w2 and s > s2:
                continue
            same = rows is rows2
            own = tree(bits, n)
            i, j = traverse(own, own if same else tree(folded(bits2, w // 8), n2), percent, same)
            out.append(np.stack([rows[i], rows2[j]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)
