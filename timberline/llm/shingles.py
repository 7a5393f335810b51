"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

#: Word characters are all but these; A-Z count as lower case.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(max(n, 1 << 18), base, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the base and of its inverse."""
    return _POWERS.to(n)


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a byte string, by differences of one running sum."""
    blank = _BLANK[buffer]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.to(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_LETTER[buffer] * up[:-1], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], size: int = 5, at_once: int = 400_000) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text of fewer words has one."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        parts, length = [], 0
        while start < len(texts) and (not parts or length < at_once):
            parts.append(texts[start].encode("utf-8", "surrogatepass"))
            length += len(parts[-1]) + 1
            start += 1
        out += _sets(parts, size)
    return out


def _sets(parts: list[bytes], size: int) -> list[np.ndarray]:
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    at, words = word_hashes(np.frombuffer(b"\n".join(parts) + b"\n", np.uint8))
    first = np.searchsorted(at, begins)  # the first word of each text
    n = max(len(words) - size + 1, 0)
    shingles = words[:n]
    for k in range(1, size):
        shingles = mix(shingles) + words[k : k + n]
    shingles = mix(shingles)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole) + words[k : k + 1]
            out.append(mix(mix(whole) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum()) if len(a) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)
