"""Words of many texts as 64-bit hashes, unchanged or in lower case, for texts in bounded lots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from timberline.llm.shingles import mix, word_powers

#: Bytes of text that are hashed at once; a longer text is a lot of its own.
LOT = 2_000_000


def alphabet(separators: np.ndarray, lower: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, value) of each byte; with ``lower``, A-Z have the values of a-z."""
    letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        letters[65:91] = letters[97:123]
    return separators, letters


def byte_mask(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in these ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words are what stands between blanks; their letters count as they are.
EXACT_WORDS = alphabet(byte_mask((9, 13), (32, 32)), lower=False, seed=35)


def hashes(buffer: np.ndarray, letters: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a byte string."""
    separator, value = letters
    edge = np.diff(np.concatenate(([True], separator[buffer], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = word_powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(value[buffer] * up[:-1], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def lots(texts: list[bytes], letters: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of all words, where each text's words begin and the last end)."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and (not part or size + len(texts[at + len(part)]) < LOT):
            part.append(texts[at + len(part)])
            size += len(part[-1]) + 1
        begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in part])))
        start, words = hashes(np.frombuffer(b"\n".join(part) + b"\n", np.uint8), letters)
        yield at, words, np.searchsorted(start, begins)
        at += len(part)


def utf8(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]
