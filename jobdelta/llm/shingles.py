"""Word shingles of whole texts as sorted sets of 64-bit hashes, worked out on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from jobdelta.llm.common import mixed

WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (without blanks, A-Z in lower case) of texts that lie one after the other in `data`,
    and where each text's words end (with a leading 0)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    inside = ~_BLANK[data]
    border = np.zeros(n + 1, dtype=bool)
    border[ends] = True
    before = np.r_[False, inside[:-1]] & ~border[:-1]
    after = np.r_[inside[1:], False] & ~border[1:]
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    # A word's hash is a polynomial in its bytes: the difference of two running sums, shifted to its own start.
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    h = (sums[stops] - sums[starts]) * powers(_INVERSE, n)[starts]
    return mixed(h + (stops - starts).astype(np.uint64) * _JOIN), np.searchsorted(starts, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    hashes, at = word_hashes(data, ends)
    out = []
    joined = np.zeros(0, dtype=np.uint64)
    if len(hashes) >= words:
        joined = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
        for k in range(words):
            joined = joined * _JOIN + hashes[k : k + len(joined)]
        joined = mixed(joined)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            s = np.sort(joined[a : b - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            h = np.asarray([b - a], dtype=np.uint64)
            for k in range(a, b):
                h = mixed(h * _JOIN + hashes[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
