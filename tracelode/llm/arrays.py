"""Texts as flat arrays of code points, so that whole batches are processed by numpy at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
#: Odd constants of the 64-bit finaliser (public: murmur3) and of the polynomial.
MIX_A, MIX_B, BASE = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * MIX_A
        h ^= h >> U64(33)
        h *= MIX_B
        h ^= h >> U64(33)
    return h


def points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def bundles(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Runs of neighbouring texts of about `most` characters; a longer text stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-character windows of the array, by doubling; len(cp) - n + 1 values."""
    if len(cp) < n:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        have, level, power = 0, cp.astype(U64) + U64(1), BASE
        out, rest, width = None, n, 1
        total = len(cp) - n + 1
        while rest:
            if rest & 1:
                part = level[have : have + total]
                out = part.copy() if out is None else out * power + part
                have += width
            rest >>= 1
            if rest:
                level = level[:-width] * power + level[width:]
                power = power * power
                width *= 2
    return mix(out)
