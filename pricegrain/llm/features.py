"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def fold_table(letters_only: bool = False) -> np.ndarray:
    """A-Z to lower case, white space to a space; with letters_only every other ASCII byte that is no letter too."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[9, 10, 11, 12, 13]] = 32
    if letters_only:
        out[[c for c in range(128) if not chr(c).isalpha()]] = 32
    return out


def grams(data: np.ndarray, at: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: it, a 64-bit hash of the n-gram that begins at each byte, and where each text's n-grams begin and end.

    The k-th text's n-grams of size n are hashes[at[k] : max(at[k], at[k + 1] - n + 1)]; others cross into the next text.
    """
    hashes = data.astype(np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(data) < n:
                return
            hashes = hashes[:-1] * _STEP + data[n - 1 :]
        if n in sizes:
            mixed = (hashes + np.uint64(n)) * _MIX
            yield n, mixed ^ (mixed >> np.uint64(29)), np.stack([at[:-1], np.maximum(at[:-1], at[1:] - n + 1)], 1)
