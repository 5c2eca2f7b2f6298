"""Hashed word shingles of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .ragged import LOWER, hashes, mix, text_bytes, words

_STEP = np.uint64(0x9FB21C651E98DF25)


def word_hashes(column: pa.Array, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, A-Z in lower case unless told otherwise, and the offsets of the texts."""
    data, offsets = text_bytes(column)
    letters, ends, rows = words(LOWER[data] if lower else data, offsets)
    return hashes(letters, ends), rows


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on; the last ``size - 1`` places hold nothing of use."""
    total = np.zeros(len(values), np.uint64)
    for j in range(size):
        total *= _STEP
        total[: len(values) - j] += values[j:]
    return mix(total)


def shingles(column: pa.Array, size: int = 5, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the offsets of the texts. A text of fewer words, but one at least, has one shingle of them all."""
    own, rows = word_hashes(column, lower=lower)
    total = rolling(own, size)
    n = np.diff(rows)
    keep = np.ones(len(own), bool)
    for j in range(1, size):
        at = rows[1:] - j
        keep[at[(at >= rows[:-1]) & (n > 0)]] = False
    short = np.flatnonzero((n > 0) & (n < size))
    for row in short.tolist():
        value = np.uint64(n[row])
        for x in own[rows[row] : rows[row + 1]]:
            value = mix(np.array([(int(value) * int(_STEP) + int(x)) % 2**64], np.uint64))[0]
        total[rows[row]] = value
        keep[rows[row]] = True
    return total[keep], np.concatenate([[0], np.cumsum(keep)])[rows]
