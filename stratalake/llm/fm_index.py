"""An FM-index over words: packed wavelet matrix, rank by blocks, and backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with counts before every 64-bit block."""

    def __init__(self, bits: np.ndarray):
        pad = (-len(bits)) % 64 + 64
        self.words = np.packbits(np.concatenate([bits, np.zeros(pad, bool)]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class WaveletMatrix:
    """Symbols below 2**levels; ``rank(symbol, place)`` goes down one bit vector a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            zeros = int(len(bit) - np.count_nonzero(bit))
            self.levels.append((level, Bits(bit), zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before its two places."""
        begin = np.zeros(len(symbol), np.int64)
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b, c = bits.rank(begin), bits.rank(low), bits.rank(high)
            begin = np.where(one, zeros + a, begin - a)
            low = np.where(one, zeros + b, low - b)
            high = np.where(one, zeros + c, high - c)
        return low - begin, high - begin


class FMIndex:
    """Index of a text of symbols 1 to ``kinds - 1``, with 0 between its parts. Suffixes are sorted by their first ``depth`` symbols, which is enough for patterns of that length."""

    def __init__(self, text: np.ndarray, kinds: int, depth: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1 if n > span else 0
            _, rank = np.unique(rank * (n + kinds + 2) + after, return_inverse=True)
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        last = text[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.last = WaveletMatrix(last.astype(np.int64), max(1, int(kinds - 1).bit_length()))
        self.size = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        a, b = self.last.ranks(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b

    def matching(self, stream: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text, up to ``least``: for each end place the length to which it matches at two places or more, and the interval there.

        Walks back from all ends in step; an end leaves once its interval holds one place only, which is its own.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        left = np.arange(len(ends))
        for k in range(least):
            a, b = self.extend(stream[ends[left] - k], low[left], high[left])
            more = b - a > 1
            left = left[more]
            low[left], high[left], length[left] = a[more], b[more], k + 1
            if not len(left):
                break
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest text place of each interval; intervals are disjoint or equal."""
        if not len(low):
            return low
        own, at = np.unique(low, return_index=True)
        cuts = np.stack([own, high[at]], 1).ravel()
        least = np.minimum.reduceat(np.append(self.suffixes, np.int32(2**31 - 1)), cuts)[::2]
        return least[np.searchsorted(own, low)]
