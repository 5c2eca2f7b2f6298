"""Pre-token chunks, merge tables and rank-synchronous merging for byte-level BPE."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .ragged import FlatMap, distinct, sums, text_bytes

#: Lead bytes of the UTF-8 characters that Unicode counts as white space beyond ASCII (fixed values).
_SPACE_LEADS = np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True

#: Classes of bytes within a chunk; 0 leaves the chunk to the pattern.
_LETTER, _DIGIT, _MARK, _LINE, _SPACE = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.int8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = 0
_CLASS[0x0A] = _LINE
_CLASS[0x20] = _SPACE


def chunk_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts rows where a pre-token must begin: at a single space between two characters that are no white space.

    No alternative of the pre-token pattern runs over such a place or looks beyond it, so chunks can be split on their own.
    A character that might be white space keeps its neighbours together. Returns chunk offsets and row offsets into the chunks.
    """
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    lead = data[np.maximum(at - 2, 0)]
    third = data[np.maximum(at - 3, 0)]
    loose = _ASCII_SPACE[before] | ((before >= 0x80) & ((lead == 0xC2) | ((lead >= 0x80) & _SPACE_LEADS[third])))
    at = at[~(loose | _ASCII_SPACE[after] | _SPACE_LEADS[after])]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    cut[offsets] = True
    where = np.flatnonzero(cut)
    if where[-1] != n:
        where = np.append(where, n)
    return where, np.searchsorted(where, offsets)


def pretokens(chunks: pa.Array, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of chunks: codes of all pre-tokens in order, offsets of the chunks into them, bytes and offsets of the distinct ones.

    In a chunk of letters, digits and marks of ASCII and Latin-1 with no apostrophe, no space but a first one and no two white spaces together,
    pre-tokens are the runs of one class. The pattern itself splits every other chunk.
    """
    data, offsets = text_bytes(chunks)
    n = len(offsets) - 1
    if n == 0 or len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    latin = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    odd = kind == 0
    odd |= (kind == _SPACE) & ~first
    white = kind >= _LINE
    odd[1:] |= white[1:] & white[:-1] & ~first[1:]
    hard = sums(odd, offsets) > 0
    opens = first.copy()
    opens[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    opens &= ~np.repeat(hard, np.diff(offsets))
    starts = np.flatnonzero(opens)
    owner = np.searchsorted(offsets, starts, "right") - 1
    found: list[str] = []
    sizes = np.bincount(owner, minlength=n)
    rows = np.flatnonzero(hard)
    for row, text in zip(rows.tolist(), chunks.take(pa.array(rows)).cast(pa.large_string()).to_pylist(), strict=True):
        own = pattern.findall(text)
        sizes[row] = len(own)
        found += own
    easy = ~np.repeat(hard, np.diff(offsets))
    kept = np.concatenate([[0], np.cumsum(easy, dtype=np.int64)])
    more, more_ends = bytes_of([x.encode() for x in found])
    ends = np.concatenate([kept[starts], kept[-1] + more_ends])
    codes, strings = distinct(np.concatenate([data[easy], more]), ends)
    into = np.concatenate([[0], np.cumsum(sizes)])
    order = np.empty(len(codes), np.int64)
    at_hard = np.repeat(hard, sizes)
    order[~at_hard] = codes[: len(starts)]
    order[at_hard] = codes[len(starts) :]
    return order, into, *text_bytes(strings)


@lru_cache(maxsize=4)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary file: printable Latin-1 stands for itself, the rest follow U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge rules: symbol ids of single bytes, and for a pair of ids its rank and the id it becomes."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, ids: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        self.pairs = FlatMap(self.key(left, right), ranks)
        self.by_rank = np.zeros(int(ranks.max(initial=0)) + 1, np.int32)
        self.by_rank[ranks] = ids

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _ranks(self, left: np.ndarray, right: np.ndarray, none: np.int32) -> np.ndarray:
        got = self.pairs.get(self.key(left, right))
        got[got < 0] = none
        return got

    def apply(self, symbols: np.ndarray, offsets: np.ndarray, ban: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merges every sequence to its end, all sequences in step.

        Each round looks up the ranks of all adjacent pairs, takes each sequence's lowest, and merges all its places from the left.
        ``ban`` names for each sequence a rank that it may not use. Returns the surviving symbols and the offsets of the sequences.
        """
        lengths = np.diff(offsets)
        final: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owner = np.flatnonzero(lengths)
        none = np.int32(2**31 - 1)
        sizes = lengths[owner]
        live = symbols.astype(np.int32)
        rank = np.full(len(live), none, np.int32)
        rank[:-1] = self._ranks(live[:-1], live[1:], none)
        rank[np.cumsum(sizes) - 1] = none
        while len(owner):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            if ban is not None:
                rank[rank == np.repeat(ban[owner], sizes)] = none
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == none
            if over.any():
                done = np.repeat(over, sizes)
                final.append((owner[over], sizes[over], live[done]))
                live, rank = live[~done], rank[~done]
                owner, lowest, sizes = owner[~over], lowest[~over], sizes[~over]
                if not len(owner):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            live[hit] = self.by_rank[rank[hit]]
            keep = np.ones(len(live), bool)
            keep[hit + 1] = False
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, hit, "right")
            sizes = sizes - np.bincount(row, minlength=len(owner))
            shift = hit - np.arange(len(hit))
            live, rank = live[keep], rank[keep]
            ends = np.cumsum(sizes) - 1
            new = ends[row] != shift
            rank[shift] = none
            at = shift[new]
            rank[at] = self._ranks(live[at], live[at + 1], none)
            first = np.concatenate([[0], ends[:-1] + 1])
            at = shift[first[row] != shift] - 1
            rank[at] = self._ranks(live[at], live[at + 1], none)
        size = np.zeros(len(lengths), np.int64)
        for who, n, _ in final:
            size[who] = n
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(ends[-1]), np.int32)
        for who, n, what in final:
            at = np.repeat(ends[who] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(what))
            out[at] = what
        return out, ends


@lru_cache(maxsize=4)
def json_merges(path: str) -> tuple[Merges, tuple[str, ...]]:
    """The merge rules of a byte-level ``tokenizers`` file, and its special strings, longest first."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, letters = whole["model"]["vocab"], _byte_letters()
    byte_ids = np.zeros(256, np.int32)
    for letter, b in letters.items():
        byte_ids[b] = vocab[letter]
    rules = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in whole["model"]["merges"]]
    left, right, made = (np.asarray([vocab[x] for x in part], np.int64) for part in ([a for a, _ in rules], [b for _, b in rules], [a + b for a, b in rules]))
    special = sorted((x["content"] for x in whole.get("added_tokens", [])), key=len, reverse=True)
    return Merges(byte_ids, left, right, np.arange(len(rules)), made), tuple(special)


@lru_cache(maxsize=4)
def ranked_tokens(path: str) -> dict[bytes, int]:
    """The tokens of a ``tiktoken`` file and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def bytes_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings back to back, and their offsets."""
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))]).astype(np.int64)


__all__ = ["Merges", "bytes_of", "chunk_offsets", "compiled", "distinct", "json_merges", "pretokens", "ranked_tokens"]
