"""Byte-level BPE encoding by prefix dynamic programming, and decoding (``tiktoken`` rank files)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, bytes_of, chunk_offsets, compiled, distinct, pretokens, ranked_tokens
from .ragged import _BYTE_CODE, FlatMap, gather, pieces, sums, text_bytes
from .token_counts import PATTERN

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BY_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Pre-tokens of more bytes are encoded one by one; the result is the same.
LONG = 48
#: Bytes of text that are encoded at a time.
_SLICE = 2 << 20
#: Tokens that are decoded at a time: the index of a gather takes many times the bytes that it fetches.
_BLOCK = 1 << 15


class Codec:
    """Tokens of a rank file, their last merges, and the test whether two tokens may stand side by side."""

    def __init__(self, path: str):
        ranks = ranked_tokens(path)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.bytes, self.offsets = bytes_of(tokens)
        lengths = np.diff(self.offsets)
        self.longest = int(lengths.max())
        self.sizes = sorted({int(n) for n in lengths if n})
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        pairs = Merges(byte_ids, np.array(left), np.array(right), np.array(made), np.array(made))
        parts, ends = pairs.apply(pairs.byte_ids[self.bytes], self.offsets, ban=np.arange(size))
        two = np.diff(ends) == 2
        #: Left and right part of a token's last merge; -1 for single bytes and for tokens that no merges reach.
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[two], self.right[two] = parts[ends[:-1][two]], parts[ends[:-1][two] + 1]
        #: Rank at which a token is made; -1 for single bytes.
        self.made = np.where(lengths == 1, -1, np.arange(size))
        self.reached = two | (lengths == 1)
        own = np.flatnonzero(two)
        self.pairs = FlatMap(Merges.key(self.left[own], self.right[own]), own)
        value = _BYTE_CODE[self.bytes] * np.cumprod(np.full(self.longest, _BASE, np.uint64))[np.arange(len(self.bytes)) - np.repeat(self.offsets[:-1], lengths)]
        full = np.flatnonzero(lengths)
        keys = np.add.reduceat(value, self.offsets[:-1][full]) + lengths[full].astype(np.uint64) * _BY_LENGTH
        self.by_hash = FlatMap(keys, full)
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the tokens a and b apart when they stand side by side, for arrays of pairs.

        Undoes the merges inside the pair, the latest first. The pair falls if the two symbols at the border would have merged
        before the merge last undone; among equal ranks the place to the left goes first.
        """
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        limit = np.full(len(a), 2**40)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(left):
            joint = self.pairs.get(Merges.key(a, b))
            bad = (joint >= 0) & (joint < limit)
            out[left[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            left, a, b, made_a, made_b = left[go], a[go], b[go], made_a[go], made_b[go]
            first = made_a > made_b
            limit = np.where(first, made_a, made_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _fit(self, a: int, b: int) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            got = self._fits[a, b] = bool(self.fits(np.array([a]), np.array([b]))[0])
        return got

    def last_token(self, text: bytes, end: int, last: list[int]) -> int:
        """The one token that may end the encoding of ``text[:end]``, from those of the shorter prefixes (``last[i]`` ends ``text[:i + 1]``)."""
        for size in self.sizes:
            if size > end:
                break
            token = self.ranks.get(text[end - size : end])
            if token is not None and self.reached[token] and (size == end or self._fit(last[end - size - 1], token)):
                return token
        raise AssertionError("single bytes are tokens, so some token fits")

    def walk(self, text: bytes, last: list[int]) -> list[int]:
        """The tokens of a text from the last tokens of its prefixes."""
        out, end = [], len(text)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pre-tokens, and their offsets. The prefixes of all pre-tokens grow in step, byte by byte."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        found: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        powers = np.cumprod(np.full(max(int(lengths.max(initial=1)), 1), _BASE, np.uint64))
        place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
        value = _BYTE_CODE[data] * powers[place]
        whole = np.full(n, -1, np.int64)
        full = np.flatnonzero(lengths)
        if len(full):
            whole[full] = self.by_hash.get(np.add.reduceat(value, offsets[:-1][full]) + lengths[full].astype(np.uint64) * _BY_LENGTH)
        done = np.flatnonzero(whole >= 0)
        found["whole"] = done, np.ones(len(done), np.int64), whole[done]
        long = np.flatnonzero((whole < 0) & (lengths > LONG))
        ids: list[int] = []
        counts = []
        for row in long.tolist():
            text, last = data[offsets[row] : offsets[row + 1]].tobytes(), []
            for end in range(1, len(text) + 1):
                last.append(self.last_token(text, end, last))
            own = self.walk(text, last)
            ids += own
            counts.append(len(own))
        found["long"] = long, np.array(counts, np.int64), np.array(ids, np.int64)
        rest = np.flatnonzero((whole < 0) & (lengths > 0) & (lengths <= LONG))
        rest = rest[np.argsort(-lengths[rest], kind="stable")]
        found["rest"] = self._step(data, offsets, rest)
        size = np.zeros(n, np.int64)
        for who, count, _ in found.values():
            size[who] = count
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(ends[-1]), np.uint32)
        for who, count, what in found.values():
            out[np.repeat(ends[who] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(len(what))] = what
        return out, ends

    def _step(self, data: np.ndarray, offsets: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens by falling length, so that those with a p-th byte come first; row p - 1 of ``last`` holds their last tokens at byte p."""
        if not len(rest):
            return rest, np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.diff(offsets)[rest]
        width = int(lengths[0])
        start = offsets[:-1][rest]
        alive = np.searchsorted(-lengths, -np.arange(1, width + 1), "right")
        total = np.zeros((width + 1, len(rest)), np.uint64)
        power, back = np.uint64(1), [np.uint64(1)]
        for p in range(width):
            k = alive[p]
            power = np.uint64((int(power) * int(_BASE)) % 2**64)
            total[p + 1, :k] = total[p, :k] + _BYTE_CODE[data[start[:k] + p]] * power
            back.append(np.uint64((int(back[-1]) * int(_BACK)) % 2**64))
        lengths_key = {size: np.uint64(size * int(_BY_LENGTH) % 2**64) for size in self.sizes}
        last = np.full((width + 1, len(rest)), -1, np.int32)
        for p in range(1, width + 1):
            open_ = np.arange(alive[p - 1])
            for size in reversed([s for s in self.sizes if s <= p]):
                if not len(open_):
                    break
                token = self.by_hash.get((total[p, open_] - total[p - size, open_]) * back[p - size] + lengths_key[size])
                may = np.flatnonzero(token >= 0)
                may = may[self.reached[token[may]]]
                if size < p and len(may):
                    may = may[self.fits(last[p - size, open_[may]], token[may])]
                if len(may):
                    last[p, open_[may]] = token[may]
                    stay = np.ones(len(open_), bool)
                    stay[may] = False
                    open_ = open_[stay]
        at, rows, tokens = lengths.copy(), np.arange(len(rest)), []
        owners = []
        token_lengths = np.diff(self.offsets)
        while len(rows):
            got = last[at[rows], rows]
            tokens.append(got)
            owners.append(rows)
            at[rows] -= token_lengths[got]
            rows = rows[at[rows] > 0]
        count = np.bincount(np.concatenate(owners), minlength=len(rest))
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (who, what) in enumerate(zip(owners, tokens, strict=True)):
            out[ends[who + 1] - 1 - k] = what
        return rest, count, out

    def encode(self, column: pa.Array, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of whole texts, each match of the pattern on its own, and the offsets of the texts."""
        data, offsets = text_bytes(column)
        cuts, into = chunk_offsets(data, offsets)
        codes, chunks = distinct(data, cuts)
        of_chunk, chunk_ends, letters, letter_ends = pretokens(chunks, compiled(pattern))
        ids, ends = self.encode_pretokens(letters, letter_ends)
        per_chunk, per_chunk_ends = gather(ids, ends, of_chunk)
        out, out_ends = gather(per_chunk, per_chunk_ends[chunk_ends], codes)
        return out, out_ends[into]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of token ids, and the offsets of the texts."""
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.diff(self.offsets)[ids], out=offsets[1:])
        data = np.empty(int(offsets[-1]), np.uint8)
        for i in range(0, len(ids), _BLOCK):
            part, _ = gather(self.bytes, self.offsets, ids[i : i + _BLOCK].astype(np.int64))
            data[offsets[i] : offsets[i] + len(part)] = part
        return data, offsets[ends]


class Prefixes:
    """The encoding of one pre-token that grows and changes: the last token of every prefix is kept, and only what an edit touches is done again."""

    def __init__(self, codec: Codec, text: bytes = b""):
        self.codec, self.text, self.last = codec, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; the prefixes so far stay as they are."""
        self.text += more
        for end in range(len(self.last) + 1, len(self.text) + 1):
            self.last.append(self.codec.last_token(self.text, end, self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of the bytes from start to stop, and returns how many prefixes were done again.

        Beyond the edit, once as many last tokens in a row as the longest token has bytes are those of before, all later ones are too.
        """
        old_last, shift = self.last, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        self.last = old_last[:start]
        same = done = 0
        for end in range(start + 1, len(self.text) + 1):
            token = self.codec.last_token(self.text, end, self.last)
            self.last.append(token)
            done += 1
            same = same + 1 if end > start + len(new) and old_last[end - shift - 1] == token else 0
            if same >= self.codec.longest:
                self.last += old_last[end - shift :]
                break
        return done

    def tokens(self) -> list[int]:
        return [self.codec.ranks[self.text]] if self.text in self.codec.ranks else self.codec.walk(self.text, self.last)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """Encodes every whole text and decodes it again: ``key, ids array<int>, decoded binary``.

    ``vocabulary`` is the path of a rank file, present on every worker. Special strings are ordinary text. A null or empty text has no ids
    and decodes to no bytes; repeated rows are encoded each; an empty table gives no rows; other columns are not read. One pass without a
    shuffle, in slices of bounded bytes; a text longer than a slice is a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in pieces(batches, "text", _SLICE):
            ids, ends = own.encode(batch.column("text"), pattern)
            data, data_ends = own.decode(ids, ends)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            back = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(data_ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, back], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """What `encode` gives, as ``key, n_tokens, ids_sha256, decoded_sha256``; ids are hashed as little-endian unsigned 32-bit integers. Edge cases as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in pieces(batches, "text", _SLICE):
            ids, ends = own.encode(batch.column("text"), pattern)
            data, data_ends = own.decode(ids, ends)
            ids = ids.astype("<u4")
            spans, data_spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), zip(data_ends[:-1].tolist(), data_ends[1:].tolist(), strict=True)
            of_ids = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans]
            of_data = [hashlib.sha256(data[a:b]).hexdigest() for a, b in data_spans]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(ends), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_data, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


__all__ = ["Codec", "Prefixes", "codec", "digests", "encode", "sums"]
