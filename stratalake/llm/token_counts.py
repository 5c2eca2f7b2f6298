"""Token counts of whole texts by rank-synchronous merging of ragged arrays (byte-level BPE, ``tokenizers`` files)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import chunk_offsets, compiled, distinct, json_merges, pretokens
from .ragged import pieces, sums, text_bytes

#: Pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split_special(column: pa.Array, special: tuple[str, ...]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, for each row its offsets into the parts, and its number of special tokens."""
    column = pc.fill_null(column, "")
    found = np.zeros(len(column), bool)
    for x in special:
        if x:
            found |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
    n = np.zeros(len(column), np.int64)
    if not found.any():
        return column, np.arange(len(column) + 1), n
    cut = compiled("|".join(map(regex.escape, special)))
    parts: list[str] = []
    ends = [0]
    for i, text in enumerate(column.to_pylist()):
        own = cut.split(text) if found[i] else [text]
        n[i] = len(own) - 1
        parts += own
        ends.append(len(parts))
    return pa.array(parts, column.type), np.asarray(ends), n


def count_tokens(column: pa.Array, path: str, pattern: str = PATTERN) -> np.ndarray:
    """Tokens of every text. All distinct pre-tokens are merged together, one lowest-rank pair of each a round."""
    merges, special = json_merges(path)
    parts, rows, extra = split_special(column, special)
    data, offsets = text_bytes(parts)
    cuts, into = chunk_offsets(data, offsets)
    codes, chunks = distinct(data, cuts)
    of_chunk, chunk_ends, letters, letter_ends = pretokens(chunks, compiled(pattern))
    _, ends = merges.apply(merges.byte_ids[letters], letter_ends)
    per_chunk = sums(np.diff(ends)[of_chunk], chunk_ends)
    return sums(per_chunk[codes], into[rows]) + extra


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", limit: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """Counts bytes and tokens of every whole text: ``key, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, present on every worker. Special strings inside a text
    count as one token each, as that library has it. A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an
    empty table gives no rows; other columns are not read. The work is one pass without a shuffle, in slices of bounded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n = count_tokens(batch.column("text"), vocabulary, pattern)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
