"""Bigram scores of texts from a log-frequency Bloom filter of quantised n-gram counts, beside an exact unigram base."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import LOWER, hashes, mix, pieces, text_bytes, words
from .shared import stash

#: Hash of the token that ends a text; also the history of its first word.
END = np.uint64(0x7F4A7C159E3779B9)
_LOW40 = np.uint64((1 << 40) - 1)
_KEYS = 8 << 20


@dataclass(frozen=True)
class Settings:
    """``bits``: of the filter for each stored level. ``probes``: hash functions. ``region_bytes``: text for each region of the counts.
    ``broadcast_bytes``: most that the filter and the unigrams may hold together to be broadcast; every Python worker has a copy. Beyond it
    they stay in regions, and the texts' n-grams are sent there. ``prior``: unigram pseudo-counts that smooth the bigrams of a history."""

    bits: int = 8
    probes: int = 4
    region_bytes: int = 8 << 20
    broadcast_bytes: int = 256 << 20
    prior: float = 5.0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of every text (words with A-Z in lower case, then one end), those of their histories, and the offsets of the texts."""
    data, offsets = text_bytes(column)
    letters, ends, rows = words(LOWER[data], offsets)
    n = len(rows) - 1
    out = np.full(len(ends) - 1 + n, END, np.uint64)
    into = rows + np.arange(n + 1)
    at = np.ones(len(out), bool)
    at[into[1:] - 1] = False
    out[at] = hashes(letters, ends)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[into[:-1]] = END
    return out, before, into


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + now)


def region_of(keys: np.ndarray, regions: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(regions) >> np.uint64(32)).astype(np.int64)


def by_region(keys: np.ndarray, regions: int) -> Iterator[tuple[int, slice]]:
    """The regions that sorted keys lie in, with their places."""
    own = region_of(keys, regions)
    cut = np.concatenate([np.flatnonzero(np.diff(own, prepend=-1)), [len(own)]]) if len(own) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(own[a]), slice(a, b)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of powers of two: 1 is 1, 2 and 3 are 2, 4 to 7 are 3."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    level = level.astype(np.float64)
    return np.where(level <= 1, level, 1.4 * np.exp2(level - 1))


def _slots(keys: np.ndarray, level: int, probes: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit numbers of a key at a level, one array for each hash function."""
    x = mix((keys & _LOW40) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x51ED27))
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(probes):
        yield ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.asarray(bits, np.uint64)) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Log-frequency Bloom filter: a key of level q is stored as (key, 1) to (key, q), and read by probing 1, 2, ... to the first that is absent.

    It lies in regions by the upper bits of the key, each with bits for its own keys; a region that is not loaded holds nothing.
    """

    def __init__(self, regions: int, probes: int, parts: dict[int, bytes]):
        self.regions, self.probes = regions, probes
        self.bits, self.start = np.zeros(regions, np.int64), np.zeros(regions, np.int64)
        self.data = np.frombuffer(b"".join(parts.values()), np.uint8)
        at = 0
        for region, part in parts.items():
            self.bits[region], self.start[region] = len(part) * 8, at
            at += len(part)

    @staticmethod
    def build(keys: np.ndarray, level: np.ndarray, probes: int, bits: int) -> bytes:
        """The bits of one region."""
        size = -(-max(int(level.sum()) * bits, 64) // 64) * 8
        marks = np.zeros(size * 8, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            own = keys[level >= q]
            for at in _slots(own, q, probes, size * 8):
                marks[at] = True
        return np.packbits(marks, bitorder="little").tobytes()

    def level(self, keys: np.ndarray, most: int = 40) -> np.ndarray:
        region = region_of(keys, self.regions)
        bits, start = self.bits[region], self.start[region]
        out = np.zeros(len(keys), np.int8)
        left = np.flatnonzero(bits)
        for q in range(1, most):
            if not len(left):
                break
            set_ = np.ones(len(left), bool)
            for at in _slots(keys[left], q, self.probes, bits[left]):
                set_ &= ((self.data[start[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1) == 1
            left = left[set_]
            out[left] = q
        return out


@dataclass
class Unigrams:
    """Exact counts of all training tokens: sorted hashes and their counts."""

    keys: np.ndarray
    counts: np.ndarray

    def get(self, now: np.ndarray) -> np.ndarray:
        own, code = _coded(now)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        found = np.where(self.keys[at] == own, self.counts[at], 0) if len(self.keys) else np.zeros(len(own), np.int64)
        return found[code]


def _collect(docs: DataFrame, regions: int, settings: Settings) -> DataFrame:
    """Counts of all unigrams and the filter of all bigrams: ``kind, region, keys, counts, n``; keys and counts of unigrams, the bits of bigrams.

    Tasks send sorted distinct keys and counts of slices of text, packed by region; a region's parts are added up in one task. Regions grow
    in number with the text, so a region stays as it is; hot n-grams are one entry a slice.
    """

    def emit(kind: int, keys: np.ndarray) -> Iterator[tuple]:
        keys, n = np.unique(keys, return_counts=True)
        for region, own in by_region(keys, regions):
            if kind:
                low = np.ascontiguousarray(keys[own] & _LOW40).view(np.uint8).reshape(-1, 8)[:, :5]
                yield kind, region, np.ascontiguousarray(low).tobytes(), n[own].astype("<u4").tobytes()
            else:
                yield kind, region, keys[own].tobytes(), n[own].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _KEYS):
            now, before, _ = tokens(batch.column("text"))
            rows = [*emit(0, now), *emit(1, pair_keys(before, now))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "region", "keys", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        kind, region = key[0].as_py(), key[1].as_py()
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        raw = table.column("keys").to_pylist()
        if kind:
            wide = np.zeros((len(n), 8), np.uint8)
            wide[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
            keys = wide.view(np.uint64).ravel()
        else:
            keys = np.frombuffer(b"".join(raw), np.uint64)
        own, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, n, minlength=len(own)).astype(np.int64)
        if kind:
            made = Filter.build(own, levels(total), settings.probes, settings.bits), b""
        else:
            made = own.tobytes(), total.tobytes()
        return pa.table({"kind": pa.array([kind], pa.int32()), "region": pa.array([region], pa.int32()), "keys": pa.array([made[0]], pa.binary()), "counts": pa.array([made[1]], pa.binary()), "n": pa.array([int(total.sum())], pa.int64()), "v": pa.array([len(own)], pa.int64())})

    return docs.mapInArrow(run, "kind int, region int, keys binary, counts binary").groupBy("kind", "region").applyInArrow(add, "kind int, region int, keys binary, counts binary, n long, v long")


@dataclass
class Fitted:
    """A model whose counts lie in the shared folder as ``counts``, by kind and region."""

    counts: DataFrame
    regions: int
    train_tokens: int
    distinct: int
    bytes: int
    settings: Settings


def fit(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text") -> Fitted:
    """Counts all n-grams of all rows, in one pass."""
    docs = docs.select(docs[text].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    regions = max(16, -(-size // settings.region_bytes))
    counts = stash(_collect(docs, regions, settings))
    held = F.sum(F.octet_length("keys").cast("long") + F.octet_length("counts").cast("long"))
    n, v, held = counts.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.sum(F.when(F.col("kind") == 0, F.col("v"))), held).first()
    return Fitted(counts, regions, n or 0, v or 0, held or 0, settings)


def _value(model: tuple[int, int, float], c: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and smoothed probability of every token, from its count, that of its history, and the stored level of the two together."""
    train_tokens, distinct, prior = model
    base = (c + 1.0) / (train_tokens + 1 * (distinct + 1))
    both = np.minimum(count_of(level), np.minimum(h, c))
    return base, (both + prior * base) / (h + prior)


def _rows(model: tuple[int, int, float], into: np.ndarray, c: np.ndarray, h: np.ndarray, level: np.ndarray) -> list[pa.Array]:
    """The columns of every text of a slice."""
    base, value = _value(model, c, h, level)
    at = into[:-1]
    add = lambda x, kind: np.add.reduceat(x, at, dtype=kind) if len(at) else np.zeros(0, kind)
    return [*map(pa.array, (np.diff(into), add(c > 0, np.int64), np.full(len(at), model[0]), add(np.log10(base), np.float64), add(np.log10(value), np.float64)))]


_NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
_TYPES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the code of each."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: Fitted, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of whole texts, all logarithms of base 10.

    The base is exact: (c + 1) / (N + 1 * (V + 1)) a token. The score is that of the bigrams: (c(h w) + prior * base) / (c(h) + prior), where
    the history's count c(h) is exact and c(h w) is read from the filter by probing levels until one is absent, at most c(h) and c(w). A null
    or empty text has one token, the end; repeated rows and rows with a null key are scored each; an empty table gives no rows; a model of no
    texts gives every token the probability 1 of its one unseen kind; other columns are not read.

    Counts within a bound are broadcast, and one pass scores all texts. Beyond it, texts are dealt in slices, the distinct n-grams of a slice go
    to the regions that hold their counts, and the answers come back to the slice; both ways give the same rows.
    """
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    own = (model.train_tokens, model.distinct, model.settings.prior)
    out = _with_broadcast(docs, model, own) if model.bytes <= model.settings.broadcast_bytes else _with_regions(docs, model, own)
    return out.withColumnRenamed("key", key)


def _with_broadcast(docs: DataFrame, model: Fitted, own: tuple[int, int, float]) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    uni = model.counts.where("kind = 0").select("keys", "counts").toArrow()
    keys = np.frombuffer(b"".join(uni.column("keys").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(uni.column("counts").to_pylist()), np.int64)
    order = np.argsort(keys, kind="stable")
    bits = model.counts.where("kind = 1").select("region", "keys").toArrow()
    held = sc.broadcast((Unigrams(keys[order], counts[order]), Filter(model.regions, model.settings.probes, dict(zip(bits.column("region").to_pylist(), bits.column("keys").to_pylist(), strict=True)))))
    del uni, bits, keys, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, filt = held.value
        for batch in pieces(batches, "text", 4 << 20):
            now, before, into = tokens(batch.column("text"))
            # Each distinct token is looked up once; histories are tokens too.
            kinds, code = _coded(now)
            c = uni.get(kinds)[code]
            h = np.empty_like(c)
            h[1:] = c[:-1]
            h[into[:-1]] = uni.get(np.array([END], np.uint64))[0]
            pairs, place = _coded(pair_keys(before, now))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *_rows(own, into, c, h, filt.level(pairs)[place])], ["key", *_NAMES])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, {_TYPES}")


def _with_regions(docs: DataFrame, model: Fitted, own: tuple[int, int, float]) -> DataFrame:
    regions, probes, kind = model.regions, model.settings.probes, docs.schema["key"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            name = uuid.uuid4().bytes
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.binary()), batch.column("key"), batch.column("text")], ["slice", "key", "text"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("slice").dictionary_encode()
            for i, name in enumerate(names.dictionary.to_pylist()):
                mine = batch.filter(pa.compute.equal(names.indices, i))
                now, before, _ = tokens(mine.column("text"))
                rows = []
                for k, keys in ((0, np.unique(np.append(now, END))), (1, np.unique(pair_keys(before, now)))):
                    rows += [(k, region, name, keys[place].tobytes()) for region, place in by_region(keys, regions)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "region", "slice", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        k = left.column("kind")[0].as_py() if left.num_rows else 0
        raw = left.column("asked").to_pylist()
        keys = np.frombuffer(b"".join(raw), np.uint64)
        held = right.column("keys").to_pylist()
        if not held:
            found = np.zeros(len(keys), np.int64)
        elif k:
            found = Filter(1, probes, {0: held[0]}).level(keys).astype(np.int64)
        else:
            have, counts = np.frombuffer(held[0], np.uint64), np.frombuffer(right.column("counts")[0].as_py(), np.int64)
            found = Unigrams(have, counts).get(keys)
        cuts = np.cumsum([0, *(len(x) // 8 for x in raw)]).tolist()
        return pa.table({"slice": left.column("slice"), "kind": left.column("kind"), "asked": left.column("asked"), "found": pa.array([found[a:b].astype(np.int64).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        for k in (0, 1):
            part = right.filter(pa.compute.equal(right.column("kind"), k))
            keys, found = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("asked", np.uint64), ("found", np.int64)))
            order = np.argsort(keys, kind="stable")
            got.append(Unigrams(keys[order], found[order]))
        out = []
        for batch in left.combine_chunks().to_batches():
            now, before, into = tokens(batch.column("text"))
            out.append(pa.RecordBatch.from_arrays([batch.column("key"), *_rows(own, into, got[0].get(now), got[0].get(before), got[1].get(pair_keys(before, now)))], ["key", *_NAMES]))
        return pa.Table.from_batches(out)

    # Names of slices are random, so they are written once and read from there.
    dealt = stash(docs.mapInArrow(deal, f"slice binary, key {kind}, text string"))
    asked = dealt.select("slice", "text").mapInArrow(ask, "kind int, region int, slice binary, asked binary")
    # A slice's rows may have come apart in the table's files, so a key may be asked for twice; a lookup takes either answer.
    answered = asked.groupBy("kind", "region").cogroup(model.counts.groupBy("kind", "region")).applyInArrow(answer, "slice binary, kind int, asked binary, found binary")
    return dealt.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(finish, f"key {kind}, {_TYPES}")
