"""Removal of word runs that stand earlier in the corpus: compressed FM-indexes per shard report where streamed segments match."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .lm_score import Filter, by_region
from .ragged import mix, pieces, text_bytes, words
from .shared import stash
from .shingles import rolling, word_hashes

_BASE = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 2**64))
_NO_ID = 2**63 - 1
#: Bytes of text that are cut into segments at a time.
_SLICE = 2 << 20


@dataclass(frozen=True)
class Settings:
    """``window``: words of a repeat. ``anchor``: words of the anchors that deal windows to shards. ``shard``: segments of an index.
    ``crowd``: distinct segments of one anchor beyond which they are dealt anew by a second anchor of each window; where that is crowded too,
    windows are matched by key. ``filter_bytes``: most that a filter may hold;
    without it nothing is left out early and the result is the same. ``region_bytes``: text for a region of anchors."""

    window: int = 20
    anchor: int = 8
    shard: int = 4_000
    crowd: int = 4_000
    filter_bytes: int = 128 << 20
    region_bytes: int = 16 << 20


def segments(own: np.ndarray, rows: np.ndarray, settings: Settings, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of windows of a text that share an anchor: text number, first and last window, hash of the anchor and of the run's words.

    The anchor of a window is its least anchor hash, the first of equal ones, so equal windows have equal anchors and lie in one shard.
    """
    w, q = settings.window, settings.anchor
    n = len(own)
    counts = np.maximum(np.diff(rows) - w + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + rows[:-1][doc]
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = rolling(own, q)
    if salt:
        grams = mix(grams ^ np.uint64(salt))
    span = w - q + 1
    least, have = grams, 1
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n - span + 1], least[span - have : n - have + 1])
    low = least[start]
    where = np.full(len(doc), -1, np.int64)
    for j in range(span):
        at = (where < 0) & (grams[start + j] == low)
        where[at] = start[at] + j
    opens = np.ones(len(doc), bool)
    opens[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1
    a, b = start[first], start[last] + w
    power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
    back = np.cumprod(np.full(n + 1, _BACK, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:n])])
    content = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    base = rows[:-1][doc[first]]
    return doc[first], a - base, start[last] - base, low[first], content


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _packed(keys: np.ndarray, regions: int, names: list[str]) -> pa.RecordBatch:
    """Distinct keys by region, with whether each came more than once."""
    keys, n = np.unique(keys, return_counts=True)
    rows = [(region, keys[own].tobytes(), np.minimum(n[own], 2).astype(np.uint8).tobytes()) for region, own in by_region(keys, regions)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], names)


def _filter_of(packed: DataFrame, regions: int, least: int, settings: Settings) -> Broadcast | None:
    """A broadcast Bloom filter of the keys that come ``least`` times or more, or None where it would be larger than its bound."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint8)
        own, inverse = np.unique(keys, return_inverse=True)
        own = own[np.bincount(inverse, n, minlength=len(own)) >= least]
        return pa.table({"region": [key[0].as_py()], "bits": [Filter.build(own, np.ones(len(own), np.int64), 4, 10) if len(own) else b""]}, pa.schema([("region", pa.int32()), ("bits", pa.binary())]))

    made = stash(packed.groupBy("region").applyInArrow(build, "region int, bits binary"))
    size = made.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size > settings.filter_bytes:
        return None
    rows = made.where(F.octet_length("bits") > 0).toArrow()
    return packed.sparkSession.sparkContext.broadcast(Filter(regions, 4, dict(zip(rows.column("region").to_pylist(), rows.column("bits").to_pylist(), strict=True))))


def _place_key(ids: np.ndarray, digests: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + digests.astype(np.uint64)) + low.astype(np.uint64))


def _repeated_anchors(docs: DataFrame, settings: Settings) -> Broadcast | None:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    regions = max(16, -(-size // settings.region_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _SLICE):
            yield _packed(segments(*word_hashes(batch.column("text"), lower=False), settings)[3], regions, ["region", "keys", "n"])

    return _filter_of(docs.select("text").mapInArrow(run, "region int, keys binary, n binary"), regions, 2, settings)


def _segments(docs: DataFrame, settings: Settings, anchors: Broadcast | None, places: Broadcast | None, content: bool) -> DataFrame:
    """Segments whose anchor, or whose place, a filter may hold; ``content`` adds the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _SLICE):
            own, rows = word_hashes(batch.column("text"), lower=False)
            doc, low, high, anchor, hashed = segments(own, rows, settings)
            ids, digests = _ids(batch.column("id"))[doc], batch.column("d").to_numpy()[doc]
            keep = np.ones(len(doc), bool)
            if anchors is not None:
                keep &= anchors.value.level(anchor, 2) > 0
            if places is not None:
                keep &= places.value.level(_place_key(ids, digests, low), 2) > 0
            doc, low, high, anchor, hashed, ids, digests = (x[keep] for x in (doc, low, high, anchor, hashed, ids, digests))
            columns = [pa.array(anchor.view(np.int64)), pa.array(hashed.view(np.int64)), pa.array(ids), pa.array(digests), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            if content:
                a, b = rows[:-1][doc] + low, rows[:-1][doc] + high + settings.window
                columns.append(pa.array([own[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["m", "c", "id", "d", "low", "high", "words"][: len(columns)])

    return docs.mapInArrow(run, "m long, c long, id long, d long, low int, high int" + ", words binary" * content)


def _match(table: pa.Table, settings: Settings) -> pa.Table:
    """Runs of windows of a shard's segments that start earlier, by an index over the segments in order of place."""
    w = settings.window
    ids, digests, low = table.column("id").to_numpy(), table.column("d").to_numpy(), table.column("low").to_numpy()
    order = np.lexsort([low, digests, ids])
    raw = table.column("words").to_pylist()
    parts = [np.frombuffer(raw[i], np.uint64) for i in order]
    ids, digests, low = ids[order], digests[order], low[order].astype(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    _, code = np.unique(np.concatenate(parts), return_inverse=True)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    place = np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)
    text[place] = code + 1
    index = FMIndex(text, int(code.max()) + 2, w)
    windows = sizes - w + 1
    seg = np.repeat(np.arange(len(sizes)), windows)
    start = begin[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    length, lo, hi = index.matching(text, start + w - 1, w)
    full = np.flatnonzero(length == w)
    early = index.earliest(lo[full], hi[full])
    own = start[full]
    other = np.searchsorted(begin, early, "right") - 1
    # One place may come twice where repeated rows have one key; a window is no repeat of itself.
    later = (early < own) & ((ids[other] != ids[seg[full]]) | (digests[other] != digests[seg[full]]) | (low[other] + early - begin[other] != low[seg[full]] + own - begin[seg[full]]))
    hit = full[later]
    where, who, which = low[seg[hit]] + start[hit] - begin[seg[hit]], ids[seg[hit]], digests[seg[hit]]
    opens = np.ones(len(hit), bool)
    opens[1:] = (who[1:] != who[:-1]) | (which[1:] != which[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    return pa.table({"id": pa.array(who[first], pa.int64()), "d": pa.array(which[first], pa.int64()), "a": pa.array(where[first].astype(np.int32)), "b": pa.array((where[last] + w).astype(np.int32))})


def _dealt_anew(contents: DataFrame, settings: Settings) -> DataFrame:
    """Segments of crowded anchors, cut where a second anchor of their windows changes: ``m`` of both anchors, ``id, d, low, words``. Equal windows have equal second anchors."""
    w = settings.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 2 << 20):
            raw = batch.column("words").to_pylist()
            rows = np.cumsum([0, *(len(x) // 8 for x in raw)])
            own = np.frombuffer(b"".join(raw), np.uint64)
            doc, low, high, anchor, _ = segments(own, rows, settings, 0x7C8D3B1F5E6A9D24)
            m = mix(batch.column("m").to_numpy().astype(np.uint64)[doc] * _BASE + anchor)
            cut = [own[i:j].tobytes() for i, j in zip((rows[doc] + low).tolist(), (rows[doc] + high + w).tolist(), strict=True)]
            ids, digests, start = (batch.column(c).to_numpy()[doc] for c in ("id", "d", "low"))
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(ids), pa.array(digests), pa.array((start + low).astype(np.int32)), pa.array(cut, pa.binary())], ["m", "id", "d", "low", "words"])

    return contents.select("m", "id", "d", "low", "words").mapInArrow(run, "m long, id long, d long, low int, words binary")


def _crowded(contents: DataFrame, settings: Settings) -> DataFrame:
    """The same for anchors with a crowd of distinct segments: windows are keyed one by one, and each key's first place comes from a partial aggregate."""
    w = settings.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            if not raw:
                continue
            n = np.fromiter((len(x) - w + 1 for x in raw), np.int64, len(raw))
            keys = np.concatenate([rolling(x, w)[: len(x) - w + 1] for x in raw])
            at = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(batch.column("low").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), n)), pa.array(np.repeat(batch.column("d").to_numpy(), n)), pa.array(at.astype(np.int32))], ["k", "id", "d", "a"])

    keyed = contents.select("id", "d", "low", "words").mapInArrow(run, "k long, id long, d long, a int")
    first = keyed.groupBy("k").agg(F.min(F.struct("id", "d", "a")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "f")
    return keyed.join(first, "k").where("id <> f.id or d <> f.d or a <> f.a").select("id", "d", "a", (F.col("a") + w).alias("b"))


def repeats(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Word intervals ``id, d, a, b`` (b excluded) whose windows stand earlier: at a smaller key, at a smaller digest ``d`` of the text under the same key, or earlier in the same document. A null key counts as the largest."""
    docs = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("d"), docs[text].alias("text"))
    anchors = _repeated_anchors(docs, settings)
    own = stash(_segments(docs, settings, anchors, None, False))
    first = stash(own.groupBy("m", "c").agg(F.min(F.struct("id", "d", "low", "high")).alias("f"), F.count(F.lit(1)).alias("n")))
    copies = own.join(first.where("n > 1").select("m", "c", "f"), ["m", "c"]).where("id <> f.id or d <> f.d or low <> f.low").select("id", "d", F.col("low").alias("a"), (F.col("high") + settings.window).alias("b"))
    kinds = first.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    need = stash(first.join(kinds, "m").select("m", "f.id", "f.d", "f.low", "k"))
    total, crowds = need.agg(F.count(F.lit(1)), F.count_if(F.col("k") > settings.crowd)).first()
    out = copies
    if total:
        regions = max(16, -(-total // 200_000))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _packed(_place_key(batch.column("id").to_numpy(), batch.column("d").to_numpy(), batch.column("low").to_numpy().astype(np.int64)), regions, ["region", "keys", "n"])

        held = _filter_of(need.select("id", "d", "low").mapInArrow(places, "region int, keys binary, n binary"), regions, 1, settings)
        contents = _segments(docs, settings, anchors, held, True).join(need.select("m", "id", "d", "low", "k"), ["m", "id", "d", "low"])
        shards = max(1, -(-total // settings.shard))
        calm = contents.select("m", "id", "d", "low", "words", "k")
        if crowds:
            calm, anew = calm.where(F.col("k") <= settings.crowd), stash(_dealt_anew(calm.where(F.col("k") > settings.crowd), settings))
            still = stash(anew.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > settings.crowd).select("m"))
            out = out.unionByName(_crowded(anew.join(still, "m", "left_semi"), settings))
            calm = calm.drop("k").unionByName(anew.join(still, "m", "left_anti").select("m", "id", "d", "low", "words"))
        dealt = calm.select(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"), "id", "d", "low", "words")
        out = out.unionByName(dealt.groupBy("shard").applyInArrow(lambda table: _match(table, settings), "id long, d long, a int, b int"))
    return out


def deduplicate(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id", carry: str | None = None) -> DataFrame:
    """``key, n_words, n_removed, kept`` of every document; ``kept`` are the words left, joined by one space.

    A word goes if a window of ``window`` words covers it whose words also start earlier, at a smaller key or earlier in the same document.
    Texts of fewer words, null and empty texts lose nothing (kept is then their words, or empty). Repeated rows of one text under one key are one document:
    neither is the earlier; other texts under one key, or under the null key, are documents of their own, in order of a hash of the text. Null
    keys count as the largest key. With ``carry`` the rows have that column in place of the key, and ``kept`` is the text as it is where
    nothing goes. An empty table gives no rows; other columns are not read.

    Windows are dealt to shards by their anchor, the least hash of a few of their words. Anchors that stand once can't repeat and are left out by a
    filter. Equal segments fold into the first of them, with partial aggregates; the distinct ones of a shard are indexed, and each is streamed
    against the index for its matching statistics. Segments of an anchor with a crowd are dealt anew by a second anchor.
    """
    given = docs.select(docs[carry or key].alias("key"), docs[text].alias("text"), F.coalesce(docs[key].cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(docs[text]).alias("d"))
    found = stash(repeats(docs, settings, text=text, key=key))
    spans = found.distinct().groupBy("id", "d").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _SLICE):
            data, offsets = text_bytes(batch.column("text"))
            letters, ends, rows = words(data, offsets)
            gone = np.zeros(len(ends), np.int32)
            for i, own in enumerate(batch.column("spans").to_pylist()):
                if own:
                    a, b = np.array([(x["a"], x["b"]) for x in own]).T.clip(0, rows[i + 1] - rows[i]) + rows[i]
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n, lost = np.diff(rows), np.diff(np.concatenate([[0], np.cumsum(gone)])[rows])
            size = np.diff(ends)
            stay = ~gone
            out = np.full(int((size[stay] + 1).sum()), 0x20, np.uint8)
            mine = np.repeat(stay, size)
            at = np.arange(int(mine.sum())) + np.repeat(np.arange(int(stay.sum())), size[stay])
            out[at] = letters[mine]
            starts = np.concatenate([[0], np.cumsum(np.where(stay, size + 1, 0))])[rows]
            kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            if carry:
                kept = pc.if_else(pa.array(lost > 0), kept, batch.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), kept], ["key", "n_words", "n_removed", "kept"])

    joined = given.join(spans, ["id", "d"], "left").select("key", "text", "spans")
    return joined.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, n_words long, n_removed long, kept string").withColumnRenamed("key", carry or key)


__all__ = ["Settings", "deduplicate", "repeats", "segments"]
