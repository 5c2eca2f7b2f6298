"""Language identification: script ranges narrow the candidates of a word, character n-grams score them, Viterbi labels the spans of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import LOWER, distinct, mix, pieces, text_bytes, words

#: Scripts and their Unicode ranges (fixed values); letters outside of them are of script "Other".
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)],
}
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``dimension``: hash buckets of n-grams (a power of two). ``penalty``: cost in nats of a change of language between two words.
    ``script_share``: least share of a language's letters for a script to be one of its own. ``smoothing``: added to every bucket's count.
    ``most_languages``: what the driver takes, 128 KB of weights each; more labels than that are refused with an error."""

    dimension: int = 1 << 15
    penalty: float = 12.0
    script_share: float = 0.01
    smoothing: float = 0.5
    most_languages: int = 1000


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """Script number of every code point: 0 for what is no letter, 1 for other letters."""
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for k, ranges in enumerate(SCRIPTS.values(), 2):
        for low, high in ranges:
            part = table[low : high + 1]
            part[part > 0] = k
    return table


N_SCRIPTS = len(SCRIPTS) + 2


@dataclass
class _Features:
    buckets: np.ndarray
    offsets: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    by_script: np.ndarray


def _features(strings: pa.Array, settings: Settings) -> _Features:
    """N-grams of one to three letters with word ends as letters, of distinct words, as hash buckets; letters and script of each word."""
    data, offsets = text_bytes(strings)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = heads[offsets]
    kind = _script_of()[points]
    n = len(ends) - 1
    row = np.repeat(np.arange(n), np.diff(ends))
    by_script = np.bincount(row * N_SCRIPTS + kind, minlength=n * N_SCRIPTS).reshape(n, N_SCRIPTS)
    by_script[:, 0] = 0
    letters = by_script.sum(1)
    own = kind > 0
    padded = np.zeros(int(letters.sum()) + 2 * n, np.uint64)
    padded_ends = np.concatenate([[0], np.cumsum(letters + 2)])
    at = np.ones(len(padded), bool)
    at[padded_ends[:-1]] = at[padded_ends[1:] - 1] = False
    padded[at] = points[own]
    size = len(padded)
    mask = np.uint64(settings.dimension - 1)
    one = padded * np.uint64(0x9E3779B97F4A7C15)
    two, three = one.copy(), one.copy()
    if size > 2:
        two[:-1] += padded[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        three[:-2] = two[:-2] + padded[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(1)
    place = np.arange(size) - np.repeat(padded_ends[:-1], letters + 2)
    left = np.repeat(letters + 2, letters + 2) - place
    keep = np.stack([(place > 0) & (left > 1), left > 1, left > 2], 1) & (np.repeat(letters, letters + 2) > 0)[:, None]
    buckets = (mix(np.stack([one, two, three], 1)) & mask).astype(np.int32)[keep]
    counts = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return _Features(buckets, counts[padded_ends], letters, by_script.argmax(1), by_script)


def _learn(docs: DataFrame, settings: Settings) -> DataFrame:
    """Counts of buckets and of letters by script for each language: ``lang, bucket, n``, at most dimension and scripts a language and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text", 4 << 20):
            data, offsets = text_bytes(batch.column("text"))
            letters, ends, rows = words(LOWER[data], offsets)
            codes, strings = distinct(letters, ends)
            own = _features(strings, settings)
            coded = batch.column("lang").dictionary_encode()
            of_word = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(rows))
            sizes = np.diff(own.offsets)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                n = np.bincount(codes[of_word == k], minlength=len(sizes))
                have = total.setdefault(name, np.zeros(settings.dimension + N_SCRIPTS))
                have[: settings.dimension] += np.bincount(own.buckets, np.repeat(n, sizes), minlength=settings.dimension)
                have[settings.dimension :] += n @ own.by_script
        for name, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at].astype(np.int64))], ["lang", "bucket", "n"])

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log-probabilities ``[bucket, language]`` and which languages a script may stand for. Its size is languages times dimension."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    settings: Settings


def fit(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", lang: str = "lang") -> Model:
    """Learns from all rows with a language; texts may be null. Without any such row no language is known."""
    counted = _learn(docs.where(docs[lang].isNotNull()).select(docs[text].alias("text"), docs[lang].alias("lang")), settings)

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(settings.dimension + N_SCRIPTS)
        counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        grams, scripts = counts[: settings.dimension], counts[settings.dimension :]
        weights = np.log((grams + settings.smoothing) / (grams.sum() + settings.smoothing * settings.dimension)).astype(np.float32)
        allowed = scripts > settings.script_share * max(scripts.sum(), 1)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "weights": pa.array([weights.tobytes()], pa.binary()), "allowed": pa.array([allowed.tobytes()], pa.binary())})

    rows = counted.groupBy("lang").applyInArrow(weigh, "lang string, weights binary, allowed binary").orderBy("lang").limit(settings.most_languages + 1).toArrow()
    if rows.num_rows > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages")
    languages = rows.column("lang").to_pylist()
    if not languages:
        return Model([], np.zeros((settings.dimension, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), settings)
    unpack = lambda name, kind: np.stack([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()], 1)
    return Model(languages, np.ascontiguousarray(unpack("weights", np.float32)), np.ascontiguousarray(unpack("allowed", bool)), settings)


def _viterbi(scores: np.ndarray, rows: np.ndarray, penalty: float) -> np.ndarray:
    """The best path through the languages of every text; texts walk in step, long ones first so that those with a t-th word lie together."""
    lengths = np.diff(rows)
    n, kinds = len(scores), scores.shape[1]
    if n == 0 or kinds == 1:
        return np.zeros(n, np.int32)
    order = np.argsort(-lengths, kind="stable")
    order = order[: np.count_nonzero(lengths)]
    width = int(lengths[order[0]])
    alive = np.searchsorted(-lengths[order], -np.arange(1, width + 1), "right")
    base = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(order))
    t = np.arange(n) - np.repeat(rows[:-1], lengths)
    place = base[t] + np.repeat(rank, lengths)
    stepped = np.empty_like(scores)
    stepped[place] = scores
    moved = np.zeros((n, kinds), bool)
    source = np.zeros(n, np.int32)
    value = stepped[: alive[0]].copy()
    last = np.zeros((len(order), kinds), np.float32)
    for step in range(1, width):
        a, b, k = base[step], base[step + 1], alive[step]
        last[k : len(value)] = value[k:]
        value = value[:k]
        from_ = value.argmax(1)
        jump = value[np.arange(k), from_] - penalty
        other = value < jump[:, None]
        moved[a:b], source[a:b] = other, from_
        value = np.where(other, jump[:, None], value)
        value += stepped[a:b]
    last[: len(value)] = value
    path = np.zeros(n, np.int32)
    state = last.argmax(1)
    for step in range(width - 1, -1, -1):
        a, b, k = base[step], base[step + 1], alive[step]
        path[a:b] = own = state[:k]
        if step:
            state[:k] = np.where(moved[np.arange(a, b), own], source[a:b], own)
    return path[place]


def identify(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", spans: bool = False) -> DataFrame:
    """Labels whole texts: ``key, lang_pred, score`` and with ``spans`` also ``spans array<struct<start, stop, lang>>`` in words.

    ``lang_pred`` is the language with most letters in the labelled spans (ties: the first by name), ``score`` its share of all labelled
    letters. A text with letters, but only of scripts that no learned language uses, is one span of the language whose n-grams fit it best,
    with score 0. A null text, one without letters, and any text under a model without languages are `und` with score 0 and no spans;
    repeated rows and rows with a null key are labelled each; an empty table gives no rows; other columns are not read.
    A word without letters, or of a script that no language uses, belongs to the span around it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        kinds = len(own.languages)
        for batch in pieces(batches, "text", (16 << 20) // max(8, kinds)):  # scores of all words for all languages lie in memory
            n = batch.num_rows
            data, offsets = text_bytes(batch.column("text"))
            letters, ends, rows = words(LOWER[data], offsets)
            codes, strings = distinct(letters, ends)
            if not kinds or not len(codes):
                share, best, per, runs = np.zeros(n), np.full(n, kinds), np.zeros((n, max(kinds, 1))), [[] for _ in range(n)]
            else:
                has = _features(strings, own.settings)
                table = np.zeros((len(has.letters), kinds), np.float32)
                full = np.flatnonzero(np.diff(has.offsets))
                if len(full):
                    for k in range(kinds):
                        table[full, k] = np.add.reduceat(own.weights[has.buckets, k], has.offsets[:-1][full])
                raw, may = table, own.allowed[has.script]
                usable = (has.letters > 0) & may.any(1)
                low = table.min(1, keepdims=True) - 30
                table = np.where(may, table, low)
                table -= table.max(1, keepdims=True)
                live = usable[codes]
                into = np.concatenate([[0], np.cumsum(live)])[rows]
                word = codes[live]
                path = _viterbi(table[word], into, own.settings.penalty)
                weight = has.letters[word]
                doc = np.repeat(np.arange(n), np.diff(into))
                per = np.bincount(doc * kinds + path, weight, minlength=n * kinds).reshape(n, kinds)
                whole = per.sum(1)
                best = np.where(whole > 0, per.argmax(1), kinds)
                share = per.max(1) / np.maximum(whole, 1)
                runs = _runs(path, into, np.flatnonzero(live), rows, names) if spans else []
                for i in np.flatnonzero(whole == 0).tolist():
                    lettered = codes[rows[i] : rows[i + 1]]
                    lettered = lettered[has.letters[lettered] > 0]
                    if len(lettered):
                        best[i] = raw[lettered].sum(0).argmax()
                        if spans:
                            runs[i] = [{"start": 0, "stop": int(rows[i + 1] - rows[i]), "lang": names[best[i]]}]
            out = [batch.column("key"), pa.array(names[best], pa.string()), pa.array(share, pa.float64())]
            fields = ["key", "lang_pred", "score"]
            if spans:
                out.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(out, fields)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double" + ", spans array<struct<start:int,stop:int,lang:string>>" * spans
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def with_language(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of the documents and a struct ``label<lang_pred, score>`` (under a name that they don't have, which comes last), without a shuffle; labels and edge cases as `identify` has them."""
    name = "label"
    while name in docs.columns:
        name = f"_{name}"
    return identify(docs.withColumn(name, F.struct(*[docs[c] for c in docs.columns])), model, text=text, key=name).select(f"{name}.*", F.struct("lang_pred", "score").alias(name))


def _runs(path: np.ndarray, into: np.ndarray, at: np.ndarray, rows: np.ndarray, names: np.ndarray) -> list[list[dict]]:
    """Spans of one language, from the first word of a text to its last; words without a vote go with the span before them."""
    out = []
    for k in range(len(rows) - 1):
        own, where = path[into[k] : into[k + 1]], at[into[k] : into[k + 1]] - rows[k]
        if not len(own):
            out.append([])
            continue
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        opens = where[starts]
        opens[0] = 0
        closes = np.append(opens[1:], rows[k + 1] - rows[k])
        out.append([{"start": int(a), "stop": int(b), "lang": names[own[i]]} for a, b, i in zip(opens, closes, starts, strict=True)])
    return out


def held_out(key: str = "doc_id", modulus: int = 4, rest: int = 2):
    """Whether the crc32 of the key as text has the remainder that is held out; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == rest, F.lit(False))


__all__ = ["Model", "Settings", "fit", "held_out", "identify", "with_language"]
