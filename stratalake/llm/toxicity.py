"""Toxicity by a classifier chain: linear models in sequence, each fed with the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .ragged import LOWER, hashes, pieces, text_bytes


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled documents that the models are fitted on, those with the least hash of their key. ``folds``: for out-of-fold
    probabilities. ``least_docs``: documents of the sample that a word needs. ``steps``, ``rate``, ``decay``: of the fit. ``cut``: probability from which a document is flagged."""

    sample: int = 8000
    folds: int = 3
    least_docs: int = 3
    steps: int = 120
    rate: float = 0.1
    decay: float = 1e-4
    cut: float = 0.5


#: Bytes that belong to no word: all of ASCII but letters.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of every text (runs of letters, A-Z in lower case), and the offsets of the texts."""
    data, offsets = text_bytes(column)
    letters, ends, rows = ragged.words(LOWER[data], offsets, _OUTSIDE)
    own = hashes(letters, ends)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort([own, doc])
    own, doc = own[order], doc[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    return own[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(rows) - 1))]).astype(np.int64)


@dataclass
class _Rows:
    """Sparse 0/1 rows: column numbers and row offsets."""

    columns: np.ndarray
    offsets: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return ragged.sums(weights[self.columns], self.offsets)

    def take(self, rows: np.ndarray) -> _Rows:
        return _Rows(*ragged.gather(self.columns, self.offsets, rows))


@dataclass
class Link:
    """One model of the chain: weights of words and of the earlier probabilities, and the bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: _Rows, earlier: np.ndarray) -> np.ndarray:
        z = rows.dot(self.words) + earlier @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: _Rows, earlier: np.ndarray, y: np.ndarray, width: int, settings: Settings) -> Link:
    """Logistic regression by Adam, on words scaled by the log ratio of their rates in the two classes."""
    n = len(y)
    doc = np.repeat(np.arange(n), np.diff(rows.offsets))
    rate = lambda mark: (np.bincount(rows.columns, mark[doc].astype(float), minlength=width) + 0.5) / (mark.sum() + 1)
    ratio = np.log(rate(y == 1) / rate(y == 0))
    if not 0 < y.sum() < n:
        return Link(np.zeros(width), np.zeros(earlier.shape[1]), 20.0 if n and y.all() else -20.0)
    theta = np.zeros(width + earlier.shape[1] + 1)
    theta[:width] = 0.5
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        z = rows.dot(theta[:width] * ratio) + earlier @ theta[width:-1] + theta[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.concatenate([np.bincount(rows.columns, gap[doc], minlength=width) * ratio, gap @ earlier, [gap.sum()]])
        slope[:-1] += settings.decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Link(theta[:width] * ratio, theta[width:-1], float(theta[-1]))


@dataclass
class Chain:
    """Words by sorted hash, and the models in order. Its size is bounded by the sample."""

    categories: list[str]
    keys: np.ndarray
    links: list[Link]

    def rows(self, own: np.ndarray, offsets: np.ndarray) -> _Rows:
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        known = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        return _Rows(at[known], np.concatenate([[0], np.cumsum(known)])[offsets])

    def predict(self, rows: _Rows) -> np.ndarray:
        out = np.zeros((len(rows.offsets) - 1, 0))
        for link in self.links:
            out = np.column_stack([out, link.predict(rows, out)])
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> Chain:
    """Fits the chain in the order of ``categories``, 0/1 columns of ``labels``, on a bounded sample of labelled documents.

    Later models learn from out-of-fold probabilities of the earlier ones, so they see errors as they will meet them. Labels with a null key
    or a null category are left out, of repeated keys the largest label counts; of several texts under one key the one of the least hash is
    learned from, so the driver gets at most ``sample`` sets of words. Labels without a document, and null texts, teach nothing.
    """
    marks = labels.select(labels[key].alias("key"), *[labels[c].cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    marks = marks.groupBy("key").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    chosen = marks.orderBy(F.xxhash64("key"), "key").limit(settings.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            own, offsets = word_sets(batch.column("text"))
            made = pa.array([own[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), made, batch.column("ys")], ["key", "hash", "words", "ys"])

    # The sample is bounded by its parameter, so broadcasting its keys and labels is too.
    learned = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text is not null").join(F.broadcast(chosen), "key")
    ys = F.array(*[f"y{i}" for i in range(len(categories))]).alias("ys")
    kind = docs.schema[key].dataType.simpleString()
    sets = learned.select("key", F.xxhash64("text").alias("hash"), "text", ys).mapInArrow(run, f"key {kind}, hash long, words binary, ys array<int>")
    table = sets.groupBy("key").agg(F.min_by(F.struct("words", "ys"), "hash").alias("x")).select("x.words", "x.ys").toArrow()
    parts = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    y = np.array(table.column("ys").to_pylist(), np.int64).reshape(len(parts), len(categories))
    order = sorted(range(len(parts)), key=lambda i: (parts[i].tobytes(), y[i].tolist()))
    parts, y = [parts[i] for i in order], y[order]
    keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    chain = Chain(categories, keys[n >= settings.least_docs], [])
    rows = chain.rows(np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64))
    fold = np.random.default_rng(5).permutation(len(parts)) % settings.folds
    earlier = np.zeros((len(parts), 0))
    for i in range(len(categories)):
        held = np.zeros(len(parts))
        for k in range(settings.folds):
            out, into = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(out):
                held[out] = _train(rows.take(into), earlier[into], y[into, i], len(chain.keys), settings).predict(rows.take(out), earlier[out])
        chain.links.append(_train(rows, earlier, y[:, i], len(chain.keys), settings))
        earlier = np.column_stack([earlier, held])
    return chain


def predict(docs: DataFrame, chain: Chain, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, a probability ``p_<category>`` and a flag ``is_<category>`` for each category, for every whole text.

    A text without letters (null and empty ones too) has probability 0 and no flag; repeated rows are judged each; an empty table gives no
    rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text"):
            own, offsets = word_sets(batch.column("text"))
            p = model.predict(model.rows(own, offsets))
            p[np.diff(offsets) == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, p.T), *map(pa.array, (p >= settings.cut).T)], ["key", *names])

    kinds = ", ".join(f"{n} {'double' if n.startswith('p_') else 'boolean'}" for n in names)
    given = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return given.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {kinds}").withColumnRenamed("key", key)
