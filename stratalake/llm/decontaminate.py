"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash


@dataclass(frozen=True)
class Settings:
    """``size``, ``threshold``: words of a shingle and least weighted Jaccard similarity. ``radius``: Hamming distance within which every pair of
    fingerprints is found (sets at similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9). ``broadcast_rows``: most
    rows of a table that is broadcast (24 bytes each, and never text or lists); more are joined by a shuffle."""

    size: int = 5
    threshold: float = 0.8
    radius: int = 18
    broadcast_rows: int = 1_000_000


def _words(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda x: F.xxhash64(x))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none for fewer words."""
    n = F.size(words) - size
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), run)).otherwise(F.array().cast("array<long>"))


def _numbered(df: DataFrame) -> DataFrame:
    """``shingles`` as a set: each hash mixed with how many times it came before, so that sizes of intersections count multiplicities."""
    ordered = df.withColumn("shingles", F.sort_array("shingles"))
    return ordered.withColumn("shingles", F.transform("shingles", lambda x, i: F.xxhash64(x, i + 1 - F.array_position("shingles", x))))


def _fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set if more hashes have it than not."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda acc, x: acc + F.getbit(x, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks with their numbers: fingerprints within the radius agree on one at least."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return F.array(*parts)


def _similarity(left: Column, right: Column) -> Column:
    """Jaccard of two numbered sets, which is the weighted one of the lists: sum of the smaller by the sum of the larger multiplicities."""
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


def _printed(kinds: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of distinct ``n, shingles``, made once and kept: the sets, and their ``n, set, print, i, v`` by block."""
    sets = stash(_numbered(kinds).distinct())
    made = stash(sets.select("n", F.xxhash64("n", "shingles").alias("set"), _fingerprint(F.col("shingles")).alias("print")))
    blocks = made.select("n", "set", "print", F.explode_outer(_blocks(F.col("print"), radius)).alias("b")).select("n", "set", "print", F.col("b.i").alias("i"), F.col("b.v").alias("v"))
    return sets, blocks


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row for each document and item that it holds: ``key, item, word_start, n_words, similarity`` of the most similar window (ties: the first).

    A window is as many words as the item has, or the whole document if that is shorter. Words are runs of letters and digits in lower case.

    Windows without a shingle of an item have similarity 0 with it, so windows are set only where some item's shingle stands, at the place
    where it puts the item's start. Each window is fingerprinted; the fingerprints find the items to compare it with, those of its size within
    the radius, by the blocks that the two share; and exact weighted similarity verifies the pairs. A pair of fingerprints within the radius is
    never missed; a pair of texts right at the threshold lies within it 998 times in 1000. What the fingerprints buy is that a window is
    compared with the few items that resemble it, and not with all that share a phrase with it.

    Null and empty texts and items, and those of fewer words than a shingle, match nothing; repeated rows of a key give one row, a null key
    is a key of its own; rows of one key with other texts are its texts together; empty tables give no rows; other columns are not read.

    The texts are read twice: their shingles are looked up without the text at hand, then the windows of the texts that hold one are cut out.
    """
    size, sc = settings.size, docs.sparkSession.sparkContext
    own = items.select(items[item].alias("item"), _words(items[text]).alias("w")).repartition(max(sc.defaultParallelism, 1))
    own = stash(own.select("item", F.size("w").alias("n"), _shingles(F.col("w"), size).alias("shingles")).where(F.size("w") >= size))
    anchors = stash(own.select("n", F.posexplode("shingles").alias("offset", "sh")).distinct())
    item_sets, item_blocks = _printed(own.select("n", "shingles").distinct(), settings.radius)
    named = _numbered(own).select("item", F.xxhash64("n", "shingles").alias("item_set"))
    small = lambda df, rows: F.broadcast(df) if rows <= settings.broadcast_rows else df

    # Outer generators: for inner ones Catalyst would repeat the whole expression of the array in a filter at the scan.
    # A text is known by a hash here. Two texts of one hash only get each other's places to look at.
    given = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("d"), docs[text].alias("text"))
    hashed = given.select("d", _words(F.col("text")).alias("w")).select("d", F.size("w").alias("doc_words"), _shingles(F.col("w"), size).alias("all"))
    at = hashed.select("d", "doc_words", F.posexplode_outer("all").alias("pos", "sh")).join(small(anchors, anchors.count()), "sh")
    places = stash(at.select("d", "n", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("doc_words") - F.col("n"))).alias("start")).distinct())
    texts = places.select("d").distinct()
    held = given.where("text is not null").join(small(texts, texts.count()), "d", "left_semi").select("key", "d", _words(F.col("text")).alias("w"))
    whole = stash(held.select("key", "d", F.size("w").alias("doc_words"), _shingles(F.col("w"), size).alias("all")))
    cut = F.slice("all", F.col("start") + 1, F.least(F.col("n"), F.col("doc_words")) - size + 1)
    windows = stash(whole.join(places, "d").select("key", "n", "start", cut.alias("shingles")).where(F.size("shingles") > 0).distinct())

    # Equal windows of many documents are fingerprinted and verified once.
    sets, blocks = _printed(windows.select("n", "shingles").distinct(), settings.radius)
    right = item_blocks.select("n", "i", "v", F.col("set").alias("item_set"), F.col("print").alias("item_print"))
    near = blocks.join(small(right, right.count()), ["n", "i", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= settings.radius).select("set", "item_set").distinct()
    sets = sets.select(F.xxhash64("n", "shingles").alias("set"), F.col("shingles").alias("a"))
    item_sets = item_sets.select(F.xxhash64("n", "shingles").alias("item_set"), F.col("shingles").alias("b"))
    pairs = near.join(sets, "set").join(item_sets, "item_set").withColumn("similarity", _similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= settings.threshold)
    pairs = stash(pairs.select("set", "item_set", "similarity"))
    found = _numbered(windows).select("key", "n", "start", F.xxhash64("n", "shingles").alias("set")).join(pairs, "set").join(named, "item_set")
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), "n")).alias("best")
    out = found.groupBy("key", "item").agg(best)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), (-F.col("best.back")).alias("word_start"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity"))
