"""Similarity join of texts by Jaccard over word shingles: a MinHash LSH forest finds candidates, exact set arithmetic verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ragged import mix, pieces
from .shared import stash
from .shingles import shingles

_WHOLE = 1 << 12


@dataclass(frozen=True)
class Settings:
    """``size``, ``threshold``: words of a shingle and least Jaccard similarity. ``trees``: tries of the forest; ``depth``, ``shortest``: hashes of
    their longest and shortest prefixes. ``recall``: of pairs right at the threshold. ``crowd``: texts under a prefix from which on it is
    shortened only where the recall needs it. ``block``, ``block_bytes``: most texts, and most bytes of shingles, that one task compares with
    as many others. ``broadcast_rows``: most texts whose digests are broadcast (32 bytes each); more are joined by a shuffle."""

    size: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 5
    shortest: int = 3
    recall: float = 0.999
    crowd: int = 64
    block: int = 2048
    block_bytes: int = 32 << 20
    broadcast_rows: int = 1_000_000

    def width(self, depth: int) -> int:
        """Bytes of a prefix: 8 for the shortest, 4 for each further hash."""
        return 8 + 4 * (depth - self.shortest)


def missed(similarity: float, depths: np.ndarray) -> np.ndarray:
    """Chance that two sets share none of the prefixes that a text is matched by, from their depths by tree."""
    return np.prod(1 - similarity ** np.asarray(depths, float), axis=-1)


def matched_depths(sizes: np.ndarray, settings: Settings) -> np.ndarray:
    """The depth by which each text is matched in each tree: prefixes start at full length and lose a hash, one tree after another, until the
    recall of a pair at the threshold is reached.

    ``sizes[text, tree, i]`` are the texts under its prefix of ``shortest + i`` hashes, 0 where they are no crowd. First the prefixes are
    shortened that don't become crowded, level by level in order of the trees; then, where the recall needs it, crowded ones, small crowds first.
    The order heeds crowds only, not whether a prefix has a match, so the recall holds for every pair.
    """
    n, trees, _ = sizes.shape
    levels = np.arange(settings.depth - 1, settings.shortest - 1, -1)
    # One step takes one tree to one level.
    size = np.concatenate([sizes[:, :, d - settings.shortest] for d in levels], 1).astype(np.int64)
    level = np.repeat(np.arange(len(levels)), trees)
    tree = np.tile(np.arange(trees), len(levels))
    rank = np.lexsort([np.broadcast_to(tree, size.shape), size, np.broadcast_to(level, size.shape), size > 0], axis=1)
    logs = {d: np.log(1 - settings.threshold**d) for d in range(settings.shortest, settings.depth + 1)}
    gain = np.concatenate([np.full(trees, logs[d + 1] - logs[d]) for d in levels]) if len(levels) else np.zeros(0)
    reached = -trees * logs[settings.depth] + np.cumsum(gain[rank], 1) - gain[rank]
    taken = reached < -np.log(1 - settings.recall) - 1e-12
    depths = np.full((n, trees), settings.depth)
    row = np.repeat(np.arange(n), taken.sum(1))
    np.subtract.at(depths, (row, tree[rank[taken]]), 1)
    return depths


def signatures(column: pa.Array, settings: Settings) -> pa.Array:
    """The path of every text through all tries: MinHash values, hashed so that equal prefixes of a path are equal bytes. Null for texts without words."""
    sets, rows = shingles(column, settings.size)
    full = np.flatnonzero(np.diff(rows))
    wide = settings.width(settings.depth)
    out = np.zeros((len(full), settings.trees, wide), np.uint8)
    rng = np.random.default_rng(97)
    for tree in range(settings.trees):
        path = np.full(len(full), tree, np.uint64)
        for level in range(1, settings.depth + 1):
            a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
            if len(full):
                path = mix(path * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat((sets ^ b) * (a | np.uint64(1)), rows[:-1][full]))
            if level >= settings.shortest:
                piece = path.astype(">u8").view(np.uint8).reshape(-1, 8)
                end = settings.width(level)
                out[:, tree, end - (8 if level == settings.shortest else 4) : end] = piece if level == settings.shortest else piece[:, :4]
    made = np.full(len(rows) - 1, None, object)
    made[full] = [x.tobytes() for x in out.reshape(len(full), settings.trees * wide)]
    return pa.array(made, pa.binary())


def _signed(texts: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            size = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("id"), size, signatures(batch.column("text"), settings)], ["digest", "id", "bytes", "paths"])

    return texts.mapInArrow(run, f"digest string, id {texts.schema['id'].dataType.simpleString()}, bytes long, paths binary")


def _candidates(texts: DataFrame, settings: Settings) -> DataFrame:
    """Edges ``a, b`` from each text to the first under each prefix that it is matched by, or that another text is.

    A text whose prefixes are no crowds is matched at the same depths as all such texts. The others stand under their prefixes of all depths, so
    that whoever shortens a prefix to one of them finds them there.
    """
    wide, longest, shortest = settings.width(settings.depth), settings.depth, settings.shortest
    tree_of = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(settings.trees - 1)), lambda t: F.substring("paths", t * wide + 1, F.lit(wide)))).alias("tree", "path")
    legs = texts.where("paths is not null").select("digest", tree_of)
    prefix = lambda d: F.substring("path", 1, settings.width(d))
    plain = matched_depths(np.zeros((1, settings.trees, longest - shortest), np.int64), settings)[0].tolist()
    own = F.substring("path", F.lit(1), F.element_at(F.array(*[F.lit(settings.width(d)) for d in plain]), F.col("tree") + 1))
    # Crowds under the shortest prefix hold those under longer ones.
    crowds, inside = [], legs
    for d in range(shortest, longest):
        crowd = stash(inside.groupBy("tree", prefix(d).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > settings.crowd))
        inside = stash(legs.withColumn("prefix", prefix(d)).join(crowd, ["tree", "prefix"]).select("digest", "tree", "path", F.lit(d).alias("depth"), "n"))
        crowds.append(inside)
    held = crowds[0]
    for more in crowds[1:]:
        held = held.unionByName(more)
    by_text = held.groupBy("digest").agg(F.collect_list(F.struct("tree", "depth", "n")).alias("crowds"))  # at most trees x depths entries

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("crowds")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            tree, depth, n = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.zeros((batch.num_rows, settings.trees, longest - shortest), np.int64)
            sizes[row, tree, depth - shortest] = n
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(matched_depths(sizes, settings).tolist(), pa.list_(pa.int32()))], ["digest", "depths"])

    chosen = stash(by_text.mapInArrow(choose, "digest string, depths array<int>"))
    near = F.broadcast(chosen) if chosen.count() <= settings.broadcast_rows // 4 else chosen
    at = F.element_at("depths", F.col("tree") + 1)
    all_ = F.array(*[F.struct(prefix(d).alias("prefix"), (at == d).alias("matched")) for d in range(shortest, longest + 1)])
    stands = F.when(F.col("depths").isNull(), F.array(F.struct(own.alias("prefix"), F.lit(True).alias("matched")))).otherwise(all_)
    nodes = legs.join(near, "digest", "left").select("digest", "tree", F.explode(stands).alias("x")).select("digest", "tree", "x.prefix", "x.matched")
    heads = nodes.groupBy("tree", "prefix").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n"), F.max("matched").alias("any")).where("n > 1 and any").select("tree", "prefix", "head")
    return nodes.join(heads, ["tree", "prefix"]).where("digest <> head").select(F.col("digest").alias("a"), F.col("head").alias("b")).distinct()


def _sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """Sorted distinct shingles of every text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets, rows = shingles(batch.column("text"), settings.size)
            own = [np.unique(sets[a:b]).tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("digest"), batch.column("copies"), pa.array(own, pa.binary())], ["part", "digest", "copies", "sets"])

    return texts.select("part", "digest", "copies", "text").mapInArrow(run, "part string, digest string, copies long, sets binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that at least two sets have, some columns at a time."""
    both = left if right is None else left + right
    sizes = np.fromiter(map(len, both), np.int64, len(both))
    values, code, n = np.unique(np.concatenate(both) if both else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    often = n > 1
    keep = often[code]
    row, column = row[keep], (np.cumsum(often) - 1)[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    m = len(left)
    out = np.zeros((m, m if right is None else len(right)), np.float32)
    width = _WHOLE
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(both), min(width, int(often.sum()) - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        out += part[:m] @ (part if right is None else part[m:]).T
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest row of the connected part of every row of a symmetric adjacency matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(table: pa.Table, settings: Settings, low: int, high: int) -> tuple[list, list, list]:
    """Texts with a link, their numbers of linked documents, and the first text of their part, for two blocks of one group (or one block with itself)."""
    digest, block = table.column("digest").to_pylist(), table.column("block").to_numpy()
    copies = table.column("copies").to_numpy()
    raw = table.column("sets").to_pylist()
    _, first = np.unique(np.array(digest, object).astype(str), return_index=True)
    own = first[block[first] == low]
    other = first[block[first] == high] if low != high else own
    if not len(own) or not len(other):
        return [], [], []
    sets = lambda rows: [np.frombuffer(raw[i], np.uint64) for i in rows]
    a, b = sets(own), sets(other)
    shared = _shared(a, None if low == high else b)
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    near = (shared > 0) & (shared >= settings.threshold * (na[:, None] + nb[None, :] - shared) - 1e-9)
    if low == high:
        np.fill_diagonal(near, False)
        links, root, rows = near @ copies[own], _roots(near), own
    else:
        m = len(own)
        links = np.concatenate([near @ copies[other], near.T @ copies[own]])
        whole = np.zeros((m + len(other),) * 2, bool)
        whole[:m, m:], whole[m:, :m] = near, near.T
        root, rows = _roots(whole), np.concatenate([own, other])
    have = np.flatnonzero(links)
    return [digest[rows[i]] for i in have], links[have].tolist(), [digest[rows[root[i]]] for i in have]


def similarity_classes(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: ``key, class_id, n_links, n_copies``.

    ``n_links`` counts the other documents with Jaccard similarity of at least the threshold, copies of the same text among them; ``n_copies``
    the documents of the same text, itself among them; ``class_id`` is the smallest key in its class, the connected part over the links.
    Texts of fewer words than a shingle have one shingle of them all. A null text is linked to nothing (its class is itself); empty texts and
    texts without words are linked to their copies only; a null key does not name a class while another key does; repeated rows are copies;
    an empty table gives no rows; other columns are not read.

    Copies fold into one text first. Every text has a path through each trie of the forest; it is matched by prefixes of its paths, which start at
    full length and are shortened, crowded ones last, until a pair at the threshold is found with the target recall. Texts under a prefix point at
    the first of them, and the connected parts of these pointers are the candidate groups. A group is compared exactly, all its pairs once, in blocks of
    bounded size that lie in tasks of their own; pairs are counted there and never leave the task, only counts and a spanning forest do.
    """
    given = _given(docs, text, key)
    own = _classes(given, settings)
    names = own.groupBy("component").agg(F.min("first").alias("class_id"))
    own = own.join(names, "component").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = given.select("id", "digest").join(own, "digest", "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def representatives(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, digest`` of the document that stands for each class: the smallest key, a null key after all others, then the smallest digest. Null texts are not in it."""
    own = _classes(_given(docs, text, key), settings)
    best = own.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "digest")).alias("best"))
    return best.select(F.col("best.first").alias("id"), F.col("best.digest").alias("digest"))


def _given(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].alias("id"), docs[text].alias("text"), F.md5(docs[text].cast("binary")).alias("digest"))


def _classes(given: DataFrame, settings: Settings) -> DataFrame:
    """``component, digest, copies, first, links`` of every distinct text."""
    filled = given.where("digest is not null")
    texts = stash(_signed(filled, settings).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.any_value("bytes").alias("bytes"), F.any_value("paths").alias("paths")))
    edges = _candidates(texts, settings)
    parts = connected_components(edges)
    parts = stash(parts.join(texts, parts.node == texts.digest).select(F.col("component").alias("part"), "digest", "copies", "first", "bytes"))
    found = _verify(filled, parts, settings)
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    return texts.select("digest", "copies", "first").join(classes, F.col("digest") == F.col("node"), "left").withColumn("component", F.coalesce("component", "digest")).join(links, "digest", "left").drop("node")


def _verify(filled: DataFrame, parts: DataFrame, settings: Settings) -> DataFrame:
    """``digest, links, root`` of texts with links, from all pairs within the candidate groups."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    total, weight = parts.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # A word of 5 bytes or so makes a shingle of 8: twice the bytes of a text bound those of its shingles, but for texts of tiny words.
    heavy = settings.block_bytes // 2
    packs = max(1, -(-2 * total // settings.block), -(-2 * (weight or 0) // heavy))
    blocks = F.greatest(F.ceil(F.col("n") / settings.block), F.ceil(F.col("b") / heavy)).cast("int")
    placed = stash(parts.join(sizes, "part").withColumn("blocks", F.least(blocks, F.col("n").cast("int"))).drop("b", "bytes"))
    wanted = F.broadcast(placed) if total <= settings.broadcast_rows else placed
    one = filled.join(wanted, "digest").where(F.col("id").eqNullSafe(F.col("first")))
    made = _sets(one, settings).join(placed.select(F.col("digest").alias("d"), "blocks"), F.col("digest") == F.col("d")).drop("d")
    made = made.withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("digest"), F.col("blocks"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = made.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.withColumn("task", F.when(F.col("blocks") == 1, F.concat(F.lit("pack "), F.pmod(F.xxhash64("part"), F.lit(packs)).cast("string"))).otherwise(F.col("part")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        digest, links, root = [], [], []
        group = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1 or low != high:
                a, b, c = _compare(table.take(pa.array(rows)), settings, low, high)
                digest, links, root = digest + a, links + b, root + c
        return pa.table({"digest": pa.array(digest, pa.string()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.string())})

    slim = dealt.select("task", "low", "high", "part", "digest", "copies", "block", "sets")
    return stash(slim.groupBy("task", "low", "high").applyInArrow(run, "digest string, links long, root string"))
