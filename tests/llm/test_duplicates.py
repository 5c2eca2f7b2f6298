"""The similarity join and the removal of repeats against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from stratalake.llm.fm_index import FMIndex
from stratalake.llm.jaccard_join import Settings, matched_depths, missed, similarity_classes
from stratalake.llm.substring_dedup import Settings as Cut
from stratalake.llm.substring_dedup import deduplicate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 0))} or ({tuple(w)} if w else set())
    text, near = dict(rows), collections.defaultdict(set)
    for i in sets:
        for j in sets:
            if i != j and text[i] is not None and text[j] is not None and (text[i] == text[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))):
                near[i].add(j)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(near[i]))
    return out


def crowd(n, seed=5):
    """Near copies of one text, all of them different, and strangers."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = base.copy()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"e{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    return [*rows, *[(n + i, " ".join(f"s{r.randrange(3000)}" for _ in range(80))) for i in range(20)]]


@pytest.mark.parametrize(("block", "crowd_size"), [(2048, 64), (16, 3)])
def test_classes(spark, docs, texts, empty, block, crowd_size):
    settings = Settings(block=block, crowd=crowd_size)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similarity_classes(docs, settings).collect()}
    assert got == brute_classes(texts)
    if block == 16:
        rows = crowd(70)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
        assert got == brute_classes(rows)
        heavy = Settings(block_bytes=4096, broadcast_rows=0)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), heavy).collect()}
        assert got == brute_classes(rows)
    else:
        assert similarity_classes(empty, settings).count() == 0


def test_keys_of_classes(spark):
    """Null and repeated keys: each row has its text's class, and a null key names none that has another."""
    base = crowd(1)[0][1]
    near = base.replace("b7 ", "c7 ", 1)
    rows = [(None, base), (5, near), (5, "something else of other words"), (None, "alone here with no one near"), (5, base)]
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_copies"]) for r in got) == [(0, 0, 0, 1), (0, 5, 2, 2), (5, 5, 0, 1), (5, 5, 2, 1), (5, 5, 2, 2)]


def test_depths_reach_recall():
    """Prefixes are no shorter than the recall needs, and crowded ones are shortened last."""
    s = Settings()
    rng = np.random.default_rng(6)
    sizes = np.zeros((200, s.trees, s.depth - s.shortest), np.int64)
    sizes[1:, :, 0] = rng.choice([0, 0, 100, 5000], (199, s.trees))
    sizes[1:, :, 1] = np.where(rng.random((199, s.trees)) < 0.5, sizes[1:, :, 0] // 2, 0)
    depths = matched_depths(sizes, s)
    gone = missed(s.threshold, depths)
    assert (gone <= 1 - s.recall + 1e-12).all() and depths.min() >= s.shortest and depths.max() <= s.depth
    longer = depths.copy()
    longer[np.arange(200), depths.argmin(1)] += 1
    assert (missed(s.threshold, longer)[0] > 1 - s.recall).all()
    crowded = np.take_along_axis(sizes, np.minimum(depths - s.shortest, 1)[:, :, None], 2)[:, :, 0] * (depths < s.depth)
    free = (sizes[:, :, 0] == 0) & (depths > s.shortest)
    assert not ((crowded > 0).any(1) & free.any(1)).any()


def test_forest_finds_pairs_at_the_threshold(spark):
    """Pairs right above the threshold, also where many texts share their prefixes: the recall of the whole join."""
    r = random.Random(8)
    rows, pairs = [], []
    common = [f"c{i}" for i in range(120)]
    for k in range(300):
        words = [f"p{k}_{i}" for i in range(150)] if k % 2 else [*common[:100], *[f"q{k}_{i}" for i in range(50)]]
        edited = words.copy()
        for at in r.sample(range(8, 145, 8), 3):
            edited[at] = f"x{k}_{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    got = {x["doc_id"]: x["class_id"] for x in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), Settings(crowd=8)).collect()}
    want = brute_classes([x for x in rows if x[0] < 200])
    assert all(want[2 * k][1] >= 1 for k in range(100))
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 298


def brute_repeats(rows, size):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone[k : k + size] = [True] * size
            else:
                seen[g] = (i, k)
        out[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y))
    return out


@pytest.mark.parametrize(("crowded", "filtered"), [(4_000, 128 << 20), (2, 0), (9, 0)])
def test_repeats(spark, docs, texts, empty, crowded, filtered):
    settings = Cut(crowd=crowded, filter_bytes=filtered, shard=7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in deduplicate(docs, settings).collect()}
    assert got == brute_repeats(texts, 20)
    rows = crowd(40)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    assert got == brute_repeats(rows, 20)
    if crowded == 2:
        assert deduplicate(empty, settings).count() == 0
        twice = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
        assert sorted((r["doc_id"] is None, r["n_removed"]) for r in deduplicate(twice, settings).collect()) == [(False, 0), (False, 0), (True, 120)]


def test_fm_index_counts():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(1, 6, 300), [0], rng.integers(1, 6, 200), [0]])
    index = FMIndex(text, 6, 8)
    ends = np.arange(7, 300)
    length, low, high = index.matching(text, ends, 8)
    raw = text.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
        best = max((k for k in range(1, 9) if sum(raw[i : i + k] == raw[e - k + 1 : e + 1] for i in range(len(raw) - k + 1)) > 1), default=0)
        assert n == best
        if n:
            places = [i for i in range(len(raw) - n + 1) if raw[i : i + n] == raw[e - n + 1 : e + 1]]
            assert sorted(index.suffixes[a:b].tolist()) == places
    full = length == 8
    if full.any():
        assert (index.earliest(low[full], high[full]) <= ends[full] - 7).all()


@pytest.mark.parametrize(("crowded", "filtered"), [(40_000, 128 << 20), (2, 0)])
def test_repeats_under_one_key(spark, crowded, filtered):
    """Null and repeated keys with other texts: what one of them loses is not cut from the others, and windows at the same place in two of them are repeats."""
    word = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    shared, early = word("s", 30), word("e", 40)
    own = {n: word(n, 50) for n in "abcd"}
    rows = [(1, early), (None, early + " " + own["a"]), (None, own["b"]), (None, shared + " " + own["c"]), (None, shared + " " + own["d"]), (None, "short text"), (7, early), (7, word("f", 60)), (7, "tiny"), (8, word("g", 90))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["n_removed"], r["kept"]) for r in deduplicate(frame, Cut(crowd=crowded, filter_bytes=filtered, shard=7)).collect()]
    want = [(1, 0, early), (None, 40, own["a"]), (None, 0, own["b"]), (None, 0, "short text"), (7, 40, ""), (7, 0, word("f", 60)), (7, 0, "tiny"), (8, 0, word("g", 90))]
    place = lambda r: (r[0] is None, r[0] or 0, r[2])
    whole = [x for x in got if x not in want]
    assert sorted((x for x in got if x in want), key=place) == sorted(want, key=place)
    # One of the two texts that share a run, whichever has the smaller hash, keeps it.
    assert sorted(n for _, n, _ in whole) == [0, 30]
    assert {kept.removeprefix(shared + " ") for *_, kept in whole} == {own["c"], own["d"]} and all(key is None for key, *_ in whole)
