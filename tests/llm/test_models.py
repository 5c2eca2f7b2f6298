"""Language, toxicity and n-gram models on small corpora."""

import collections
import math
import random
import re

import numpy as np
import pytest

from stratalake.llm import lm_score, toxicity
from stratalake.llm.language_id import _viterbi, fit, identify

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=60):
    r = random.Random(1)
    words = {"en": ["the", "thing", "that", "with", "other"], "fr": ["être", "que", "mieux", "pour", "dans"], "el": ["καλό", "λόγος", "μέρα"]}
    return [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(5, 40))), lang) for i in range(n) for lang in [["en", "fr", "el"][i % 3]]]


def test_language(spark, docs, texts, empty):
    rows = corpus()
    train = spark.createDataFrame([*rows, (900, "nothing", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = fit(train)
    assert model.languages == ["el", "en", "fr"]
    got = {r["doc_id"]: r for r in identify(train, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[901]["lang_pred"] == "und"
    mixed = spark.createDataFrame([(1, "the thing that with other the thing que pour dans mieux être que pour"), (2, "λόγος the thing that"), (3, "Привет мир"), (4, "12 %%"), (5, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in identify(mixed, model, spans=True).collect()}
    assert [(s["lang"], s["start"], s["stop"]) for s in out[1]["spans"]] == [("en", 0, 7), ("fr", 7, 14)] and 0.5 <= out[1]["score"] < 0.7
    assert [s["lang"] for s in out[2]["spans"]] == ["el", "en"]
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["spans"] == [] for i in (4, 5))
    assert out[3]["lang_pred"] in model.languages and out[3]["score"] == 0 and [(x["start"], x["stop"]) for x in out[3]["spans"]] == [(0, 2)]
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert len(got) == len(texts) and all(got[i]["lang_pred"] == "und" for i, t in texts if t is None or not any(c.isalpha() for c in t))
    nothing = fit(empty)
    assert nothing.languages == [] and {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(empty, model).count() == 0


def test_viterbi_is_best_path():
    rng = np.random.default_rng(2)
    for n in (1, 2, 6):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 3
        path = _viterbi(s, np.array([0, n]), 2.0)
        cost = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(cost(p) for p in np.ndindex(*[3] * n))
        assert math.isclose(cost(path), best, rel_tol=1e-5)
    many = rng.normal(size=(50, 300)).astype(np.float32)
    many[:, 250] += 50
    assert (_viterbi(many, np.array([0, 20, 50]), 2.0) == 250).all()


def plain_label(text, model):
    """Language and share of letters by a Viterbi search word by word, over n-grams counted one by one."""
    from stratalake.llm.language_id import _script_of
    from stratalake.llm.ragged import mix

    script, mask = _script_of(), model.settings.dimension - 1
    words = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)):
        letters = [ord(x) for x in w if script[ord(x)]]
        if not letters:
            continue
        kinds = [int(script[x]) for x in letters]
        padded, total = [0, *letters, 0], np.zeros(len(model.languages))
        for i in range(len(padded)):
            for n in (1, 2, 3):
                g = padded[i : i + n]
                if len(g) < n or (n == 1 and g == [0]):
                    continue
                h = g[0] * 0x9E3779B97F4A7C15 + (g[1] * 0xC2B2AE3D27D4EB4F + 1 if n > 1 else 0) + (g[2] * 0x165667B19E3779F9 + 1 if n > 2 else 0)
                total += model.weights[int(mix(np.array([h % 2**64], np.uint64))[0]) & mask]
        may = model.allowed[max(set(kinds), key=lambda k: (kinds.count(k), -k))]
        if may.any():
            words.append((len(letters), np.where(may, total, total.min() - 30)))
    best = [(0.0, [])] * len(model.languages)
    for i, (_, v) in enumerate(words):
        top = max(range(len(best)), key=lambda k: best[k][0])
        moved = [best[k] if not i or best[k][0] >= best[top][0] - model.settings.penalty else (best[top][0] - model.settings.penalty, best[top][1]) for k in range(len(best))]
        best = [(c + v[k], [*path, k]) for k, (c, path) in enumerate(moved)]
    path = max(best, key=lambda x: x[0])[1]
    share = np.bincount(path, [n for n, _ in words], len(model.languages))
    return model.languages[share.argmax()], share.max() / share.sum()


def test_labels_against_brute_force(spark):
    model = fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    r = random.Random(9)
    pool = ["the", "thing", "être", "que", "mieux", "λόγος", "μέρα", "Thing!", "x9y", "42", "Привет", "unknown", "dans-le"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(1, 30))) + " the") for i in range(60)]
    got = {x["doc_id"]: x for x in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        lang, share = plain_label(t, model)
        assert (got[i]["lang_pred"], round(got[i]["score"], 9)) == (lang, round(share, 9)), t


def test_many_languages(spark):
    """More languages than a byte counts, and a bound that refuses instead of dropping some."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(98 + i % 7)} " * 6, f"l{i:03d}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from stratalake.llm.language_id import Settings

    got = {x["doc_id"]: x["lang_pred"] for x in identify(frame, fit(frame, Settings(dimension=1 << 12))).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9
    with pytest.raises(ValueError, match="more than 10 languages"):
        fit(frame, Settings(most_languages=10))


def test_toxicity(spark, docs, texts, empty):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        bad, junk = i % 6 == 0, i % 5 == 0
        w = [r.choice(["calm", "plain", "river", "stone", "tree", "cloud"]) for _ in range(30)] + ["idiot"] * bad + ["spam", "buy"] * junk
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(junk), int(bad)))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:200], (None, 1, 1), (5000, 1, 1), (250, None, 1)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit(train, labels, ["junk", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.predict(train, chain).collect()}
    assert all(got[i]["is_toxic"] == bool(t) and got[i]["is_junk"] == bool(j) for i, j, t in marks[200:])
    assert len(chain.links[1].earlier) == 1 and chain.links[0].earlier.size == 0
    out = {r["doc_id"]: r for r in toxicity.predict(docs, chain).collect()}
    assert len(out) == len(texts) and all(out[i]["p_toxic"] == 0 and not out[i]["is_toxic"] for i, t in texts if not t)
    assert toxicity.predict(empty, chain).count() == 0
    none = toxicity.fit(empty, labels, ["junk", "toxic"])
    assert toxicity.predict(train, none).where("is_toxic").count() == 0


def test_chain_against_plain_arithmetic(spark):
    """Probabilities equal those worked out word by word with the fitted weights, each category fed with the ones before; repeated keys are learned once."""
    from stratalake.llm.ragged import hashes

    r = random.Random(12)
    rows = [(i, " ".join(r.choice(["ant", "bee", "cat", "dog", "eel", "fox"]) for _ in range(r.randint(3, 12))) + " vile" * (i % 4 == 0)) for i in range(120)]
    rows += [(i, "other words for a key that comes twice") for i in range(40)]
    labels = [(i, int("bee" in t), int("vile" in t)) for i, t in rows[:120]]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int, b int")
    chain = toxicity.fit(frame, marks, ["a", "b"], toxicity.Settings(sample=100))
    number = {}
    for w in {x for _, t in rows for x in t.split()}:
        raw = np.frombuffer(w.encode(), np.uint8)
        h = hashes(raw, np.array([0, len(raw)]))[0]
        at = np.searchsorted(chain.keys, h)
        number[w] = at if at < len(chain.keys) and chain.keys[at] == h else None
    got = {(x["doc_id"], x["p_a"]): x["p_b"] for x in toxicity.predict(frame, chain).collect()}
    for i, t in rows:
        earlier = []
        for link in chain.links:
            z = link.bias + sum(link.words[number[w]] for w in set(t.split()) if number[w] is not None) + sum(p * w for p, w in zip(earlier, link.earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        key = min((k for k in got if k[0] == i), key=lambda k: abs(k[1] - earlier[0]))
        assert math.isclose(key[1], earlier[0], rel_tol=1e-9) and math.isclose(got[key], earlier[1], rel_tol=1e-9)


def brute(rows, train):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = collections.Counter(w for i, t in rows if i in train for w in split(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


def brute_scores(rows, train, prior):
    """Bigram scores from exact counts, rounded to the levels of the filter."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if i in train:
            w = split(t)
            c.update(w)
            two.update(zip([None, *w], w, strict=False))
    n, v = sum(c.values()), len(c)

    def one(h, w):
        k = two[h, w]
        kept = k if k < 2 else 1.4 * 2 ** math.floor(math.log2(k))
        return math.log10((min(kept, c[h], c[w]) + prior * (c[w] + 1) / (n + v + 1)) / (c[h] + prior))

    return [sum(one(h, x) for h, x in zip([None, *split(t)], split(t), strict=False)) for _, t in rows]


@pytest.mark.parametrize("bound", [256 << 20, 0])
def test_lm_scores(spark, docs, texts, empty, bound):
    settings = lm_score.Settings(broadcast_bytes=bound, region_bytes=4096, bits=40)
    train = {i for i, _ in texts if i % 3}
    model = lm_score.fit(docs.where("doc_id % 3 <> 0"), settings)
    got = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
    want = brute(texts, train)
    assert set(got) == set(want)
    for (i, (n, known, total, base)), score in zip(want.items(), brute_scores(texts, train, settings.prior), strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)
    assert sum(got[i]["score"] for i in train) > sum(got[i]["base_score"] for i in train)
    assert lm_score.score(empty, model).count() == 0


def test_lm_scores_of_repeated_keys(spark):
    """Rows under one key or the null key are scored each, alike with counts broadcast and in regions."""
    rows = [(k, t) for k in (1, 1, None, None, 2) for t in ("a b c d", "d c b a", "a b c d", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for bound in (256 << 20, 0):
        model = lm_score.fit(frame.where("doc_id = 2"), lm_score.Settings(broadcast_bytes=bound, region_bytes=8))
        out.append(sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 9)) for r in lm_score.score(frame, model).collect()))
    assert out[0] == out[1] and len(out[0]) == len(rows) and len({x[2] for x in out[0]}) == 3


def test_filter_keeps_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    level = rng.integers(1, 6, 5000)
    part = {r: lm_score.Filter.build(keys[lm_score.region_of(keys, 4) == r], level[lm_score.region_of(keys, 4) == r], 4, 8) for r in range(4)}
    f = lm_score.Filter(4, 4, part)
    read = f.level(keys)
    assert (read >= level).all() and (read == level).mean() > 0.95
    assert (f.level(rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.95


def test_no_training_text(spark, docs, empty):
    out = lm_score.score(docs, lm_score.fit(empty)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in out)


