"""The stages in order, on the smallest data."""

import os

import pytest

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_names():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.selectExpr("*", "'x' as kept", "1 as n_words").limit(0).unionByName(docs.selectExpr("*", "'x' as kept", "1 as n_words"))
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    more = spark.createDataFrame([(10_000, None, None, "s", 0, "x", 1), (10_001, "123 !!", "en", "s", 6, "x", 1), (10_002, leak + " " + "the and of to is " * 3, "en", "s", 9, "x", 1)], extra.schema)
    at, seen = extra.unionByName(more).persist(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, DATA).persist()
        assert out.columns == at.columns, name
        seen.append({r["doc_id"] for r in out.select("doc_id").collect()})
        at = out
    assert not {10_000, 10_001} & seen[0] and 10_002 in seen[2] and 10_002 not in seen[3]
    assert len(seen[0]) > len(seen[1]) >= len(seen[2]) > len(seen[3]) > 100
    last = corpus_pipeline.encoded(spark, at, DATA)
    assert last.count() == len(seen[3])


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_rows_without_a_key_of_their_own(spark):
    """Null and repeated doc_ids: a row goes for what a stage says of its own text only."""
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").orderBy("doc_id")
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    word = lambda tag, n: " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    train = [(i, r["text"], "en", len(r["text"])) for i, r in enumerate(texts.limit(20).collect())]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    ids = lambda df, than: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect() if r["text"] in than)
    sure = "the of and to in that is was for with this from they which have been"
    out = corpus_pipeline.language(spark, frame([*train, (None, sure, "en", 1), (None, "12 !!", "en", 1)]), DATA)
    assert ids(out, {sure, "12 !!"}) == [(True, 0, sure)]
    a, b, c = word("a", 60), word("b", 60), word("c", 60)
    out = corpus_pipeline.near_duplicates(spark, frame([(None, a, "en", 1), (None, b, "en", 1), (None, b, "en", 1), (5, a, "en", 1), (6, b + " x", "en", 1), (6, c, "en", 1), (7, c, "en", 1), (None, word("d", 60), "en", 1)]), DATA)
    assert ids(out, {a, b, c, b + " x", word("d", 60)}) == sorted([(False, 5, a), (False, 6, b + " x"), (False, 6, c), (True, 0, word("d", 60))])
    out = corpus_pipeline.substrings(spark, frame([(1, a, "en", 7), (None, a + " " + b, "en", 7), (None, c + "\n", "en", 7), (3, a, "en", 7), (3, word("e", 60), "en", 7)]), DATA)
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str) == sorted([(1, a, 7), (None, b, len(b)), (None, c + "\n", 7), (3, word("e", 60), 7)], key=str)
    out = corpus_pipeline.benchmarks(spark, frame([(None, leak, "en", 1), (None, a, "en", 1), (4, leak + " x", "en", 1), (4, b, "en", 1)]), DATA)
    assert ids(out, {a, b, leak, leak + " x"}) == [(False, 4, b), (True, 0, a)]
