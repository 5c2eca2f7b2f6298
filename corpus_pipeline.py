"""The corpus pipeline: five stages, each given the documents that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import bpe_codec, decontaminate, jaccard_join, language_id, substring_dedup
from stratalake.llm.shared import shared_folder

#: Least share of a text's letters that its language must have.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without letters, and texts of which no language has half. The others stay as they are."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.with_language(docs, model)
    label = F.col(found.columns[-1])
    return found.where((label["lang_pred"] != language_id.UNKNOWN) & (label["score"] >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the smallest doc_id (null is the largest; ties: the smallest digest of the text), and all null texts."""
    keep = jaccard_join.representatives(docs)
    own = docs.where("text is not null").withColumn("_digest", F.md5(F.col("text").cast("binary")))
    same = (own["_digest"] == keep["digest"]) & own["doc_id"].eqNullSafe(keep["id"])
    kept = own.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_digest"])
    return kept.select(docs.columns).unionByName(docs.where("text is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts word runs that stand earlier; a text that loses nothing stays as it is, one that loses all its words goes."""
    done = substring_dedup.deduplicate(docs.withColumn("_row", F.struct(*[docs[c] for c in docs.columns if c != "text"])), carry="_row")
    done = done.where("n_removed = 0 or n_removed < n_words")
    cut = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(cut["n_chars"])
    return done.select(*[cut[c].alias(c) for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    own = docs.withColumn("_digest", F.md5(F.col("text").cast("binary")))
    found = decontaminate.contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_digest")
    return own.join(found.select("_digest").distinct(), "_digest", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests of the ids and of what they decode to."""
    return bpe_codec.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmarks", benchmarks), ("encoded", encoded)]
#: SQL can't express the stages: they learn a model, hash, and encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
