"""From raw documents to token ids: a pipeline of five stages, each a decision on all that its predecessor kept.

1. language: documents without a language go: those without letters, and those whose score is under a threshold that nearly all labelled ones reach.
2. near-duplicates: one document of each group stays that links of Jaccard 0.8 or more over five-word shingles connect.
3. repeats: byte strings of 100 and more that start earlier too are cut; documents of which nothing is left go.
4. benchmark: documents that the decontamination rule finds contaminated go.
5. tokens: the rest is encoded, with the end id, and decoded again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, sentencepiece_codec, simhash_dedup, suffix_dedup
from .shared import materialised, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ["doc_id", "lang", "source"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Prototypes and threshold are learned from the labels of two thirds of the documents; no label is an input of a prediction.

    Texts of fewer than 50 code points only need a language at all: their scores don't tell them from junk.
    """
    train = docs.where(~language_id.held_out("doc_id"))
    prototypes = language_id.fit(train)
    least = language_id.threshold(train, prototypes)
    found = language_id.predict(docs, prototypes, carry=COLUMNS)
    like = (F.char_length("text") < language_id.LEAST_CHARS) | (F.col("score") >= least)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > 0) & like).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs, shingle=5, similarity=0.8).select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(docs, carry=OTHERS, kept="text", length=100)
    left = found.where((F.size("spans") == 0) | (F.length("kept") > 0)).withColumn("text", F.col("kept"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id", "lang", "source", "n_chars"])
    return decontamination.with_verdict(found).where("not contaminated").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode(docs, end_id=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "checked")


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with small_batches() set before: every stage sends whole texts to Python."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _in_small_batches(f)) for f in (language, near_duplicates, repeats, benchmark, tokens)]

#: SQL can't say the stages; tests/llm/test_pipeline.py holds the rows and texts of each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
