"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and decides for good:

1. ``toxicity``: documents that the counterfactual-regularised classifier rejects go.
2. ``ngram_jaccard``: of each group of near duplicates (five-word shingles, similarity 0.8) one document stays.
3. ``suffix_dedup``: stretches of 100 bytes or more that start earlier in the corpus are cut out of the texts.
4. ``decontamination``: documents that overlap a benchmark item go.
5. ``packing``: the texts' token ids are packed into sequences of 4,096.

Null, empty and very long texts, ties, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; all stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, packing, suffixes, toxicity
from tessera.llm.store import materialise, small_batches

#: No stage but the fourth can be written in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffixes.remove_repeats(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", remove_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's sequences: one row a piece of a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
