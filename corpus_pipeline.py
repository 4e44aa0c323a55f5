"""From documents to token files: one stage after the other, each kept as a table.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs``.  ``run`` writes each stage's result to the shared folder and reads it
again for the next one, so a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodia.llm import decontamination, language_id, mixing, ngram_join, token_frames
from episodia.session import written

VOCABULARY = "word_bpe_49k.json"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; texts without a letter go."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and one row for each document read back from them."""
    import public_tokenizers

    return token_frames.token_digest(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", languages),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", source_mix),
    ("token_files", token_files),
]

#: the first stage labels words with a trained model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
