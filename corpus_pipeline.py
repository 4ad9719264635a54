"""Corpus pipeline: five operators of pagemill.llm applied to ``documents`` one after another.

Each stage gets all that the stage before it kept, as Parquet.  All but the last return
the columns of ``documents``; their decisions take effect:

1. language: documents in no known language go; ``lang`` becomes the language found.
2. near_duplicates: one document of each group of near copies stays.
3. secrets: secrets are masked in the texts; every document stays.
4. mix: the words that the source mix takes, one row per run of words and repeat.
5. pack: token ids of the pieces of documents, packed into sequences.

Repeated rows, null texts and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import language_id, ngram_join, packing, secret_scan, source_mix
from pagemill.llm._store import Scratch, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.take_words(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: Models and signatures have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:  # what a stage stores for itself goes once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
