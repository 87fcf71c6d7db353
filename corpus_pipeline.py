"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, ngram_join, packing, quality_classifier, quality_rules, sidecar
from graphloom.llm.queries import RANKS, TOKENIZER, crc_of_id, prepare, small_batches, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    small_batches(spark)
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"), crc_of_id(3) != 1)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs, certified on labels the classifier never saw."""
    small_batches(spark)
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels").where(crc_of_id(3) == 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    prepare(spark)
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    prepare(spark)
    small_batches(spark)
    return mixing.emit(docs, mixing.word_count(F.col("text")), F.col("source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    prepare(spark)
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality classifier", classify), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Training, certified cutoffs and the packer's state have no SQL form; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies as Parquet in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = sidecar.new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
