"""The corpus pipeline: five of the training-data operators, one after the other, each stage's rows written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import decontam, langid, ngram_join, packing, quality
from packwright.llm.common import materialize, table

KEY = "_row_key"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have text in one of the languages learned from these."""
    return langid.keep_known(docs)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, written so that it stays: doc_id may be null or repeat."""
    return materialize(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id (null last) of each class of near duplicates; rows that share a doc_id are compared by their texts as any others."""
    rows = keyed(docs)
    found = ngram_join.near_duplicates(by_key(rows), with_links=False).select(F.col("doc_id").alias(KEY), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(KEY))).getField(KEY)
    stays = rows.select(KEY, "doc_id").join(found, KEY).groupBy("class_id").agg(first.alias(KEY))
    return rows.join(stays, KEY, "left_semi").select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    rows = keyed(docs)
    leaks = decontam.find_leaks(by_key(rows), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document lie in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed),
]
#: Its model stages and similarity join have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
