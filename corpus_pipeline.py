"""A corpus pipeline of four stages: quality, language, near-duplicates, packing.

Every stage works on all that its predecessor kept. The first three give back the columns of documents, and any further
columns, whatever their names. Null texts count as empty: they have a quality, but no language, so the second stage lets
them go. Rows of one id are judged each for itself by the first two stages and are one document to the third; rows without
an id stay there. Texts of any length are read whole. Empty tables give empty tables.
"""

from __future__ import annotations

from lexweave.llm import langid, minhash, packing, quality
from lexweave.llm.common import settle, table
from lexweave.llm.queries import token_file
from pyspark.sql import DataFrame, SparkSession


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least a half, learnt from all labels of this stage's documents."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    return quality.keep_good(docs, labels)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others, such as texts without letters, go."""
    return langid.keep_identified(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a likeness of 0.8 or more of their five-word runs."""
    return minhash.keep_one_each(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences of at most 2048 ids."""
    return packing.pack(docs, token_file("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", keep_distinct), ("packing", pack)]

#: SQL can't express the fitted models; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; between stages the rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
