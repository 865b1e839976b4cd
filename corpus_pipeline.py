"""From raw documents to packed training sequences in four stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of
``documents``; the last returns the place of every piece. ``run`` writes each stage's rows
as a table in the shared folder and reads them back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelstrata.llm import language_models, packing, quality, tensor_minhash
from pixelstrata.llm.tables import stored

TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the languages of the corpus."""
    return language_models.keep_identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return tensor_minhash.drop_near_duplicates(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", identified),
    ("minhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifiers nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
