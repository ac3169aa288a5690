"""From raw documents to shards: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes the documents that the one before has kept, as Parquet, and returns them with the same columns;
mixing keeps all and adds their place, and the last one returns the shard and slot of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgate.llm import decontaminate, jaccard, mixing, quality, sharding
from glyphgate.llm.work import Folder

SHARDS = 16
ORACLE_SQL = None      # trained and packed stages; tests hold the stages against brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on the labelled ones."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, prefix="__").where("__kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest id.

    Different texts under one id are told apart by their sets.  Documents without words and null ids stay; of
    repeated rows one stays.
    """
    return jaccard.first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place ``mix_at`` in the mix with tempered source weights."""
    return mixing.ordered(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``; slots follow the mix."""
    return sharding.shard(docs, shards=SHARDS, order_col="mix_at").withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), Folder(spark)
    for _, stage in STAGES:
        docs = folder.kept(stage(spark, docs, sf_dir))
    return docs
