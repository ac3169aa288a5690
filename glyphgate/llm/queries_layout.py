"""Queries that lay out a corpus: sharding, mixing."""

from pyspark.sql import functions as F

from glyphgate.llm import mixing, sharding
from glyphgate.llm.registry import query, table

SHARDS = 16


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents")).schedule.select(
        F.col("id").alias("doc_id"), "source", "block", "slot", "offset", "phase")
