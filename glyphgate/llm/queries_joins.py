"""Queries that match texts: n-gram Jaccard join, benchmark decontamination."""

from pyspark.sql import functions as F

from glyphgate.llm import decontaminate, jaccard, oracle
from glyphgate.llm.registry import query, table


@query("op3_ngram_jaccard_join", oracle.groups(4, 85))
def op3_ngram_jaccard_join(spark, sf_dir):
    found = jaccard.grouped(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "budget", "distance")
