"""Queries of quality rules and toxicity."""

from pyspark.sql import functions as F

from glyphgate.llm import quality, toxicity
from glyphgate.llm.registry import query, table


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~held_out("__id"))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.PREDICT_FROM).cast("int").alias("predicted"))
