"""Queries of language-model scoring."""

from pyspark.sql import functions as F

from glyphgate.llm import ngram_lm
from glyphgate.llm.registry import query, table


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = ngram_lm.train(docs, where=~F.col("held_out"))
    return ngram_lm.score(docs, model, carry=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")
