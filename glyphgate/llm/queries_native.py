"""Queries of the operators that use DataFrame functions only: quotation linking, license scans."""

from pyspark.sql import functions as F

from glyphgate.llm import licenses, oracle, quotes
from glyphgate.llm.registry import query, table

SHORT_WORDS = 60


@query("op5_chat_formatting", oracle.conversations())
def op5_chat_formatting(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations")).withColumnsRenamed({"conv": "conv_id", "thread": "thread_id"})


def files(spark, sf_dir):
    """Documents as files: ``source/lang/name``; short ones with a licence word are the licence files of their directory."""
    notice = F.col("text").rlike(licenses.MARKER) & (F.size(F.split("text", r"\s+")) <= SHORT_WORDS)
    name = F.concat(F.when(notice, "LICENSE-").otherwise("text-"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", name).alias("path"), "text")


@query("op8_license_scans", oracle.license_scan(SHORT_WORDS))
def op8_license_scans(spark, sf_dir):
    return licenses.scan(files(spark, sf_dir)).select(F.col("id").alias("doc_id"), "path", "license", "origin", "cosine", "from_dir")
