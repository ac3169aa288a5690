"""Query of the token files."""

import public_tokenizers
from pyspark.sql import functions as F

from glyphgate.llm import token_files
from glyphgate.llm.registry import query, table
from glyphgate.llm.work import Folder


@query("op11_token_files")
def op11_token_files(spark, sf_dir):
    folder = Folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{folder.path}/files"
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_files.read(spark, path, docs.schema["doc_id"].dataType)
    with token_files.small_batches(spark):
        found = folder.kept(token_files.digests(rows))
    return token_files.with_start(found, token_files.manifest(rows)).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
