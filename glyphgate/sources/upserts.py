"""Upserts into a table laid out by key hash: only touched partitions are read and rewritten.

The table is Parquet, partitioned by ``bucket``, the key's hash modulo a fixed number.  An upsert first writes the merged
rows of the touched partitions to ``_staged`` below the table, which readers don't see, and then lets Spark's dynamic
partition overwrite put them in place.  A job that ends between the two leaves a finished stage; the next upsert
puts it in place before it goes on.  The number of partitions stays what it was when the table was made.  One
upsert runs at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgate.operators import billing
from glyphgate.sources import files

BUCKET = "bucket"


def _place(spark: SparkSession, path: str) -> None:
    """Put finished stages in place and remove all stages."""
    for stage in files.finished(spark, f"{path}/_staged/*"):
        (spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(path))
    files.remove(spark, [f"{path}/_staged"])


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_partitions(updates: DataFrame, path: str, key: str, version: str, buckets: int = 64) -> list[int]:
    """Merge updates into the table (made when missing): newest ``version`` per key, updates win ties.

    Returns the numbers of the rewritten partitions (at most ``buckets``).  Updates are read twice.
    """
    spark, path = updates.sparkSession, path.rstrip("/")
    _place(spark, path)
    placed = updates.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    if not touched:
        return []
    made = files.exists(spark, path)
    base = spark.read.schema(placed.schema).parquet(path).where(F.col(BUCKET).isin(touched)) if made else placed.limit(0)
    # the bucket follows from the key, so the aggregate on the key alone keeps it
    merged = billing.upsert(base, placed, key, version)
    stage = f"{path}/_staged/{uuid.uuid4().hex}"
    merged.repartition(len(touched), BUCKET).write.parquet(stage)
    _place(spark, path)
    return touched
