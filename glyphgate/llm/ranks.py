"""Gapless numbers within keys, without a task that sees all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_BITS = 12


def numbered(df: DataFrame, keys: Sequence[str], hashed: Column, ties: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, ... within ``keys`` in the order of a 64-bit hash, then of ``ties``; keys aren't null.

    The hash's leading bits make buckets of equal size.  Bucket counts, combined before their shuffle, give
    offsets; a window only orders the rows of one bucket of one key.
    """
    rows = df.withColumn("__h", hashed).withColumn("__bucket", F.shiftrightunsigned("__h", 64 - BUCKET_BITS))
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__h", *ties)
    return (rows.join(offsets, [*keys, "__bucket"])
            .withColumn(out, F.col("__offset") + F.row_number().over(inside) - 1)
            .drop("__bucket", "__offset", "__h"))
