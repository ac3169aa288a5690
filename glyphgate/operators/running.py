"""Ordered running counts that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgate.operators.joins import null_safe_join


def count_before(df: DataFrame, keys: Sequence[str], ts: str, tie: str, flag: Column,
                 out_col: str, slice_: str = "minute") -> DataFrame:
    """Add the number of flagged rows of the same key that precede the row in ``(ts, tie)`` order.

    A window over the key alone would put all rows of a key into one task.  Here rows are
    partitioned by key and time slice: counts per slice (combined before the shuffle) give
    each slice its offset, and the window only orders rows inside a slice.  Rows without a key
    count as one key; rows without a time come before all others of their key.
    """
    cut = df.withColumn("__slice", F.date_trunc(slice_, ts)).withColumn("__flag", F.when(flag, 1).otherwise(0))
    per_slice = cut.groupBy(*keys, "__slice").agg(F.sum("__flag").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(*keys, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = (Window.partitionBy(*keys, "__slice").orderBy(ts, tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (null_safe_join(cut, offsets, [*keys, "__slice"])
            .withColumn(out_col, F.col("__offset") + F.coalesce(F.sum("__flag").over(inside), F.lit(0)))
            .drop("__slice", "__flag", "__offset"))


def dense_numbers(values: DataFrame, group: str, hashed: str, out_col: str) -> DataFrame:
    """Number the distinct hashes of each group 1, 2, ... in their order.

    The first three hex digits make equal-sized buckets, so numbering is an offset per
    bucket plus a count inside the bucket; no task sorts a whole group.
    """
    keyed = values.select(group, hashed).distinct().withColumn("__bucket", F.left(hashed, F.lit(3)))
    sizes = keyed.groupBy(group, "__bucket").count()
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__bucket").orderBy(hashed)
    return keyed.join(offsets, [group, "__bucket"]).select(
        group, hashed, (F.col("__offset") + F.row_number().over(inside)).alias(out_col))
