"""Retention of day-partitioned tables: whole days go by their folder's name, rows only in the boundary day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import SparkSession, functions as F

from glyphgate.functions import fixed
from glyphgate.sources import files


def _place(spark: SparkSession, path: str, partitions: Sequence[str]) -> None:
    """Put a finished stage, named like its day, in the place of that day; may be repeated."""
    for stage in files.finished(spark, f"{path}/_staged/*"):
        rows = spark.read.parquet(stage)
        files.remove(spark, [f"{path}/{partitions[0]}={stage.rsplit('/', 1)[1]}"])
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy(*partitions).parquet(path)
    files.remove(spark, [f"{path}/_staged"])


def drop_expired(spark: SparkSession, path: str, as_of: datetime, ts: str = "created_at", days: int = fixed.AUDIT_RETENTION_DAYS,
                 partitions: Sequence[str] = ("dt",)) -> list[str]:
    """Remove rows older than ``days`` before ``as_of`` from a table whose first partition is the day of ``ts``.

    Older days are removed unread, later ones aren't touched; only the boundary day is read, and replaced by its
    remaining rows, which are written beside the table first: a run that ended early is finished by the next.
    Rows without a time stay.  Returns the days removed unread.
    """
    path, day = path.rstrip("/"), partitions[0]
    _place(spark, path, partitions)
    bound = F.lit(as_of - timedelta(days=days))
    edge = str(spark.range(1).select(F.to_date(bound)).first()[0])
    found = {f.rsplit("=", 1)[1]: f for f in files.folders(spark, f"{path}/{day}=*")}
    expired = [d for d in found if d[:4].isdigit() and d < edge]
    files.remove(spark, [found[d] for d in expired])
    if edge in found:
        rows = spark.read.parquet(path).where(F.col(day) == F.to_date(F.lit(edge)))
        if not rows.where(F.col(ts) < bound).isEmpty():
            rows.where(F.col(ts).isNull() | (F.col(ts) >= bound)).write.parquet(f"{path}/_staged/{edge}")
            _place(spark, path, partitions)
    return expired
