"""Sinks: audit log, metrics, upserted tables, exports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AUDIT_COLUMNS = ("report_id", "user_id", "verdict", "sha256", "latency_ms", "key_hash", "tier", "created_at")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves, but only where Spark runs locally.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/glyphgate-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="glyphgate-"), "work")


def audit_rows(scanned: DataFrame, created_at: Column, user: Column | None = None, key_hash: Column | None = None,
               tier: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """Audit rows of scanned texts; no text and no entity is kept."""
    def text(c):
        return c if c is not None else F.lit(None).cast("string")

    return scanned.select(
        "report_id", text(user).alias("user_id"), "verdict", "sha256",
        (latency_ms if latency_ms is not None else F.lit(None)).cast("double").alias("latency_ms"),
        text(key_hash).alias("key_hash"), F.coalesce(text(tier), F.lit("FREE")).alias("tier"),
        created_at.alias("created_at"))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows, partitioned by day."""
    (rows.select(*AUDIT_COLUMNS).withColumn("dt", F.to_date("created_at"))
     .write.mode("append").partitionBy("dt").parquet(path))


def write_audit_batch(rows: DataFrame, path: str, run: str, number: int) -> None:
    """Audit rows of one micro-batch, partitioned by day, query and batch; the same batch replaces its own partitions."""
    (rows.select(*AUDIT_COLUMNS, F.to_date("created_at").alias("dt"), F.lit(run).alias("run"), F.lit(number).alias("batch"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "run", "batch").parquet(path))


def write_table(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a new version of a table to a fresh path and read it back from there."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line per evaluated group."""
    metrics.write.mode("errorifexists").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
