"""Streaming forms of the operators.

The scan is stateless and runs on a stream as it is.  Stateful jobs bound their state by a
watermark; jobs that keep a table write per-batch folders or new versions, so that a
repeated batch overwrites its own output and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glyphgate.functions import columns
from glyphgate.operators import billing
from glyphgate.sources import sinks, upserts
from glyphgate.streaming.tables import BatchTable, run_of

FOLD_EVERY = 64     # batches after which a stream folds its table


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet",
                        files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream; rows keep their input splits."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
          .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_files(df: DataFrame, path: str, checkpoint: str, once: bool = False, *partition_by: str) -> StreamingQuery:
    """Append a stream to parquet files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer.partitionBy(*partition_by) if partition_by else writer, checkpoint, once)


def audit_stream(scanned: DataFrame, path: str, checkpoint: str, created_at: Column, once: bool = False,
                 **who: Column) -> StreamingQuery:
    """Audit rows of a scanned stream beside the main flow."""
    rows = sinks.audit_rows(scanned, created_at, **who).withColumn("dt", F.to_date("created_at"))
    return write_files(rows, path, checkpoint, once, "dt")


def for_each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                   once: bool = False) -> StreamingQuery:
    return _start(df.writeStream.foreachBatch(handle), checkpoint, once)


def batch_folder(batch: DataFrame, path: str, number: int) -> str:
    """Folder of a micro-batch below that of its query: a query with a new checkpoint overwrites nothing."""
    return f"{path}/run={run_of(batch)}/batch={number}"


def _usage(spark: SparkSession, path: str, key: str) -> BatchTable:
    return BatchTable(spark, path, lambda rows: rows.groupBy(key, "month").agg(
        F.sum("request_count").alias("request_count"), F.max("last_used_at").alias("last_used_at")))


def usage_stream(requests: DataFrame, path: str, checkpoint: str, key: str = "key_hash", ts: str = "ts",
                 once: bool = False, fold_every: int | None = FOLD_EVERY) -> StreamingQuery:
    """Monthly usage: each batch writes its own counts; :func:`read_usage` adds them up.

    Keeps no state between batches, so late requests count whenever they come.
    """
    counts = _usage(requests.sparkSession, path, key)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(key, columns.month_key(F.col(ts)).alias("month")).agg(
            F.count("*").alias("request_count"), F.max(ts).alias("last_used_at"))
        counts.store(rows, run_of(batch), number, fold_every)

    return for_each_batch(requests, add, checkpoint, once)


def read_usage(spark: SparkSession, path: str, key: str = "key_hash") -> DataFrame:
    return _usage(spark, path, key).read()


def fold_usage(spark: SparkSession, path: str, key: str = "key_hash") -> int | None:
    """Fold stored batches into the next version; for tables whose stream doesn't fold by itself."""
    return _usage(spark, path, key).fold()


def with_late_users(changes: DataFrame, customers: DataFrame, known: DataFrame, subs: DataFrame | None = None,
                    delay: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    """Changes of a stream with ``user_id``, at once and again when the customer's record comes.

    ``known`` (customer_id, user_id) and ``subs`` are tables that the stream looks up: the user is the
    customer's, else that of an earlier subscription of the customer.  ``customers`` is a stream
    (customer_id, user_id, seen_at): a record within ``wait`` of a creation, before or after it, gives that creation
    once more, with the record's user, which then stands.  No change waits for a record, and the watermarks
    (``delay``) drop what no record can meet any more.
    """
    timed = changes.withWatermark("ts", delay)
    now = billing.resolve_users(timed, known, subs).withColumn("user_at", F.lit(None).cast("timestamp"))
    records = (customers.where("user_id IS NOT NULL").select(
        F.col("customer_id").alias("__customer"), F.col("user_id"), F.col("seen_at").alias("user_at"))
        .withWatermark("user_at", delay))
    margin = F.expr(f"INTERVAL {wait}")
    again = timed.where("creates").join(
        records, (F.col("customer_id") == F.col("__customer"))
        & (F.col("user_at") >= F.col("ts") - margin) & (F.col("user_at") <= F.col("ts") + margin)).drop("__customer")
    return now.unionByName(again.select(*now.columns))


def _subscriptions(spark: SparkSession, path: str) -> BatchTable:
    def still_matter(rows: DataFrame) -> DataFrame:
        position, row = F.struct(*billing.position_columns(rows)), F.struct(*rows.columns)
        kept = rows.groupBy("subscription_id").agg(
            F.max_by(row, position).alias("a"),
            F.max_by(row, F.when(F.col("sets_plan"), position)).alias("b"),
            F.max_by(row, F.when(F.col("creates"), position)).alias("c"))
        return kept.select(F.explode(F.array_distinct(F.array_compact(F.array("a", "b", "c")))).alias("r")).select("r.*")

    return BatchTable(spark, path, still_matter)


def subscription_stream(changes: DataFrame, path: str, checkpoint: str, once: bool = False,
                        fold_every: int | None = FOLD_EVERY) -> StreamingQuery:
    """Subscription changes, reduced per batch to the ones that can still matter; :func:`read_subscriptions` gives the state.

    The state is the last value set per field, so a batch needs to keep, per subscription,
    its last status change, its last full change and its last creation.  Every change keeps
    its event time: batches may arrive out of order.  Changes may carry a user
    (:func:`with_late_users`).
    """
    state = _subscriptions(changes.sparkSession, path)

    def keep_latest(batch: DataFrame, number: int) -> None:
        state.store(state.combine(batch), run_of(batch), number, fold_every)

    return for_each_batch(changes, keep_latest, checkpoint, once)


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    return billing.latest_subscription(_subscriptions(spark, path).read())


def fold_subscriptions(spark: SparkSession, path: str) -> int | None:
    return _subscriptions(spark, path).fold()


def scan_audit_stream(reports: DataFrame, path: str, audit_path: str, checkpoint: str, created_at: Column,
                      once: bool = False, **who: Column) -> StreamingQuery:
    """Reports and audit rows of one scan.

    ``reports`` are scanned texts with their ``report_id``; ``created_at`` and ``who`` are made of their columns.
    A batch's reports are written first, each text being scanned for that once; its audit rows are made of the
    narrow columns of the written reports and replace the partitions (dt, run, batch), so that a batch that comes
    again changes nothing in either table.
    """
    table = BatchTable(reports.sparkSession, path, lambda rows: rows)

    def both(batch: DataFrame, number: int) -> None:
        run = run_of(batch)
        written = batch.sparkSession.read.schema(batch.schema).parquet(table.store(batch, run, number))
        sinks.write_audit_batch(sinks.audit_rows(written, created_at, **who), audit_path, run, number)

    return for_each_batch(reports, both, checkpoint, once)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return BatchTable(spark, path, lambda rows: rows).read()


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, key: str, version: str, buckets: int = 64,
                  once: bool = False) -> StreamingQuery:
    """Newest row per key in a table of key-hash partitions; each batch rewrites the partitions it touches."""
    def merge(batch: DataFrame, number: int) -> None:
        upserts.upsert_partitions(batch, path, key, version, buckets)

    return for_each_batch(updates, merge, checkpoint, once)


def dedup_stream(events: DataFrame, id_col: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Replays of one event collapse; ids are remembered for the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def verdict_rate(scanned: DataFrame, ts: str, every: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Reports per tumbling window and verdict; ``delay`` sets the watermark of a stream."""
    timed = scanned.withWatermark(ts, delay) if delay else scanned
    counted = timed.groupBy(F.window(ts, every).alias("w"), "verdict").agg(F.count("*").alias("reports"))
    return counted.select(F.col("w.start").alias("window_start"), "verdict", "reports")
