"""Streaming queries, run to completion over the given tables and checked like their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphgate.functions import columns
from glyphgate.operators import billing, report
from glyphgate.plans import inputs, oracle, text_queries, usage_queries
from glyphgate.plans.inputs import AS_OF_YEAR, derive, table
from glyphgate.plans.registry import ORACLES, query
from glyphgate.plans.scan import scan
from glyphgate.sources import sinks, upserts
from glyphgate.streaming import jobs, rates


def _table_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files.

    Spark takes a single file as the source of a stream only where the path is a pattern, here one that matches the table's name.
    """
    return jobs.read_parquet_stream(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, "*")


def stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A derived input read as a stream."""
    source = inputs.DERIVED[name][1]
    return derive(_table_stream(spark, sf_dir, source), name)


def finish(streaming_query) -> None:
    streaming_query.awaitTermination()


def _same_as(name: str, twin: str):
    """Register a streaming query under the statement of its batch twin."""
    def register(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[twin]
        return fn
    return register


@_same_as("str_scan", "scan_full")
def str_scan(spark, sf_dir):
    path = sinks.work_dir(spark)
    scanned = scan(stream(spark, sf_dir, "texts"), "doc_id", as_of_year=AS_OF_YEAR)
    finish(jobs.write_files(scanned, f"{path}/out", f"{path}/checkpoint", once=True))
    return text_queries._full(spark.read.parquet(f"{path}/out"))


@_same_as("str_audit", "snk_audit")
def str_audit(spark, sf_dir):
    path = sinks.work_dir(spark)
    scanned = scan(stream(spark, sf_dir, "texts"), "doc_id", as_of_year=AS_OF_YEAR, keep_text=True)
    moment = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(doc_id % 7 AS INT))")
    rows = report.with_ids(scanned, "doc_id", "text", moment)
    finish(jobs.audit_stream(rows, f"{path}/out", f"{path}/checkpoint", moment, once=True,
                             user=F.concat(F.lit("u"), F.col("doc_id") % 10),
                             tier=F.when(F.col("doc_id") % 3 == 0, "GROWTH"), latency_ms=F.col("doc_id") % 13))
    stored = spark.read.parquet(f"{path}/out")
    return stored.select("report_id", "user_id", "verdict", "sha256", "latency_ms", "tier", F.col("dt").cast("string").alias("dt"))


@_same_as("str_usage", "agg_usage_key")
def str_usage(spark, sf_dir):
    path = sinks.work_dir(spark)
    log = stream(spark, sf_dir, "requests").withColumn("key_hash", columns.key_hash(columns.bearer(F.col("auth_header"))))
    finish(jobs.usage_stream(log.where("key_hash IS NOT NULL"), f"{path}/out", f"{path}/checkpoint", once=True))
    return jobs.read_usage(spark, f"{path}/out").withColumn("last_used_at", usage_queries.stamp("last_used_at"))


@_same_as("str_rate", "win_rate")
def str_rate(spark, sf_dir):
    return _rated_stream(spark, sf_dir, usage_queries._IP_KEY, usage_queries.IP_LIMIT, usage_queries.IP_WINDOW)


@_same_as("str_rate_hot", "win_rate_hot")
def str_rate_hot(spark, sf_dir):
    """One key that holds every request."""
    return _rated_stream(spark, sf_dir, "'all'", 10, 3_600_000)


@_same_as("str_rate_state", "win_rate")
def str_rate_state(spark, sf_dir):
    """The form with one state per active key."""
    path = sinks.work_dir(spark)
    log = stream(spark, sf_dir, "requests").select("request_id", "ts", F.expr(usage_queries._IP_KEY).alias("ip"))
    limited = rates.rate_limit_stream(log, "ip", "ts", "request_id", usage_queries.IP_LIMIT, usage_queries.IP_WINDOW)
    finish(jobs.write_files(limited, f"{path}/out", f"{path}/checkpoint", once=True))
    return usage_queries._rated(spark.read.parquet(f"{path}/out"))


def _rated_stream(spark, sf_dir: str, key: str, limit: int, window: int) -> DataFrame:
    path = sinks.work_dir(spark)
    log = stream(spark, sf_dir, "requests").select("request_id", "ts", F.expr(key).alias("ip"))
    finish(rates.rate_limit_batches(log, f"{path}/out", f"{path}/checkpoint", "ip", "ts", "request_id", limit, window, once=True))
    return usage_queries._rated(rates.read_decisions(spark, f"{path}/out"))


def _customer_records(spark, sf_dir: str) -> DataFrame:
    """Records of odd customers as a stream: each comes 20 minutes after an event that creates a subscription."""
    users = usage_queries.customer_users(spark, sf_dir)
    created = stream(spark, sf_dir, "billing").where("type = 'customer.subscription.created' AND CAST(substr(customer, 5) AS INT) % 2 = 1")
    seen = created.select(F.col("customer").alias("customer_id"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("seen_at"))
    return seen.join(users, "customer_id")


@_same_as("str_subscription", "win_latest_sub")
def str_subscription(spark, sf_dir):
    """Subscription state with users: even customers are known beforehand, records of odd ones come later."""
    path = sinks.work_dir(spark)
    events = stream(spark, sf_dir, "billing").selectExpr(
        "event_id", "ts", "type", "named_struct('id', id, 'customer', customer, 'subscription', subscription,"
        " 'status', status, 'price_id', price_id, 'current_period_end', current_period_end) AS object")
    changes = billing.subscription_changes(events, inputs.prices(spark))
    known = usage_queries.customer_users(spark, sf_dir).where("CAST(substr(customer_id, 5) AS INT) % 2 = 0")
    owned = jobs.with_late_users(changes, _customer_records(spark, sf_dir), known, usage_queries.subscribed_users(spark, sf_dir))
    finish(jobs.subscription_stream(owned, f"{path}/out", f"{path}/checkpoint", once=True))
    jobs.fold_subscriptions(spark, f"{path}/out")
    return usage_queries.latest_columns(jobs.read_subscriptions(spark, f"{path}/out"))


@query("str_scan_audit",
       f"WITH {text_queries.REP}, audit_ AS ({usage_queries._AUDIT}) SELECT doc_id, report_id, user_id, verdict, verdict AS audit_verdict,"
       " sha256, latency_ms, tier, strftime(created_at, '%Y-%m-%d') AS dt FROM audit_")
def str_scan_audit(spark, sf_dir):
    """Reports and audit rows of one scan of the stream, joined by report."""
    path = sinks.work_dir(spark)
    moment = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(doc_id % 7 AS INT))")
    scanned = report.with_ids(scan(stream(spark, sf_dir, "texts"), "doc_id", as_of_year=AS_OF_YEAR, keep_text=True), "doc_id", "text", moment)
    finish(jobs.scan_audit_stream(
        scanned.select("doc_id", "report_id", "verdict", "sha256", "anonymized_input"), f"{path}/reports", f"{path}/audit", f"{path}/checkpoint",
        moment, once=True, user=F.concat(F.lit("u"), F.col("doc_id") % 10),
        tier=F.when(F.col("doc_id") % 3 == 0, "GROWTH"), latency_ms=F.col("doc_id") % 13))
    audit = spark.read.parquet(f"{path}/audit").select(
        "report_id", "user_id", F.col("verdict").alias("audit_verdict"), "latency_ms", "tier", F.col("dt").cast("string").alias("dt"))
    return (jobs.read_reports(spark, f"{path}/reports").select("doc_id", "report_id", "verdict", "sha256").join(audit, "report_id")
            .select("doc_id", "report_id", "user_id", "verdict", "audit_verdict", "sha256", "latency_ms", "tier", "dt"))


@_same_as("str_upsert", "snk_upsert")
def str_upsert(spark, sf_dir):
    """The upsert as a stream: status changes that a batch holds replace the rows of their subscriptions."""
    path = sinks.work_dir(spark)
    base, news = usage_queries.upsert_inputs(spark, sf_dir)
    upserts.upsert_partitions(base, f"{path}/table", "subscription_id", "updated_at", buckets=8)
    sinks.write_table(news, f"{path}/news")
    updates = jobs.read_parquet_stream(spark, f"{path}/news", news.schema, files_per_batch=2)
    finish(jobs.upsert_stream(updates, f"{path}/table", f"{path}/checkpoint", "subscription_id", "updated_at", buckets=8, once=True))
    return upserts.read_upserted(spark, f"{path}/table").select("subscription_id", "status")


@query("str_dedup", "SELECT event_id, type FROM billing")
def str_dedup(spark, sf_dir):
    """Every event sent twice in a row."""
    path = sinks.work_dir(spark)
    events = stream(spark, sf_dir, "billing").select("event_id", "ts", "type")
    replayed = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    unique = jobs.dedup_stream(replayed, "event_id", "ts")
    finish(jobs.write_files(unique, f"{path}/out", f"{path}/checkpoint", once=True))
    return spark.read.parquet(f"{path}/out").select("event_id", "type")


def _requests_with_text(requests: DataFrame) -> DataFrame:
    """Request log whose text is its event type behind the payload of its id."""
    return requests.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts",
                               f"{inputs.payload_sql('event_id', 'event_type')} AS text")


_RATE_TEXT = f"SELECT event_id, ts, {inputs.payload_sql('event_id', 'event_type')} AS text FROM events"
_RATE_SQL = (
    f"WITH sent AS MATERIALIZED ({_RATE_TEXT}), {oracle.report_ctes(AS_OF_YEAR, 'sent', 'event_id')}"
    f" SELECT {usage_queries.duck_stamp('date_trunc(' + oracle.lit('hour') + ', ts)')} AS window_start, verdict,"
    " count(*) AS reports FROM rep JOIN sent USING (event_id) GROUP BY ALL"
)


@query("str_verdict_rate", _RATE_SQL)
def str_verdict_rate(spark, sf_dir):
    """The batch form of the hourly verdict rate."""
    sent = _requests_with_text(table(spark, sf_dir, "events"))
    counted = jobs.verdict_rate(scan(sent, "event_id", keep=["ts"], as_of_year=AS_OF_YEAR), "ts")
    return counted.withColumn("window_start", usage_queries.stamp("window_start"))


@_same_as("str_verdict_rate_stream", "str_verdict_rate")
def str_verdict_rate_stream(spark, sf_dir):
    """The same on a stream: update mode, newest count per window and verdict."""
    path = sinks.work_dir(spark)
    sent = scan(_requests_with_text(_table_stream(spark, sf_dir, "events")), "event_id", keep=["ts"], as_of_year=AS_OF_YEAR)
    counted = jobs.verdict_rate(sent, "ts", delay="1 hour")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(jobs.batch_folder(batch, f"{path}/out", number))

    writer = counted.writeStream.outputMode("update").foreachBatch(store)
    finish(writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    newest = (spark.read.parquet(f"{path}/out").groupBy("window_start", "verdict")
              .agg(F.max("reports").alias("reports")))
    return newest.withColumn("window_start", usage_queries.stamp("window_start"))
