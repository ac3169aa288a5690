"""Streams over several micro-batches agree with the batch operators."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glyphgate import scan
from glyphgate.operators import billing, rates as batch_rates, usage
from glyphgate.plans import inputs
from glyphgate.plans.catalog import QUERIES
from glyphgate.streaming import jobs, rates

SF = "/root/testdata/sf0.001"


def _files(df, folder, n, order):
    """Write ``df`` as n files in time order; names sort in that order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for k in range(n):
        part = df.sparkSession.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1)
        part.write.parquet(f"{folder}/in/part={k:03d}")


def _read(spark, folder, schema):
    return jobs.read_parquet_stream(spark, f"{folder}/in/*", schema, files_per_batch=1)


def test_scan_stream(spark, tmp_path):
    docs = inputs.derived(spark, SF, "texts").where("length(text) < 3000")
    _files(docs, tmp_path, 3, "doc_id")
    stream = scan(_read(spark, tmp_path, docs.schema), "doc_id", as_of_year=2026)
    jobs.write_files(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = {r.doc_id: r.sha256 for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.doc_id: r.sha256 for r in scan(docs, "doc_id", as_of_year=2026).collect()}


def test_usage_stream_counts_each_batch_once(spark, tmp_path):
    log = inputs.derived(spark, SF, "requests").select("request_id", "ts", F.col("user_key").alias("key_hash"))
    _files(log, tmp_path, 4, "ts")
    stream = _read(spark, tmp_path, log.schema)
    jobs.usage_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = sorted(map(tuple, jobs.read_usage(spark, f"{tmp_path}/out").select("key_hash", "month", "request_count").collect()))
    expected = usage.usage_by(log, ["key_hash"]).select("key_hash", "month", "request_count")
    assert got == sorted(map(tuple, expected.collect()))


def test_rate_limit_stream(spark, tmp_path):
    log = inputs.derived(spark, SF, "requests").select("request_id", "ts", (F.col("user_key") % 5).alias("ip"))
    _files(log, tmp_path, 4, "ts")
    window = 6 * 3_600_000
    stream = rates.rate_limit_stream(_read(spark, tmp_path, log.schema), "ip", "ts", "request_id", 3, window)
    jobs.write_files(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    columns = ("request_id", "window_start", "position", "allowed", "remaining", "retry_after_s", "reset_in_min")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    batch = batch_rates.rate_limit(log, "ip", "ts", "request_id", 3, window).select(*columns)
    assert got == sorted(map(tuple, batch.collect()))


def test_subscription_stream_in_any_batch_order(spark, tmp_path):
    events = inputs.billing_events(spark, SF)
    _files(events, tmp_path, 4, F.xxhash64("event_id"))
    stream = billing.subscription_changes(_read(spark, tmp_path, events.schema), inputs.prices(spark))
    jobs.subscription_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = sorted(map(str, jobs.read_subscriptions(spark, f"{tmp_path}/out").collect()))
    batch = billing.latest_subscription(billing.subscription_changes(events, inputs.prices(spark)))
    assert got == sorted(map(str, batch.collect()))


def test_dedup_stream_drops_replays(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(i % 30, start + timedelta(seconds=i)) for i in range(90)], "id int, ts timestamp")
    _files(rows, tmp_path, 3, "ts")
    stream = jobs.dedup_stream(_read(spark, tmp_path, rows.schema), "id", "ts")
    jobs.write_files(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30


@pytest.mark.parametrize("name, twin", [("str_scan", "scan_full"), ("str_audit", "snk_audit"), ("str_scan_audit", None)])
def test_tables_in_several_files_stream_whole(spark, tmp_path, name, twin):
    docs = spark.range(40).selectExpr("id AS doc_id", "'en' AS lang", "'web' AS source", "concat('text ', id) AS text")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    if twin:
        assert sorted(map(str, got.collect())) == sorted(map(str, QUERIES[twin](spark, str(tmp_path)).select(*got.columns).collect()))
    assert sorted(r.sha256 for r in got.collect()) == sorted(r.sha256 for r in QUERIES["rep_sha"](spark, str(tmp_path)).collect())


def test_tables_in_one_file_stream_too(spark):
    got, want = (QUERIES[name](spark, SF).select("doc_id", "sha256").collect() for name in ("str_scan", "rep_sha"))
    assert sorted(got) == sorted(want)
