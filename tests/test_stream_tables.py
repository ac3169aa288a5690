"""Folded tables, two sinks of one pass, late users, hot-key windows and partitioned upserts on streams."""

import glob
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glyphgate import scan
from glyphgate.operators import billing, rates as batch_rates, report
from glyphgate.plans import inputs
from glyphgate.sources import files, sinks, upserts
from glyphgate.streaming import jobs, rates
from glyphgate.streaming.tables import BatchTable

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def parts(df, folder, n, order):
    """Write ``df`` as n files in time order; names sort in that order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for k in range(n):
        df.sparkSession.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1).write.parquet(f"{folder}/part={k:03d}")


def streamed(spark, folder, schema):
    return jobs.read_parquet_stream(spark, f"{folder}/*", schema, files_per_batch=1)


# --- folded tables -----------------------------------------------------------------------

def summed(spark, path):
    return BatchTable(spark, str(path), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))


def totals(table):
    return {r.k: r.n for r in table.read().collect()}


def batch(spark, number):
    return spark.createDataFrame([(number % 3, 1), (9, number)], "k int, n long").coalesce(1)


def expected(numbers):
    want = {9: sum(numbers)}
    for k in numbers:
        want[k % 3] = want.get(k % 3, 0) + 1
    return want


def test_folds_keep_files_bounded_and_count_each_batch_once(spark, tmp_path):
    table = summed(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.fold() is None
    for n in range(40):
        table.store(batch(spark, n), "a", n, fold_every=8)
        if n % 5 == 0:
            table.store(batch(spark, n), "a", n)                       # comes again: nothing changes
            assert totals(table) == expected(range(n + 1))
    assert len(glob.glob(f"{tmp_path}/batches/run=*/batch=*")) <= 16
    assert len(glob.glob(f"{tmp_path}/versions/*")) == 2
    table.store(batch(spark, 3), "a", 3)                               # folded long ago
    assert totals(table) == expected(range(40))
    table.store(batch(spark, 0), "b", 0)                               # another query counts from 0 again
    assert totals(table) == expected([*range(40), 0])
    assert {r.k: r.n for r in table.before("a", 39).collect()}[9] in (sum(range(39)), sum(range(40)))


def test_a_reader_during_a_fold_and_a_crash_inside_it(spark, tmp_path, monkeypatch):
    table = summed(spark, tmp_path)
    for n in range(6):
        table.store(batch(spark, n), "a", n)
    before = table.read()
    assert table.fold() == 0
    assert {r.k: r.n for r in before.collect()} == expected(range(6))  # its files are still there
    for n in range(6, 9):
        table.store(batch(spark, n), "a", n)
    reading = table.read()

    def stop(*_):
        raise RuntimeError("stopped before the removal")
    monkeypatch.setattr(files, "remove", stop)
    with pytest.raises(RuntimeError):
        table.fold()
    monkeypatch.undo()
    assert totals(table) == expected(range(9)) and {r.k: r.n for r in reading.collect()} == expected(range(9))
    # rows of a version without its finished list don't count
    batch(spark, 77).write.parquet(f"{tmp_path}/versions/version=2/rows")
    assert totals(table) == expected(range(9))
    table.store(batch(spark, 9), "a", 9)
    assert table.fold() == 2 and totals(table) == expected(range(10))
    # a batch that was cut short has no finished folder
    batch(spark, 50).write.parquet(f"{tmp_path}/batches/run=a/batch=10")
    os.remove(f"{tmp_path}/batches/run=a/batch=10/_SUCCESS")
    assert totals(table) == expected(range(10))
    table.store(batch(spark, 10), "a", 10)
    assert totals(table) == expected(range(11))


def test_usage_stream_folds(spark, tmp_path):
    log = inputs.derived(spark, SF, "requests").select("request_id", "ts", F.col("user_key").alias("key_hash"))
    parts(log, tmp_path / "in", 5, "ts")
    jobs.usage_stream(streamed(spark, tmp_path / "in", log.schema), f"{tmp_path}/out", f"{tmp_path}/cp", once=True, fold_every=2).awaitTermination()
    got = jobs.read_usage(spark, f"{tmp_path}/out").groupBy("key_hash").agg(F.sum("request_count").alias("n"))
    assert {r.key_hash: r.n for r in got.collect()} == {r.key_hash: r["count"] for r in log.groupBy("key_hash").count().collect()}
    assert len(glob.glob(f"{tmp_path}/out/batches/run=*/batch=*")) <= 4


# --- users of subscriptions --------------------------------------------------------------

EVENT = "event_id string, ts timestamp, type string, object " + billing.OBJECT_SCHEMA


def made(event_id, minute, sub, customer, kind="customer.subscription.created", status="active"):
    return (event_id, START + timedelta(minutes=minute), kind, (sub, customer, None, status, "price_1", 1706659200))


def test_late_customer_records_give_the_user(spark, tmp_path):
    events = spark.createDataFrame([
        made("e1", 0, "s1", "c1"), made("e2", 1, "s2", "c2"), made("e3", 2, "s3", "c3"), made("e4", 3, "s4", "c4"),
        made("e5", 30, "s1", "c1", "customer.subscription.updated", "past_due"), made("e6", 31, "s5", "c5"),
        made("e7", 90, "s6", "c6"), made("e8", 200, "s7", "c7")], EVENT)
    records = spark.createDataFrame([
        ("c1", "late1", START + timedelta(minutes=40)),        # after the event, in a later batch
        ("c2", "old2", START - timedelta(minutes=20)), ("c2", "new2", START + timedelta(minutes=20)),   # the newest stands
        ("c4", None, START + timedelta(minutes=10)),           # a record without a user says nothing
        ("c5", "early5", START + timedelta(minutes=5)),        # before the event
        ("c6", "too late", START + timedelta(minutes=190)),    # beyond the wait
    ], "customer_id string, user_id string, seen_at timestamp")
    known = spark.createDataFrame([("c3", "meta3"), ("c5", "meta5")], "customer_id string, user_id string")
    subs = spark.createDataFrame([("c4", "sub4", START), ("c3", "sub3", START), ("c2", "sub2", START)],
                                 "customer_id string, user_id string, updated_at timestamp")
    parts(events, tmp_path / "events", 4, "ts")
    parts(records, tmp_path / "records", 3, "seen_at")
    owned = jobs.with_late_users(billing.subscription_changes(streamed(spark, tmp_path / "events", events.schema), inputs.prices(spark)),
                                 streamed(spark, tmp_path / "records", records.schema), known, subs)
    jobs.subscription_stream(owned, f"{tmp_path}/out", f"{tmp_path}/cp", once=True, fold_every=2).awaitTermination()
    state = {r.subscription_id: (r.user_id, r.status) for r in jobs.read_subscriptions(spark, f"{tmp_path}/out").collect()}
    assert state == {"s1": ("late1", "past_due"), "s2": ("new2", "active"), "s3": ("meta3", "active"), "s4": ("sub4", "active"),
                     "s5": ("early5", "active"), "s6": (None, "active"), "s7": (None, "active")}


def test_arrival_order_and_changes_to_a_table(spark):
    changes = billing.subscription_changes(spark.createDataFrame([
        made("e1", 0, "s1", "c1"), made("e2", 9, "s1", "c1", "customer.subscription.updated", "past_due"),
        made("e3", 5, "s1", "c1", "customer.subscription.updated", "unpaid")], EVENT), inputs.prices(spark))
    assert billing.latest_subscription(changes).first().status == "past_due"
    arrived = changes.withColumn("arrival", F.substring("event_id", 2, 1).cast("int"))
    assert billing.latest_subscription(arrived, order="arrival").first().status == "unpaid"
    base = spark.createDataFrame([("s1", "c1", "u1", "trialing", "team", None, START - timedelta(days=1)),
                                  ("s9", "c9", "u9", "active", "team", None, START)],
                                 "subscription_id string, customer_id string, user_id string, status string, plan string,"
                                 " current_period_end timestamp, updated_at timestamp")
    news = changes.where("event_id <> 'e1'").withColumn("user_id", F.lit(None).cast("string"))
    after = {r.subscription_id: (r.user_id, r.status) for r in billing.apply_changes(base, news).collect()}
    assert after == {"s1": ("u1", "past_due"), "s9": ("u9", "active")}


# --- reports and audit of one pass -------------------------------------------------------

def test_each_text_is_scanned_once_for_two_sinks(spark, tmp_path):
    docs = inputs.derived(spark, SF, "texts").where("length(text) < 2000").limit(60)
    parts(docs, tmp_path / "in", 3, "doc_id")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    source = streamed(spark, tmp_path / "in", docs.schema).withColumn("text", watched.asNondeterministic()("text"))
    moment = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(doc_id % 3 AS INT))")
    reports = report.with_ids(scan(source, "doc_id", as_of_year=2026, keep_text=True), "doc_id", "text", moment).select(
        "doc_id", "report_id", "verdict", "sha256")
    run = lambda: jobs.scan_audit_stream(
        reports, f"{tmp_path}/reports", f"{tmp_path}/audit", f"{tmp_path}/cp", moment, once=True).awaitTermination()
    run()
    assert seen.value == docs.count()
    read = lambda: (sorted(map(str, jobs.read_reports(spark, f"{tmp_path}/reports").collect())),
                    sorted(map(str, spark.read.parquet(f"{tmp_path}/audit").collect())))
    stored = read()
    assert len(stored[0]) == len(stored[1]) == docs.count()
    audit = spark.read.parquet(f"{tmp_path}/audit")
    assert {"dt", "run", "batch"} <= set(audit.columns)
    assert {r.report_id: r.verdict for r in audit.collect()} == {
        r.report_id: r.verdict for r in jobs.read_reports(spark, f"{tmp_path}/reports").collect()}
    # the last batch comes again: its commit is lost, as in a crash after both writes
    last = max(glob.glob(f"{tmp_path}/cp/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert read() == stored


# --- windows of hot keys on a stream -----------------------------------------------------

def test_batches_carry_open_windows(spark, tmp_path):
    log = inputs.derived(spark, SF, "requests").select("request_id", "ts", (F.col("user_key") % 3).alias("ip"))
    nulls = spark.createDataFrame([(10 ** 9, None, 1), (10 ** 9 + 1, START, None)], "request_id long, ts timestamp, ip long")
    log = log.unionByName(nulls)
    window = 6 * 3_600_000
    columns = ("request_id", "window_start", "position", "allowed", "remaining", "retry_after_s", "reset_in_min")
    parts(log, tmp_path / "in", 5, "ts")
    rates.rate_limit_batches(streamed(spark, tmp_path / "in", log.schema), f"{tmp_path}/out", f"{tmp_path}/cp", "ip", "ts", "request_id",
                             3, window, once=True, fold_every=2).awaitTermination()
    got = sorted(map(str, rates.read_decisions(spark, f"{tmp_path}/out").select(*columns).collect()))
    assert got == sorted(map(str, batch_rates.rate_limit(log, "ip", "ts", "request_id", 3, window).select(*columns).collect()))


def test_a_million_requests_of_one_key(spark):
    window, limit = 60_000, 20
    log = spark.range(1_000_000).select(F.col("id").alias("request_id"), F.lit("k").alias("ip"),
                                        F.timestamp_millis(1_704_067_200_000 + F.col("id") * 3).alias("ts"))
    carried = spark.createDataFrame([("k", 1_704_067_200_000 - 30_000, 19)], "ip string, start long, taken long")
    out = rates.decide_batch(log, carried, "ip", "ts", "request_id", limit, window)
    got = out.agg(F.count("*"), F.countDistinct("window_start"), F.sum(F.col("allowed").cast("int")), F.max("position")).first()
    # 30,000 ms of the carried window (10,001 requests, one place left), then whole windows of 20,001 requests
    later = 1_000_000 - 10_001
    assert tuple(got) == (1_000_000, 1 + -(-later // 20_001), 1 + limit * -(-later // 20_001), 20_001)


# --- upserts -----------------------------------------------------------------------------

ROW = "k string, v int, at int"


def test_upserts_rewrite_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    rnd = random.Random(5)
    upserts.upsert_partitions(spark.createDataFrame([(f"k{i}", i, 1) for i in range(300)], ROW), path, "k", "at", 16)
    want = {f"k{i}": (i, 1) for i in range(300)}
    for turn in range(2, 5):
        news = [(f"k{rnd.randint(0, 320)}", turn * 1000 + j, rnd.choice([0, 1, turn])) for j in range(3)]
        news = list({r[0]: r for r in news}.values())
        before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
        touched = upserts.upsert_partitions(spark.createDataFrame(news, ROW), path, "k", "at", 16)
        for k, v, at in news:
            if at >= want.get(k, (0, -1))[1]:
                want[k] = (v, at)
        after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
        rewritten = {int(f.split("bucket=")[1].split("/")[0]) for f in set(before) - set(after)}
        assert rewritten <= set(touched) and len(touched) <= 3
        assert all(after[f] == before[f] for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched)
        assert {r.k: (r.v, r.at) for r in upserts.read_upserted(spark, path).collect()} == want
    assert upserts.upsert_partitions(spark.createDataFrame([], ROW), path, "k", "at", 16) == []


def test_an_upsert_that_stopped_before_placing_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    upserts.upsert_partitions(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], ROW), path, "k", "at", 4)
    place, calls = upserts._place, []

    def stop(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        place(*args)
    monkeypatch.setattr(upserts, "_place", stop)
    with pytest.raises(RuntimeError):
        upserts.upsert_partitions(spark.createDataFrame([("a", 2, 2)], ROW), path, "k", "at", 4)
    monkeypatch.undo()
    assert {r.k: r.v for r in upserts.read_upserted(spark, path).collect()} == {"a": 1, "b": 1}
    upserts.upsert_partitions(spark.createDataFrame([("b", 3, 3)], ROW), path, "k", "at", 4)
    assert {r.k: r.v for r in upserts.read_upserted(spark, path).collect()} == {"a": 2, "b": 3}
    assert not os.path.exists(f"{path}/_staged")
