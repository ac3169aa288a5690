"""Anchored-window rate limit on a stream.

:func:`rate_limit_stream` keeps one small state per active key and takes all of a key's requests of a batch into one
task.  :func:`rate_limit_batches` is for streams in which one key may hold any number of requests: it decides each
micro-batch with the batch operator, which splits hot keys, and carries the last window of each key in a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from glyphgate.operators import joins, rates, running
from glyphgate.streaming import jobs
from glyphgate.streaming.tables import BatchTable, run_of

STATE = "start bigint, taken bigint"


def rate_limit_stream(requests: DataFrame, key: str, ts: str, tie: str, limit: int, window: int,
                      delay: str = "10 minutes") -> DataFrame:
    """The batch operator's columns, decided in arrival order of the batches and time order inside one.

    State is the window's start and its count; the watermark drops it once the window is
    over for good.  A window that is still open takes the requests of the next batch.
    """
    key_type = requests.schema[key].dataType.simpleString()
    tie_type = requests.schema[tie].dataType.simpleString()
    out = (f"{key} {key_type}, {tie} {tie_type}, window_start bigint, position bigint, allowed boolean,"
           " remaining bigint, retry_after_s bigint, reset_in_min bigint")

    def decide(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, taken = state.get if state.exists else (None, 0)
        for pdf in _in_order(frames):
            times = pdf["__ms"].to_numpy()
            begun, place, i = np.empty(len(times), np.int64), np.empty(len(times), np.int64), 0
            while i < len(times):
                if start is None or times[i] - start > window:
                    start, taken = int(times[i]), 0
                j = int(np.searchsorted(times, start + window, side="right"))
                begun[i:j], place[i:j] = start, taken + 1 + np.arange(j - i)
                taken, i = taken + j - i, j
            begun, place = pd.Series(begun, index=pdf.index), pd.Series(place, index=pdf.index)
            over, left = place > limit, begun + window - pdf["__ms"]
            yield pd.DataFrame({
                key: group[0], tie: pdf[tie], "window_start": begun, "position": place, "allowed": ~over,
                "remaining": (limit - place).clip(lower=0),
                "retry_after_s": (-(-left // 1000)).where(over).astype("Int64"),
                "reset_in_min": (-(-left // 60_000)).where(over).astype("Int64"),
            })
        if start is not None:
            state.update((start, taken))
            closes = start + window + 1
            if closes > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(closes)
            else:
                state.remove()

    def _in_order(frames):
        every = [f for f in frames if len(f)]
        if every:
            yield pd.concat(every).sort_values(["__ms", tie])

    timed = (requests.withWatermark(ts, delay).withColumn("__ms", F.unix_millis(ts)))
    return timed.groupBy(key).applyInPandasWithState(
        decide, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _carried(spark: SparkSession, path: str, key: str, window: int, delay_ms: int) -> BatchTable:
    """Newest window of each key; windows that ended ``delay_ms`` before the newest one of all began are dropped."""
    def newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(key).agg(F.max(F.struct("start", "taken")).alias("w")).select(key, "w.*")
        bound = rows.agg((F.max("start") - F.lit(window + delay_ms)).alias("__bound"))
        return last.join(F.broadcast(bound), F.col("start") >= F.col("__bound")).drop("__bound")    # one row

    return BatchTable(spark, path, newest)


def decide_batch(batch: DataFrame, carried: DataFrame | None, key: str, ts: str, tie: str, limit: int, window: int) -> DataFrame:
    """The batch operator's columns for a micro-batch whose keys may have a window (``start``, ``taken``) open already.

    Requests up to the end of the key's carried window are numbered on from its count; the others open windows of
    their own.  Both ways order requests inside short slices of a window only.
    """
    def typed(df):      # batches of one table have one schema
        return df.withColumns({c: F.col(c).cast("bigint") for c in ("window_start", "position", "remaining", "retry_after_s", "reset_in_min")})

    if carried is None:
        return typed(rates.rate_limit(batch, key, ts, tie, limit, window))
    joined = joins.lookup_join(batch.withColumn("__ms", F.unix_millis(ts)), carried.withColumnsRenamed({"start": "__start", "taken": "__taken"}), key)
    inside = F.coalesce(F.col("__ms") - F.col("__start") <= window, F.lit(False))
    first = running.count_before(joined.where(inside).withColumn("__at", F.timestamp_millis("__ms")), [key], "__at", tie, F.lit(True), "__before")
    position, left = F.col("__taken") + F.col("__before") + 1, F.col("__start") + window - F.col("__ms")
    over = position > limit
    first = first.withColumns({
        "window_start": F.col("__start"), "position": position, "allowed": ~over,
        "remaining": F.greatest(F.lit(limit) - position, F.lit(0)),
        "retry_after_s": F.when(over, F.ceil(left / 1000)), "reset_in_min": F.when(over, F.ceil(left / 60_000))})
    others = rates.rate_limit(joined.where(~inside).select(*batch.columns), key, ts, tie, limit, window)
    return typed(first.select(*others.columns).unionByName(others))


def rate_limit_batches(requests: DataFrame, path: str, checkpoint: str, key: str, ts: str, tie: str, limit: int, window: int,
                       delay_ms: int = 600_000, once: bool = False, fold_every: int | None = jobs.FOLD_EVERY) -> StreamingQuery:
    """Decide a stream of requests in order of its batches; :func:`read_decisions` gives the decisions.

    A batch's decisions are written first, then what they leave open; a batch that comes again starts from the
    windows of the batches before it and finds what it had finished.
    """
    spark = requests.sparkSession
    open_ = _carried(spark, f"{path}/open", key, window, delay_ms)
    decided = BatchTable(spark, f"{path}/decided", lambda rows: rows)

    def decide(batch: DataFrame, number: int) -> None:
        run = run_of(batch)
        decisions = decide_batch(batch, open_.before(run, number), key, ts, tie, limit, window)
        written = spark.read.schema(decisions.schema).parquet(decided.store(decisions, run, number))
        last = (written.where("window_start IS NOT NULL").groupBy(key)
                .agg(F.max(F.struct(F.col("window_start").alias("start"), F.col("position").alias("taken"))).alias("w")).select(key, "w.*"))
        open_.store(last, run, number, fold_every)

    return jobs.for_each_batch(requests, decide, checkpoint, once)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return BatchTable(spark, f"{path}/decided", lambda rows: rows).read()
