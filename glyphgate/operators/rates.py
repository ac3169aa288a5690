"""Rate limits over anchored fixed windows.

A window opens with a key's first request and covers the requests up to ``window``
milliseconds later (inclusive); the first request after that opens the next one.  Within
a window the first ``limit`` requests pass.  This is not an epoch-aligned window: each
window's start depends on the one before.

Finding the starts is the only sequential part, and it needs distinct times only.  With
slices of one window length no slice holds two starts, so all state between slices is
tiny.  A key's timeline is cut where a gap makes the next request a start in any case;
short stretches are folded in the JVM, and a stretch of very many requests is cut into
blocks of slices, bounded in slices and in times, that are solved in parallel for every way of entering them, chained,
and then replayed.  Requests themselves are only joined by (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

STRETCH = 4_096   # distinct times folded in one row
BLOCK = 256       # slices per block of a long stretch, at most
BLOCK_TIMES = 1 << 19   # distinct times after which a block ends with its slice


def _first_after(times: np.ndarray, end: float) -> int:
    return int(np.searchsorted(times, end, side="right"))


def _group(table: pa.Table, names: Sequence[str], n: int) -> dict[str, pa.Array]:
    """The key columns of a group, ``n`` times."""
    return {c: pa.repeat(table[c][0], n) for c in names}


def _solve_block(window: int):
    """Per block: for each request that may open its first window, the start of its last window."""
    def solve(table: pa.Table) -> pa.Table:
        times = np.sort(table["ms"].to_numpy())
        follow = np.searchsorted(times, times + window, side="right")
        # pointer doubling: a block has at most one start per slice
        last = np.where(follow < len(times), follow, np.arange(len(times)))
        for _ in range(BLOCK.bit_length() + 1):
            last = last[last]
        opening = table["block"][0].as_py() * window
        ways = min(_first_after(times, opening - 1 + window) + 1, len(times))
        leaves = times[last[:ways]]
        # of neighbours that end alike the latest stands for all
        kept = np.append(leaves[1:] != leaves[:-1], True)
        return pa.table(_group(table, ("key", "stretch", "block"), int(kept.sum()))
                        | {"opens": times[:ways][kept], "leaves": leaves[kept]})
    return solve


def _chain_blocks(window: int):
    """Per stretch: how each block is entered."""
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        end, out = -1.0, []
        for block, part in pdf.sort_values(["block", "opens"]).groupby("block", sort=True):
            out.append((block, int(end)))
            i = _first_after(part["opens"].to_numpy(), end)
            if i < len(part):
                end = int(part["leaves"].iloc[i]) + window
        blocks, ends = zip(*out)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "stretch": pdf["stretch"].iloc[0],
                             "block": blocks, "until": ends})
    return chain


def _replay_block(window: int):
    """Per block: the window starts, given how it is entered."""
    def replay(table: pa.Table) -> pa.Table:
        times = np.sort(table["ms"].to_numpy())
        starts, i = [], _first_after(times, table["until"][0].as_py())
        while i < len(times):
            starts.append(int(times[i]))
            i = _first_after(times, times[i] + window)
        return pa.table(_group(table, ("key",), len(starts)) | {"anchor": np.array(starts, dtype="int64")})
    return replay


def _blocked(cut: DataFrame) -> DataFrame:
    """Slices with their ``block`` in a long stretch, named by its first slice."""
    upto = Window.partitionBy("key", "stretch").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    part = cut.withColumns({"__slices": F.expr(f"slice div {BLOCK}"),
                            "__times": F.floor((F.sum("n").over(upto) - F.col("n")) / BLOCK_TIMES)})
    return part.withColumn("block", F.min("slice").over(Window.partitionBy("key", "stretch", "__slices", "__times"))).drop("__slices", "__times")


def window_starts(times: DataFrame, window: int, key_type: str, stretch: int = STRETCH) -> DataFrame:
    """Window starts ``(key, slice, anchor, earlier)`` from distinct ``(key, ms)``, one row per occupied slice.

    ``anchor`` is the start inside the slice (or null), ``earlier`` the last start before the slice.
    """
    sliced = times.withColumn("slice", F.expr(f"ms div {window}"))
    slices = sliced.groupBy("key", "slice").agg(
        F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count("*").alias("n"))
    along = Window.partitionBy("key").orderBy("slice")
    gap = F.coalesce(F.col("lo") - F.lag("hi").over(along) > window, F.lit(True))
    cut = (slices.withColumn("__new", gap.cast("int"))
           .withColumn("stretch", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("size", F.sum("n").over(Window.partitionBy("key", "stretch"))))
    placed = sliced.join(_blocked(cut).select("key", "slice", "stretch", "size", "block"), ["key", "slice"])

    fold = (f"aggregate(times, named_struct('until', -1L, 'starts', cast(array() AS array<bigint>)),"
            f" (a, t) -> if(t > a.until, named_struct('until', t + {window}, 'starts', concat(a.starts, array(t))), a),"
            " a -> a.starts)")
    short = (placed.where(F.col("size") <= stretch).groupBy("key", "stretch")
             .agg(F.array_sort(F.collect_list("ms")).alias("times"))
             .select("key", F.explode(F.expr(fold)).alias("anchor")))

    blocked = placed.where(F.col("size") > stretch).select("key", "stretch", "block", "ms")
    solved = blocked.groupBy("key", "stretch", "block").applyInArrow(
        _solve_block(window), f"key {key_type}, stretch bigint, block bigint, opens bigint, leaves bigint")
    entered = solved.groupBy("key", "stretch").applyInPandas(
        _chain_blocks(window), f"key {key_type}, stretch bigint, block bigint, until bigint")
    long = (blocked.join(entered, ["key", "stretch", "block"]).groupBy("key", "stretch", "block")
            .applyInArrow(_replay_block(window), f"key {key_type}, anchor bigint"))

    anchors = short.unionByName(long).withColumn("slice", F.expr(f"anchor div {window}"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return (slices.select("key", "slice").join(anchors, ["key", "slice"], "left")
            .withColumn("earlier", F.last("anchor", ignorenulls=True).over(before)))


def rate_limit(requests: DataFrame, key: str, ts: str, tie: str, limit: int, window: int,
               stretch: int = STRETCH) -> DataFrame:
    """Add ``window_start`` (ms), ``position``, ``allowed``, ``remaining``, ``retry_after_s`` and ``reset_in_min``.

    ``ts`` is a timestamp; times count in whole milliseconds, ties are ordered by ``tie``.
    Requests without a key or time are in no window: they stay, with nulls in all six columns.
    """
    keyed = requests.withColumns({"__ms": F.unix_millis(ts), "__slice": F.expr(f"unix_millis({ts}) div {window}")})
    times = keyed.select(F.col(key).alias("key"), F.col("__ms").alias("ms")).where("key IS NOT NULL AND ms IS NOT NULL").distinct()
    starts = window_starts(times, window, requests.schema[key].dataType.simpleString(), stretch)
    dim = starts.select(F.col("key").alias(key), F.col("slice").alias("__slice"), "anchor", "earlier")
    placed = keyed.join(dim, [key, "__slice"], "left").withColumn(
        "window_start", F.when(F.col("__ms") >= F.col("anchor"), F.col("anchor")).otherwise(F.col("earlier")))
    timed = F.col("window_start").isNotNull()
    # rows outside any window are spread
    order = Window.partitionBy(key, "window_start", F.when(~timed, F.pmod(F.xxhash64(tie), F.lit(4096)))).orderBy("__ms", tie)
    counted = placed.withColumn("position", F.when(timed, F.row_number().over(order)))
    left = F.col("window_start") + window - F.col("__ms")
    allowed = F.col("position") <= limit
    return (counted.withColumns({
        "allowed": allowed,
        "remaining": F.when(timed, F.greatest(F.lit(limit) - F.col("position"), F.lit(0))),
        "retry_after_s": F.when(~allowed, F.ceil(left / 1000)),
        "reset_in_min": F.when(~allowed, F.ceil(left / 60_000)),
    }).drop("__ms", "__slice", "anchor", "earlier"))
