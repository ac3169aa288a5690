"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of one size are interchangeable, so packing needs the number of groups per size only.  Spark counts them;
sizes of 8 KB and more are rounded up to 13 significant bits, which bounds the distinct sizes by
some 4,096 per doubling.  The plan, runs of (size, number of groups, shard), is packed from the largest size down,
each run into the tightest shard with room for one more.  Remaining capacities are kept in order and
searched by bisection, the part of a balanced tree.  Spark numbers the groups of each size and looks their run up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphgate.llm.ranks import numbered
from glyphgate.llm.work import Folder
from glyphgate.operators.joins import lookup_join

Runs = list[tuple[int, int, int]]     # size, groups, shard


def best_fit(sizes: list[tuple[int, int]], capacity: int) -> tuple[Runs, int]:
    """Pack (size, number of groups), sizes descending, into shards of a fixed capacity; their runs and number."""
    runs, room, opened = [], [], 0          # room: (remaining, shard), ascending
    for size, groups in sizes:
        if size > capacity:
            raise ValueError(f"a group of size {size} exceeds the capacity {capacity}")
        while groups:
            at = bisect_left(room, (size, -1))
            if at == len(room):
                insort(room, (capacity, opened))
                opened += 1
                continue
            left, shard = room.pop(at)
            taken = min(groups, left // size)
            runs.append((size, taken, shard))
            groups -= taken
            insort(room, (left - taken * size, shard))
    return runs, opened


def smallest_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """The least capacity, to one part in 4,096, with which best fit needs at most ``shards`` shards."""
    total = sum(s * n for s, n in sizes)
    low, high = max([-(-total // shards), *(s for s, _ in sizes)]), max(1, 2 * total)
    if best_fit(sizes, low)[1] <= shards:
        return low
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit(sizes, middle)[1] <= shards else (middle, high)
    return high


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of each row of ``docs``.

    Give the capacity in bytes, and as few shards as best fit needs are filled; or the number of shards, and the least
    capacity that does is used.  A row's size is the bytes of its text and one more.  Rows of equal texts are a group and
    share a shard; a null text equals an empty one.  A group over the capacity is no longer indivisible: it is cut into
    the fewest parts that fit.  Slots number the rows of a shard from 0, by ``order_col`` (places from 0 on, nulls last) or
    else by a hash.  Repeated rows have slots of their own.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    folder = Folder(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = ["id", "size", "text_crc32", "__order"]
    rows = folder.kept(docs.select(
        F.col(id_col).alias("id"), F.lit(None).cast("long").alias("__order") if order_col is None else F.col(order_col).cast("long").alias("__order"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("__text")))
    groups = folder.kept(rows.groupBy("__text").agg(F.sum("size").alias("bytes"), F.max("size").alias("size")))
    total, longest, n = groups.agg(F.sum("bytes"), F.max("size"), F.count("*")).first()
    if not n:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limit = capacity or max(-(-total // shards), longest)
    large = groups.where(F.col("bytes") > limit).select("__text", F.greatest(F.lit(1), F.lit(limit) / F.col("size")).cast("long").alias("__each"))
    # each of them holds over total / shards bytes, so they are fewer than the shards
    order = F.xxhash64("id", "__text")
    cut = numbered(rows.join(F.broadcast(large), "__text"), ["__text"], order, ["id"], "__at")
    cut = cut.select(*kept, F.concat_ws("/", "__text", F.expr("__at div __each")).alias("__unit"))
    whole = rows.join(F.broadcast(large), "__text", "left_anti").select(*kept, F.col("__text").alias("__unit"))
    rows = folder.kept(whole.unionByName(cut))
    shift = F.greatest(F.lit(0), F.floor(F.log2("bytes")).cast("int") - 12)
    step = F.expr("shiftleft(1L, __shift)")
    units = folder.kept(rows.groupBy("__unit").agg(F.sum("size").alias("bytes")).withColumn("__shift", shift).select(
        "__unit", (F.floor((F.col("bytes") + step - 1) / step) * step).cast("long").alias("__class")))
    sizes = [(r[0], r[1]) for r in units.groupBy("__class").count().orderBy(F.desc("__class")).collect()]
    # a part of an oversize group may come out above the limit by rounding
    capacity = max(capacity, sizes[0][0]) if capacity else smallest_capacity(sizes, shards)
    runs, _ = best_fit(sizes, capacity)
    placed = folder.kept(_placed(numbered(units, ["__class"], F.xxhash64("__unit"), ["__unit"], "__at"), runs))
    order = order_of_rows()
    if order_col is not None:
        last = (rows.agg(F.max("__order")).first()[0] or 0) + 1
        order = F.shiftleft(F.coalesce("__order", F.lit(last)), 64 - last.bit_length())    # even in its leading bits, as numbered() wants
    return numbered(lookup_join(rows, placed, "__unit", "inner"), ["shard"], order, ["id", "size", "text_crc32"], "slot").select(
        "id", "size", "text_crc32", "shard", "slot")


def order_of_rows():
    return F.xxhash64("id", "text_crc32")


def _placed(units: DataFrame, runs: Runs) -> DataFrame:
    """``__unit`` and its ``shard``: the run of its size that its number falls into."""
    size, groups, shards = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    order = np.argsort(size, kind="stable")
    size, groups, shards = size[order], groups[order], shards[order]
    ends = np.cumsum(groups)
    classes, first = np.unique(size, return_index=True)
    shared = units.sparkSession.sparkContext.broadcast((classes, (ends - groups)[first], ends, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, begin, ends, shards = shared.value
        for batch in batches:
            at = begin[np.searchsorted(classes, batch.column("__class").to_numpy())] + batch.column("__at").to_numpy()
            yield pa.record_batch([batch.column("__unit"), pa.array(shards[np.searchsorted(ends, at, "right")].astype(np.int32))],
                                  ["__unit", "shard"])

    return units.mapInArrow(run, "__unit string, shard int")
