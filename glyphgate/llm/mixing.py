"""Mixing sources to target weights by Pfair scheduling of blocks.

With shares a of a sum L, a source's j-th block is released at slot floor((j - 1) L / a) and due at
ceil(j L / a); in each slot the released block with the earliest deadline goes first.  All deadlines
hold, as the shares add up to one, so after any number of slots each source is less than one block from its
weight.  The shares are weights to ``BITS`` bits and every block is scheduled, on the driver: time and memory there grow with the
blocks, not with the rows.  Where a source runs out, a new phase begins: the others keep their releases and deadlines, and slots
in which none is released are skipped, so they go on with their shares.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphgate.llm.ranks import numbered
from glyphgate.llm.work import Folder
from glyphgate.operators.joins import BROADCAST_BYTES, estimated_bytes, lookup_join

BITS = 80                # of a share
CHUNK = 1024             # blocks of a source that are looked up together
BLOCK_ROWS = 16
TEMPERATURE = 0.7


def order(shares: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot, until all have placed their blocks."""
    total = sum(shares.values())
    waiting = [(0, s) for s in shares if blocks[s]]
    heapify(waiting)
    ready: list[tuple[int, str]] = []
    done = dict.fromkeys(shares, 0)
    now = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, s = heappop(waiting)
            heappush(ready, (-(-(done[s] + 1) * total // shares[s]), s))
        _, s = heappop(ready)
        yield s
        done[s] += 1
        now += 1
        if done[s] < blocks[s]:
            heappush(waiting, (done[s] * total // shares[s], s))


def period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of ``sum(shares)`` slots."""
    out = {s: [] for s in shares}
    for slot, s in enumerate(order({s: a for s, a in shares.items() if a}, shares)):
        out[s].append(slot)
    return out


def slots(blocks: Mapping[str, int], weights: Mapping[str, float]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The slots of each source's blocks, and the slots in which a source runs out.

    Sources without a positive weight come last, evenly.
    """
    weighed = {s: weights[s] for s in blocks if blocks[s] and weights.get(s, 0) > 0}
    known = sum(map(Fraction, weighed.values()))
    shares = {s: max(1, round(Fraction(w) / known * (1 << BITS))) for s, w in weighed.items()}
    rest = {s: 1 for s in blocks if blocks[s] and s not in shares}
    out, used = {s: np.zeros(n, np.int64) for s, n in blocks.items()}, dict.fromkeys(blocks, 0)
    slot, ends = 0, []
    for part in (shares, rest):
        for s in order(part, blocks):
            out[s][used[s]] = slot
            used[s] += 1
            if used[s] == blocks[s]:
                ends.append(slot)
            slot += 1
    return out, np.array(ends, np.int64)


class Mix(NamedTuple):
    schedule: DataFrame      # id, source, block, slot, offset, phase: one row per row of the table
    stops: DataFrame         # source, stop: the rank key of its first row after phase 0


def _source(source_col: str):
    return F.coalesce(F.col(source_col), F.lit(""))


def _chunks(spark, places: dict[str, np.ndarray], ends: np.ndarray) -> DataFrame:
    """``source``, ``chunk``, and the ``slots`` and ``phases`` of the blocks of that chunk."""
    cut = [(s, k, x[k * CHUNK:(k + 1) * CHUNK]) for s, x in places.items() for k in range(-(-len(x) // CHUNK))]
    kinds = pa.schema([("source", pa.string()), ("chunk", pa.int64()), ("slots", pa.list_(pa.int64())), ("phases", pa.list_(pa.int32()))])
    columns = ([c[0] for c in cut], [c[1] for c in cut], [c[2] for c in cut], [np.searchsorted(ends, c[2]).astype(np.int32) for c in cut])
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds))


def _rank_key(id_col: str):
    """Hash of an id, sorted as rows are numbered: as an unsigned number."""
    return F.xxhash64(id_col).bitwiseXOR(F.lit(-1 << 63))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id",
             source_col: str = "source", temperature: float = TEMPERATURE) -> Mix:
    """The slot of every row.  Weights default to the sources' row counts to the power ``temperature``.

    A source's rows are cut into blocks in the order of a hash of their ids.  A null source counts as the empty name.
    Up to the end of phase 0 the mix has its target weights; later phases hold what is left.  Every row has a place.
    """
    folder = Folder(docs.sparkSession)
    rows = folder.kept(docs.select(F.col(id_col).alias("id"), _source(source_col).alias("source")))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    weights = {s: n ** temperature for s, n in counts.items()} if weights is None else weights
    table = folder.kept(_chunks(docs.sparkSession, *slots({s: -(-n // block_rows) for s, n in counts.items()}, weights)))
    if estimated_bytes(table) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    placed = numbered(rows, ["source"], F.xxhash64("id"), ["id"], "at").select(
        "id", "source", F.expr(f"at div {block_rows}").alias("block"), F.expr(f"cast(at % {block_rows} AS int)").alias("offset"))
    found = folder.kept(placed.withColumn("chunk", F.expr(f"block div {CHUNK}")).join(table, ["source", "chunk"])
                        .withColumn("k", F.expr(f"cast(block % {CHUNK} AS int)"))
                        .select("id", "source", "block", F.get("slots", "k").alias("slot"), "offset", F.get("phases", "k").alias("phase")))
    stops = found.where("phase > 0").groupBy("source").agg(F.min(_rank_key("id")).alias("stop"))
    return Mix(found, stops)


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id",
          source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs``, unchanged, up to the place where the first source runs out, so that they have the weights.

    Rows are told apart by the hash of their id: repeated ids at the very end of a source's part go together.
    """
    stops = schedule(docs, weights, block_rows, id_col, source_col, temperature).stops.withColumnRenamed("source", "__source")
    rows = docs.withColumn("__source", _source(source_col)).join(F.broadcast(stops), "__source", "left")
    return rows.where(F.col("stop").isNull() | (_rank_key(id_col) < F.col("stop"))).select(*(docs[c] for c in docs.columns))


def ordered(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id",
            source_col: str = "source", temperature: float = TEMPERATURE, out: str = "mix_at") -> DataFrame:
    """All rows of ``docs`` with ``out``, their place in the mix.  Rows of one id and source share the first one's place.

    A column of the input that is already called ``out`` is replaced.
    """
    docs = docs.drop(out)
    found = schedule(docs, weights, block_rows, id_col, source_col, temperature).schedule
    places = Folder(docs.sparkSession).kept(
        found.groupBy(F.xxhash64("id", "source").alias("__place")).agg(F.min(F.col("slot") * block_rows + F.col("offset")).alias(out)))
    rows = docs.withColumn("__place", F.xxhash64(id_col, _source(source_col)))
    return lookup_join(rows, places, "__place").select(*docs.columns, out)
