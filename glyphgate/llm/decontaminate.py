"""Benchmark decontamination: pigeonhole pieces, exact hits, bit-parallel verification.

Texts and items are normalised (A-Z lower-cased, each run of white space one space).  An item of n characters may
be changed in up to k = n // ``PER_ERROR`` places and is cut into k + 1 pieces, so one piece of a copy is
unchanged.  Hashes of short grams that begin the pieces find those places in all texts; a window around
each is verified with Myers' bit-parallel edit distance of the whole item to any part of the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from glyphgate.llm import words as W

PER_ERROR = 20           # characters of an item per tolerated edit
GRAMS = (16, 14, 12, 10, 8, 6, 4, 3, 2, 1)    # bytes of a piece that are looked up: the most that all pieces of an item have
BLOCK_ITEMS = 20_000     # items that are searched for in one pass over the texts
FILTER_BITS = 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15


class Item(NamedTuple):
    key: int             # row of the block
    text: str
    budget: int
    gram: int
    pieces: list[tuple[bytes, int]]     # leading gram, and its byte offset in the item


def normalise(text: str | None) -> str:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    return " ".join(x for x in folded.split(" ") if x)


def cut(key: int, text: str | None, per_error: int = PER_ERROR) -> Item | None:
    """Pieces of an item; None for an item without text."""
    text = normalise(text)
    if not text:
        return None
    budget = len(text) // per_error
    edge = [i * len(text) // (budget + 1) for i in range(budget + 2)]
    raw = [(text[a:b].encode(), len(text[:a].encode())) for a, b in zip(edge, edge[1:], strict=False)]
    gram = next(g for g in GRAMS if g <= min(len(p) for p, _ in raw))
    return Item(key, text, budget, gram, [(p[:gram], at) for p, at in raw])


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part (Myers, 1999)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        now += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if now < best:
            best, end = now, j
    return best, end


def _fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets of the texts (leading white space is dropped, trailing kept as one space)."""
    space = W.SPACE[data]
    drop = space.copy()
    drop[1:] &= space[:-1]
    begin = at[:-1][at[:-1] < at[1:]]
    drop[begin] = space[begin]
    kept = np.flatnonzero(~drop)
    out = data[kept]
    out = np.where(space[kept], np.uint8(32), out + np.uint8(32) * ((out >= 65) & (out <= 90)))
    return out, np.searchsorted(kept, at)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(0, gram, 4):     # four bytes at a time, then their combination
        part = np.zeros(n, np.uint32)
        for j in range(k, min(gram, k + 4)):
            part = (part << np.uint32(8)) | data[j:j + n]
        out = out * _U(_B) + part
    return out ^ (out >> _U(29))


class Index(NamedTuple):
    items: list[Item]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]   # by size: hashes, items, offsets, filter


def index(items: list[Item]) -> Index:
    grams = {}
    for size in sorted({i.gram for i in items}):
        own = [(p, n, at) for n, i in enumerate(items) if i.gram == size for p, at in i.pieces]
        hashed = np.concatenate([_gram_hashes(np.frombuffer(p, np.uint8), size) for p, _, _ in own])
        order = np.argsort(hashed, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(hashed & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        grams[size] = (hashed[order], np.array([n for _, n, _ in own])[order], np.array([a for _, _, a in own])[order], seen)
    return Index(items, grams)


def _places(found: Index, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct (text, item, assumed begin) of all piece hits, begins within an item's budget merged."""
    out = [np.zeros((0, 3), np.int64)]
    for size, (hashes, items, offsets, seen) in found.grams.items():
        here = _gram_hashes(data, size)
        maybe = np.flatnonzero(seen[(here & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        low, high = np.searchsorted(hashes, here[maybe]), np.searchsorted(hashes, here[maybe], "right")
        n = high - low
        place = np.repeat(maybe, n)
        which = np.repeat(low, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        row = np.searchsorted(at, place, "right") - 1
        whole = place + size <= at[row + 1]
        out.append(np.stack([row, items[which], place - offsets[which]], 1)[whole])
    places = np.concatenate(out)
    places = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
    if not len(places):
        return places
    budget = np.array([4 * i.budget for i in found.items])
    new = np.ones(len(places), bool)
    new[1:] = ((places[1:, :2] != places[:-1, :2]).any(1) | (places[1:, 2] - places[:-1, 2] > budget[places[1:, 1]]))
    return np.column_stack([places[new], np.append(places[:, 2][np.flatnonzero(new)[1:] - 1], places[-1, 2])])


def matches(found: Index, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """Text, item number and least distance of every item that a text holds within its budget."""
    data, at = _fold(*W.buffers(texts))
    best: dict[tuple[int, int], int] = {}
    for row, number, first, last in _places(found, data, at).tolist():
        item = found.items[number]
        slack, size = 4 * item.budget, len(item.text.encode())
        a, b = max(at[row], first - slack), min(at[row + 1], last + size + slack)
        d, _ = distance(item.text, data[a:b].tobytes().decode("utf-8", "ignore"))
        if d <= item.budget and d < best.get((row, number), d + 1):
            best[row, number] = d
    for (row, number), d in best.items():
        yield row, number, d


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    blocks = -(-rows.count() // BLOCK_ITEMS)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", per_error: int = PER_ERROR) -> DataFrame:
    """``doc``, ``item``, ``budget``, ``distance``: one row per row of ``docs`` and item it holds within the budget.

    Null or blank texts and items hold and are nothing.  Repeated items are reported each.
    """
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        part = _search(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text")), block, per_error,
                       benchmark.schema[item_id].dataType)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(F.col(id_col).alias("doc"), F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item"),
                          F.lit(0).alias("budget"), F.lit(0).alias("distance")).where("false")
    return out


def _search(docs: DataFrame, block: list[tuple], per_error: int, kind) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index([i for i in (cut(k, t, per_error) for k, (_, t) in enumerate(shared.value)) if i])
        for batch in batches:
            for part in W.chunks(batch, "__text"):
                got = list(matches(found, part.column("__text")))
                yield pa.record_batch([
                    part.column("doc").take(pa.array([r for r, _, _ in got], pa.int64())),
                    pa.array([shared.value[found.items[n].key][0] for _, n, _ in got], item_type),
                    pa.array([found.items[n].budget for _, n, _ in got], pa.int32()),
                    pa.array([d for _, _, d in got], pa.int32())], ["doc", "item", "budget", "distance"])

    item_type = to_arrow_type(kind)
    schema = StructType([docs.schema["doc"]]).add("item", kind).add("budget", "integer").add("distance", "integer")
    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          per_error: int = PER_ERROR) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no item within its budget."""
    for block in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = index([i for i in (cut(k, t, per_error) for k, (_, t) in enumerate(shared.value)) if i])
            for batch in batches:
                for part in W.chunks(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _, _ in matches(found, part.column(text_col))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
