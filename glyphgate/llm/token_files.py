"""Token ids of a corpus as Parquet list columns: ordered, delta or dictionary encoded, selectively readable.

Files hold one row per document: ``id``, ``part`` (number of the file), ``at`` and ``until`` (where its ids begin and
end in the file's stream), ``n_tokens`` and ``ids``.  Numbers are delta encoded (version 2 pages); ``ids`` are dictionary or delta encoded.
Row groups and pages have set sizes, and Spark's writer adds column and offset indexes, so that a reader of some
documents or of a stretch of the token stream touches the pages that hold them, and a reader of counts touches no ids.

Nulls: a null text is empty and gets only the end id; null document ids come first.  Rows of one id are ordered by
a hash of their text, repeated rows stay.  An empty table gives files without rows.

Texts are encoded in pieces cut before single spaces, where the splitting pattern of byte-level vocabularies always
cuts, and before line ends, or punctuation after a letter, where the file's own splitting does. The different pieces of a
group of texts are looked up among those seen before in the worker, or encoded; rows leave in batches of bounded size.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from contextlib import AbstractContextManager
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from glyphgate.llm import words as W
from glyphgate.llm.schemas import schema
from glyphgate.llm.work import setting

__all__ = ["documents", "encode", "manifest", "read", "small_batches", "token_range", "write"]

SEGMENT = 256 << 10        # characters of a text that are taken at once
GROUP = 4 << 20            # characters whose different pieces are looked up at once
BATCH_BYTES = 4 << 20      # bytes of text, or of ids, that go to or come from a Python worker as one batch
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
JOINED = 2048              # bytes of new pieces that are encoded as one text
KNOWN = 9 << 16            # pieces whose ids a worker remembers
TEXT_PER_FILE = 32 << 20
ROW_GROUP_BYTES = 32 << 20
ROW_GROUP_ROWS = 1 << 16
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2048
FILE_COLUMNS = "part int, at long, until long, n_tokens int, ids array<int>"
# a character that is no white space under any definition
_SOLID = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]"
_CUT = re.compile(rf"(?<={_SOLID})(?= {_SOLID})")
_SOLID_BYTE = np.ones(256, bool)
_SOLID_BYTE[[*range(33), 127]] = False
_UNSURE = {0xC2: 2, 0xE1: 3, 0xE2: 3, 0xE3: 3, 0xEF: 3}     # first bytes of characters some of which are white space, and their length
_NEWLINE = "\u010a"        # as byte-level splitting writes it
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _solid(data: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 is part of a character that is certainly no white space."""
    out = _SOLID_BYTE[data]
    for lead, size in _UNSURE.items():
        at = np.flatnonzero(data == lead)
        for k in range(size):
            out[at + k] = False
    return out


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut only where pieces are cut."""
    first = 0
    while len(text) - first > limit:
        cut = _CUT.search(text, first + limit)
        if not cut:
            break
        yield text[first:cut.start()]
        first = cut.start()
    yield text[first:]


class _Coder:
    """Ids of texts as little-endian 32-bit numbers, through a bounded memory of pieces.

    ``known`` numbers the pieces in the order of its keys; the ids of piece k are ``flat[at[k]:at[k + 1]]``, and ``seen`` counts
    the groups of texts that had it. Words seen again make up most of a text, words seen once most of the different ones.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(tokenizer), {}
        self.flat, self.at, self.seen = np.zeros(0, "<i4"), np.zeros(1, np.int64), np.zeros(0, np.int64)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        added = self.model.get_added_tokens_decoder()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)      # one character of a token stands for one byte
        for token, k in vocabulary.items():
            self.bytes[k] = len(token.encode()) if k in added else len(token)

        split, added = self.model.pre_tokenizer, "".join(t.content for t in added.values())
        self.ends = np.zeros(256, bool)      # punctuation that never shares a token with a letter before it
        self.ends[[ord(c) for c in ",.;:!?" if split and c not in added and [p for p, _ in split.pre_tokenize_str(f"a{c}")] == ["a", c]]] = True
        self.gaps = np.zeros(256, bool)      # white space that begins a piece between solid characters
        self.gaps[32] = True
        self.gaps[10] = bool(split) and all([p for p, _ in split.pre_tokenize_str(f"{a}\n{b}")][1:2] == [_NEWLINE] for a in "a1." for b in "a1.")

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin, and the end of the last one."""
        solid = _solid(data)
        solid = np.concatenate([solid, [False]])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.gaps[data[1:]] & solid[:-2] & solid[2:]
        cut[at[1:] - 1] = False             # white space that ends a text stays with what is before it
        mark = np.flatnonzero(self.ends[data[1:]])
        cut[mark[_LETTER[data[mark]]] + 1] = True
        cut[at] = True
        return np.flatnonzero(cut)

    def _joined(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces encoded end to end, how many each piece has, and which pieces these are: those whose ends are ends of ids."""
        data, at = W.buffers(new)
        first = np.flatnonzero(np.diff(at[:-1] // JOINED, prepend=-1))       # of each text
        last = np.append(first[1:], len(new))
        raw, begin, end = data.tobytes(), at[first], at[last]
        coded = self._plain([raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())])
        n = np.array([len(ids) for ids in coded], np.int64)
        flat = np.concatenate([*coded, np.zeros(0, "<i4")])
        if not len(flat):
            return flat, np.zeros(0, np.int64), np.zeros(len(new), bool)
        to = np.cumsum(n)
        reached = np.concatenate([[0], np.cumsum(self.bytes[flat])])
        good = reached[to] - reached[to - n] == end - begin
        reached = np.minimum(reached[1:] + np.repeat(begin - reached[to - n], n), np.repeat(end, n))
        stop = np.minimum(np.searchsorted(reached, at[1:]) + 1, len(flat))
        good &= np.logical_and.reduceat(reached[stop - 1] == at[1:], first)
        start = np.concatenate([[0], stop[:-1]])
        start[first] = to - n
        kept = np.repeat(good, last - first)
        return flat[np.repeat(good, n)], (stop - start)[kept], kept

    def _learn(self, new: pa.Array, names: list[str]) -> np.ndarray:
        """Remember pieces and return their numbers; those that begin with one gap and end solid are encoded end to end."""
        data, at = W.buffers(new)
        solid, first = _solid(data), at[:-1]
        inner = (np.diff(at) > 1) & self.gaps[data[first]] & solid[np.minimum(first + 1, len(data) - 1)] & solid[at[1:] - 1]
        order = np.flatnonzero(inner)
        flat, n, kept = self._joined(new.filter(pa.array(inner)))
        inner[order[~kept]] = False
        alone = np.flatnonzero(~inner)
        order = np.concatenate([order[kept], alone])
        coded = self._plain([names[k] for k in alone.tolist()])

        old, used = len(self.known), self.at[-1]
        self.flat = np.concatenate([self.flat[:used], flat, *coded])
        self.at = np.concatenate([self.at, used + np.cumsum(np.concatenate([n, [len(ids) for ids in coded]]).astype(np.int64))])
        self.seen = np.concatenate([self.seen, np.zeros(len(order), np.int64)])
        self.known.update(zip([names[k] for k in order.tolist()], range(old, old + len(order))))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(old, old + len(order))
        return number

    def _forget(self, left: int) -> None:
        """Keep the pieces that most groups had; of those that as many had, the last ones."""
        n = len(self.known)
        kept = np.zeros(n, bool)
        kept[np.argpartition(self.seen * n + np.arange(n), n - left)[n - left:]] = True
        size = np.diff(self.at)
        self.flat = self.flat[np.repeat(kept, size)]
        self.at = np.concatenate([[0], np.cumsum(size[kept])])
        self.seen = self.seen[kept]
        self.seen -= self.seen >> 2         # what was common long ago makes room in the end
        names = list(compress(self.known, kept.tolist()))
        self.known.clear()
        self.known.update(zip(names, range(left)))

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts."""
        data, at = W.buffers(texts)
        if not len(data):
            return np.zeros(0, "<i4"), np.zeros(len(texts) + 1, np.int64)
        cut = self._cuts(data, at)
        pieces = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(data)).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN:
            self._forget(KNOWN * 5 // 8)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(pieces.dictionary.take(pa.array(new)), [names[k] for k in new.tolist()])
        self.seen[number] += 1
        first, code = self.at[number], pieces.indices.to_numpy()
        n = (self.at[number + 1] - first).astype(np.int32)[code]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(first.astype(np.int32)[code] - (ends - n), n)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place], np.concatenate([[0], ends])[np.searchsorted(cut, at)]

    def ids(self, texts: list[str]) -> list[bytes]:
        flat, at = self.coded(pa.array(texts, pa.large_string()))
        return [flat[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]


_CODERS: dict[str, _Coder] = {}


def _coder(tokenizer: str) -> _Coder:
    """One per worker process: its memory serves the tasks that follow, too."""
    if tokenizer not in _CODERS:
        _CODERS[tokenizer] = _Coder(tokenizer)
    return _CODERS[tokenizer]


def _groups(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Segments of the texts with the number of their text, in groups of bounded size."""
    group, owner, size = [], [], 0
    for k, text in enumerate(texts):
        for part in segments(text):
            if group and size + len(part) > GROUP:
                yield group, owner
                group, owner, size = [], [], 0
            group.append(part)
            owner.append(k)
            size += len(part)
    if group:
        yield group, owner


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) as (id, n_tokens, ids)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = _coder(tokenizer)
    for batch in batches:
        for chunk in W.chunks(batch, "text", BATCH_BYTES):
            if np.diff(W.buffers(chunk.column(1))[1]).max() <= SEGMENT:
                ids, at = coder.coded(chunk.column(1))
            else:
                parts, counts = [], np.zeros(chunk.num_rows, np.int64)
                for group, owner in _groups([t or "" for t in chunk.column(1).to_pylist()]):
                    coded = coder.ids(group)
                    np.add.at(counts, owner, [len(ids) // 4 for ids in coded])
                    parts += coded
                ids, at = np.frombuffer(b"".join(parts), "<i4"), np.concatenate([[0], np.cumsum(counts)])
            flat = np.insert(ids, at[1:], end_id)
            offsets = pa.array(at + np.arange(len(at)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(np.diff(at) + 1, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))],
                names=["id", "n_tokens", "ids"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded batches of one file, in order, with the place of each document in the file's stream."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy().astype(np.int64)
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(ends),
             batch.column("n_tokens"), batch.column("ids")], names=["id", "part", "at", "until", "n_tokens", "ids"])
        at = int(ends[-1]) if len(n) else at


def small_batches(spark: SparkSession) -> AbstractContextManager:
    """Queries that run in here send rows to Python in batches bounded by bytes: ten thousand long lists would come at once."""
    return setting(spark, BATCH_SETTING, spark.conf.get(BATCH_SETTING, None) or str(BATCH_BYTES))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """``id``, ``n_tokens`` and ``ids`` of each row: the text's ids without special ones added, then ``end_id``.

    ``tokenizer`` is a file of the tokenizers library that every executor can open.
    """
    return _rows(docs, id_col, text_col).mapInArrow(
        lambda batches: _encoded(batches, tokenizer, end_id), schema("n_tokens int, ids array<int>", id=docs.schema[id_col].dataType))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
          text_per_file: int = TEXT_PER_FILE, row_group_bytes: int = ROW_GROUP_BYTES, row_group_rows: int = ROW_GROUP_ROWS,
          page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, encoding: str = "dictionary") -> None:
    """Encode documents and write them in ascending order of id, the ids of about ``text_per_file`` bytes of text a file.

    Texts are dealt to files by ranges of id, hash and place in the input, so that one id with very many rows
    spreads over files; they are encoded, once, by the tasks that write, and a lost task encodes its own file again.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // text_per_file))
    order = [F.col("id").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    ordered = (
        rows.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text"))
    with small_batches(docs.sparkSession):
        (ordered.mapInArrow(lambda batches: _placed(_encoded(batches, tokenizer, end_id)), schema(FILE_COLUMNS, id=docs.schema[id_col].dataType))
         .write.option("parquet.writer.version", "PARQUET_2_0")
         .option("parquet.enable.dictionary", "false")
         .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
         .option("parquet.block.size", row_group_bytes).option("parquet.block.row.count.limit", row_group_rows)
         .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).parquet(path))


def read(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """The files' rows; select few columns and only those are read."""
    return spark.read.schema(schema(FILE_COLUMNS, id=id_type or T.LongType())).parquet(path)


def manifest(rows: DataFrame) -> DataFrame:
    """``part``, ``n_docs``, ``n_tokens``, ``first_id``, ``last_id`` and ``start`` of each file.

    One row per file, from counts alone; the sum runs over files, never over documents.
    """
    files = rows.groupBy("part").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def with_start(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rows with ``start``, the ids of all documents before them.  The manifest (one row per file) is broadcast."""
    starts = (manifest(rows) if found is None else found).select("part", F.col("start").alias("__start"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("__start") + F.col("at")).drop("__start")


def documents(rows: DataFrame, chosen: Column) -> DataFrame:
    """Rows whose ``id`` meets a condition, which reaches the page indexes of the sorted ids."""
    return rows.where(chosen)


def token_range(rows: DataFrame, first: int, last: int, found: DataFrame | None = None) -> DataFrame:
    """``id``, ``start`` and ``ids`` of the stretch [first, last) of the whole token stream, documents cut at its ends.

    The manifest's few files that meet the stretch become conditions on ``part``, ``at`` and ``until``, which reach the scan.
    """
    found = manifest(rows) if found is None else found
    bounds = (found.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
              .agg(F.min("part"), F.max("part"), F.min("start"), F.max("start")).first())
    low, high, start_low, start_high = (x if x is not None else 0 for x in bounds)
    near = rows.where(F.col("part").between(low, high)
                      & ((F.col("part") > low) | (F.col("until") > first - start_low))
                      & ((F.col("part") < high) | (F.col("at") < last - start_high)))
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("start")).cast("int")
    stop = F.least(F.col("n_tokens").cast("long"), F.lit(last) - F.col("start")).cast("int")
    return (with_start(near, found)
            .where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
            .select("id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, stop - skip).alias("ids")))


def digests(rows: DataFrame) -> DataFrame:
    """``id``, ``part``, ``at``, ``n_tokens`` (counted from the ids) and ``ids_crc32`` over little-endian 32-bit ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CODERS.clear()      # a worker that reads needs no pieces of the texts it has encoded before
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8)
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), batch.column("at"), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["id", "part", "at", "n_tokens", "ids_crc32"])

    kept = schema("part int, at long, n_tokens long, ids_crc32 long", id=rows.schema["id"].dataType)
    return rows.select("id", "part", "at", "ids").mapInArrow(run, kept)
