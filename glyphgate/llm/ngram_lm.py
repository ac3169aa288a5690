"""Interpolated modified Kneser-Ney n-gram model: counted by Spark, kept as sorted hash arrays, scored through mmap.

Each order is a set of ``parts`` files, split by the leading bits of a 64-bit n-gram hash, with the
sorted hashes and a byte for each one's counts as arrays that any worker maps instead of loading.  The order-n pass shuffles
n-gram hashes that each chunk of text has already combined.  Lower orders need, for each n-gram, in how many
different ways it is extended.  No pass shuffles words or pairs of hashes for that: an occurrence of an
n-gram that occurs r times (looked up in the finished higher order) adds 1/r, so all of them add 1.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from glyphgate.llm import words as W
from glyphgate.llm.work import setting
from glyphgate.sources.sinks import work_dir

ORDER = 3
CHUNK = 6 << 20
MERGED = 1 << 18       # n-grams of a hash range that wait to be combined, at least
_U = np.uint64
START, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FIELDS = ("raw", "adjusted", "total", "once", "twice", "more")   # the last four describe the n-gram as a context


def ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each place, the places of tokens, their texts and numbers.

    A text is ``order`` - 1 starts, its words with A-Z lower-cased, and an end; the end is a token, starts aren't.
    """
    w = W.words(texts, lower=True)
    n = np.diff(w.first)
    pad = max(1, order - 1)
    begin = np.concatenate([[0], np.cumsum(n + pad + 1)])
    flat = np.full(begin[-1], START)
    rows = w.rows
    flat[begin[rows] + pad + np.arange(len(rows)) - w.first[rows]] = w.hashes
    flat[begin[1:] - 1] = END
    grams = [flat]
    for _ in range(1, order):
        longer = grams[-1].copy()
        longer[1:] = W.join(grams[-1][:-1], flat[1:])
        grams.append(longer)
    token = np.ones(len(flat), bool)
    for k in range(pad):
        token[begin[:-1] + k] = False
    place = np.flatnonzero(token)
    owner = np.repeat(np.arange(len(n)), n + 1)
    return grams, place, owner, place - begin[owner] - pad


def _tuples(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different columns of ``values``, the number of each column's tuple, and how often each comes."""
    mark = np.zeros(values.shape[1], _U)
    for row in values:
        mark = W.join(mark, np.ascontiguousarray(row, float).view(_U))
    _, first, code, times = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    return values[:, first], code, times


def _pack(key: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending keys as gaps, values as numbers of their few different tuples."""
    gaps = np.diff(key, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    table, code, _ = _tuples(values)
    parts = [pa.compress(x, "zstd", asbytes=True)
             for x in (gaps, code.astype(np.min_scalar_type(table.shape[1])).tobytes(), table.tobytes())]
    head = np.array([len(key), table.shape[1], *map(len, parts[:2])], "<i8").tobytes()
    return b"".join([head, *parts])


def _unpack(blob: bytes, fields: int) -> tuple[np.ndarray, np.ndarray]:
    n, distinct, *ends = np.frombuffer(blob[:32], "<i8").tolist()
    one, two = 32 + ends[0], 32 + sum(ends)
    kind = np.min_scalar_type(distinct)
    gaps = np.frombuffer(pa.decompress(blob[32:one], 8 * n, "zstd", asbytes=True), np.uint8)
    key = np.cumsum(np.ascontiguousarray(gaps.reshape(8, n).T).view(_U).ravel(), dtype=_U)
    code = np.frombuffer(pa.decompress(blob[one:two], kind.itemsize * n, "zstd", asbytes=True), kind)
    table = np.frombuffer(pa.decompress(blob[two:], 8 * distinct * fields, "zstd", asbytes=True), float)
    return key, table.reshape(fields, distinct)[:, code]


def _write(path: str, key: np.ndarray, values: np.ndarray) -> None:
    """Store one part: sorted keys, a byte each for one of the 255 commonest tuples of values or for "rare", the tuples, the rare ones' places.

    Whole or not at all, and once, however many attempts there are.
    """
    if os.path.exists(path):
        return
    table, code, times = _tuples(values)
    rank = np.empty(len(times), np.int64)
    rank[by := np.argsort(-times, kind="stable")] = np.arange(len(times))
    code = np.minimum(rank[code], 255).astype(np.uint8)
    rare = np.flatnonzero(code == 255)
    stored = np.concatenate([table[:, by[:255]], values[:, rare]], axis=1).astype(np.uint64)
    own = f"{path}-{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for x in (np.array([len(key), len(rare), stored.shape[1]], np.uint64), key, rare.astype(np.uint64), stored, code):
            out.write(x.tobytes())
    os.replace(own, path)     # another attempt's contents are equal


class Table:
    """The parts of one order, mapped when first needed."""

    def __init__(self, folder: str, parts: int, fields: int):
        self.folder, self.parts, self.fields, self.open = folder, parts, fields, {}

    def _part(self, number: int):
        if number not in self.open:
            self.open[number] = None
            if os.path.exists(path := f"{self.folder}/{number}"):
                with open(path, "rb") as f:     # the mapping outlives the file's descriptor, so that any number of parts can be open
                    held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
                n, rare, tuples = np.frombuffer(held, _U, 3).tolist()
                self.open[number] = (
                    np.frombuffer(held, _U, n, 24), np.frombuffer(held, _U, rare, 24 + 8 * n),
                    np.frombuffer(held, _U, self.fields * tuples, 24 + 8 * (n + rare)).reshape(self.fields, tuples),
                    np.frombuffer(held, np.uint8, n, 24 + 8 * (n + rare + self.fields * tuples)))
        return self.open[number]

    def get(self, key: np.ndarray) -> np.ndarray:
        """Fields by key (fields x len(key)); zero for unknown ones.  Keys ascend."""
        out = np.zeros((self.fields, len(key)))
        cuts = np.searchsorted(part_of(key, self.parts), np.arange(self.parts + 1))
        for number in range(self.parts):
            a, b = cuts[number], cuts[number + 1]
            stored = self._part(number) if a < b else None
            if stored is None:
                continue
            have, rare, values, code = stored
            at = np.minimum(np.searchsorted(have, key[a:b]), len(have) - 1)
            hit = np.flatnonzero(have[at] == key[a:b])
            at = at[hit]
            which = code[at].astype(np.int64)
            far = np.flatnonzero(which == 255)
            which[far] += np.searchsorted(rare, at[far].astype(_U))
            for f in range(self.fields):
                out[f, a + hit] = values[f][which]
        return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> _U(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(key), np.int64)


def _looked_up(table: Table, key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    out = np.empty((table.fields, len(key)))
    out[:, order] = table.get(key[order])
    return out


def _combined(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, with the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    edge = np.flatnonzero(first)
    return key[edge], np.stack([np.add.reduceat(row[order], edge) for row in value]) if len(edge) else value


@dataclass(frozen=True)
class Model:
    folder: str                        # on a file system that all workers mount
    order: int
    parts: int
    tokens: int                        # N: training tokens
    types: int                         # V: distinct ones
    adjusted: tuple[float, ...]        # sum, and numbers of 1, 2 and more, of the unigrams' adjusted counts
    discounts: tuple[tuple[float, float, float], ...]    # per order, for counts 1, 2 and more

    def tables(self) -> list[Table]:
        return [Table(f"{self.folder}/{k}", self.parts, 1 if k == self.order else len(FIELDS))
                for k in range(1, self.order + 1)]


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with adjusted counts 1, 2, 3 and 4."""
    one, two, three, four = counts
    y = one / (one + 2 * two) if one else 0.5
    out = []
    for k, (low, high) in enumerate(((one, two), (two, three), (three, four)), 1):
        out.append(min(max(k - (k + 1) * y * high / low, 0.05), k - 0.05) if low else 0.5 * k)
    return tuple(out)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, where: Column | None = None) -> Model:
    """Count a model over all rows of ``docs`` that ``where`` allows.

    Null texts are empty; an empty text counts as one end.  Repeated rows count each time.
    ``spark.checkpoint.dir`` must be a path that driver and workers mount alike (``file:`` or bare).
    """
    spark = docs.sparkSession
    home = urlparse(work_dir(spark))
    if home.scheme not in ("", "file"):
        raise ValueError("the model's arrays are mapped: spark.checkpoint.dir must be a mounted folder")
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 << max(0, (wanted - 1).bit_length())
    rows = (docs if where is None else docs.where(where)).select(F.col(text_col).alias("__text"))
    found, stats = [], {}
    with setting(spark, DROP, "true"):      # else a pass's shuffle files stay until the driver collects its garbage
        for k in range(order, 0, -1):
            fields = 1 if k == order else len(FIELDS)
            higher = None if k == order else (f"{home.path}/{k + 1}", parts, 1 if k + 1 == order else len(FIELDS))
            sent = rows.mapInArrow(_counter(k, order, parts, higher), "part int, blob binary")
            done = (sent.repartition(parts, "part").mapInArrow(_merger(f"{home.path}/{k}", fields, parts),
                                                               "part int, stats array<double>").collect())
            stats[k] = np.sum([r["stats"] for r in done] or [[0.0] * 8], axis=0)
            found.insert(0, discounts([int(x) for x in stats[k][:4]]))
    s = stats[1]
    return Model(home.path, order, parts, int(s[5]), int(s[6]), (float(s[4]), float(s[0]), float(s[1]), float(s[7])), tuple(found))


def _counter(k: int, order: int, parts: int, higher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*higher) if higher else None
        for batch in batches:
            for chunk in W.chunks(batch, "__text", CHUNK):
                grams, place, _, number = ngrams(chunk.column("__text"), min(order, k + 1))
                if table is None:
                    key, value = np.unique(grams[k - 1][place], return_counts=True)
                    value = value[None].astype(float)
                else:
                    up = _looked_up(table, grams[k][place])
                    share, adjusted = 1 / up[0], up[min(1, len(up) - 1)]
                    value = np.zeros((len(FIELDS), len(grams[0])))    # by place: the n-gram that ends there, also as a context
                    value[0, place] = 1
                    value[1, place] = np.where(number < k - 1, 1, share)    # n-grams from the start of a text keep their raw counts
                    for f, x in enumerate((adjusted, adjusted == 1, adjusted == 2, adjusted >= 3), 2):
                        value[f, place - 1] = x * share
                    met = np.zeros(len(grams[0]), bool)
                    met[place] = met[place - 1] = True
                    key, value = _combined(grams[k - 1][met], value[:, met])
                cuts = np.searchsorted(part_of(key, parts), np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                yield pa.record_batch([
                    pa.array(some, pa.int32()),
                    pa.array([_pack(key[cuts[p]:cuts[p + 1]], value[:, cuts[p]:cuts[p + 1]]) for p in some], pa.binary())],
                    ["part", "blob"])
    return run


def _joined(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _combined(np.concatenate([k for k, _ in got]), np.concatenate([v for _, v in got], axis=1))


def _merger(folder: str, fields: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting: dict[int, int] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part"), batch.column("blob"), strict=True):
                part = part.as_py()
                got = held.setdefault(part, [])
                got.append(_unpack(blob.as_py(), fields))
                waiting[part] = waiting.get(part, 0) + len(got[-1][0])
                if waiting[part] > max(MERGED, len(got[0][0])):     # as many as are combined: each takes part in few sorts
                    held[part], waiting[part] = [_joined(got)], 0
        for part in list(held):
            key, value = _joined(held.pop(part))
            value = np.rint(value)
            os.makedirs(folder, exist_ok=True)
            _write(f"{folder}/{part}", key, value)
            adjusted = value[min(1, fields - 1)]
            stats = [float((adjusted == c).sum()) for c in (1, 2, 3, 4)]
            stats += [float(adjusted.sum()), float(value[0].sum()), float((value[0] > 0).sum()), float((adjusted >= 3).sum())]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([stats], pa.list_(pa.float64()))], ["part", "stats"])
    return run


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(count >= 3, d[2], np.where(count == 2, d[1], np.where(count == 1, d[0], 0.0)))


def probabilities(model: Model, tables: list[Table], grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability and raw unigram count of the token at each place."""
    total, one, two, more = model.adjusted
    d = model.discounts[0]
    records = _looked_up(tables[0], grams[0])
    raw = records[0][place]
    for k in range(1, model.order + 1):
        count = records[min(1, len(records) - 1)][place]
        if k > 1:
            known = np.maximum(context[0], 1e-300)
            d = model.discounts[k - 1]
            left = (d[0] * context[1] + d[1] * context[2] + d[2] * context[3]) / known
            p = np.where(context[0] > 0, np.maximum(count - _discount(count, d), 0) / known + left * p, p)
        elif total:
            left = (d[0] * one + d[1] * two + d[2] * more) / total
            p = np.maximum(count - _discount(count, d), 0) / total + left / (model.types + 1)
        else:
            p = np.full(len(place), 1 / (model.types + 1))
        if k < model.order:
            context = records[2:, place - 1]
            records = _looked_up(tables[k], grams[k])
    return p, raw


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all if None) plus ``n_tokens``, ``n_known``, ``base_score``, ``score`` and ``perplexity``.

    ``base_score`` is the unigram log10 probability with add-one smoothing over the known types and one unknown, ``score`` the model's.  Null texts are empty: one end.
    """
    carry = docs.columns if carry is None else carry
    kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    if clash := set(kinds) & set(carry):
        raise ValueError(f"columns {sorted(clash)} exist; rename them")
    plain = asdict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**plain)
        tables = own.tables()
        for batch in batches:
            for chunk in W.chunks(batch, text_col, CHUNK):
                grams, place, owner, _ = ngrams(chunk.column(text_col), own.order)
                p, count = probabilities(own, tables, grams, place)
                n = np.bincount(owner, minlength=chunk.num_rows)
                base = np.log10(count + 1) - np.log10(float(own.tokens + own.types + 1))
                made = [np.bincount(owner, x, chunk.num_rows) for x in (count > 0, base, np.log10(p))]
                out = [pa.array(n, pa.int64()), pa.array(made[0].astype(np.int64)), pa.array(made[1]), pa.array(made[2]),
                       pa.array(10 ** np.minimum(-made[2] / n, 300))]
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in carry), *out], [*carry, *kinds])

    schema = StructType([docs.schema[c] for c in carry])
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
