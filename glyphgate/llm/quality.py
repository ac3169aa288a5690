"""Quality rules: a calibrated logistic regression over hashed word and character n-grams, behind fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from glyphgate.llm import sample, words as W

BUCKETS = 1 << 15        # per feature family
TRAIN_ROWS = 1500        # labelled rows of each class that a model is fitted on, at most
KEEP_PROBABILITY = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
FAMILIES = 4             # words, word pairs, character 2-grams, character 4-grams


def _feature_runs(w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: bucket of each n-gram, and the n + 1 bounds of the texts among them."""
    shift = _U(64 - BUCKETS.bit_length() + 1)
    yield (W.mix(w.hashes) >> shift).astype(np.int32), w.first
    pair, begin = W.shingles(w, 2)
    yield (pair >> shift).astype(np.int32), np.searchsorted(begin, w.first)
    for size in (2, 4):
        n = len(w.data) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(w.at), np.int64)
            continue
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code = code * np.uint32(0x01000193) + w.data[k:k + n]
        code *= np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
        inside = np.ones(n, bool)
        for k in range(1, size):     # n-grams that cross into the next text don't count
            crossing = w.at[1:-1] - k
            inside[crossing[(crossing >= 0) & (crossing < n)]] = False
        where = np.flatnonzero(inside)
        yield bucket[where], np.searchsorted(where, w.at)


def _mean_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse relative frequencies of each text: indices below FAMILIES * BUCKETS, and values."""
    w = W.words(texts)
    parts = [[] for _ in range(len(w.at) - 1)]
    for family, (bucket, bounds) in enumerate(_feature_runs(w)):
        for i, part in enumerate(parts):
            own, n = np.unique(bucket[bounds[i]:bounds[i + 1]], return_counts=True)
            part.append((own + family * BUCKETS, (n / max(1, n.sum())).astype(np.float32)))
    return [(np.concatenate([a for a, _ in p]), np.concatenate([b for _, b in p])) for p in parts]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray      # FAMILIES * BUCKETS
    slope: float             # of the calibration curve
    intercept: float

    def probability(self, w: W.Words) -> np.ndarray:
        raw = sum(_mean_of(self.weights[family * BUCKETS + bucket], bounds)
                  for family, (bucket, bounds) in enumerate(_feature_runs(w)))
        return sample.sigmoid(self.slope * raw + self.intercept)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, held: np.ndarray, prior: float,
        rounds: int = 60) -> Model:
    """Fit on the rows that aren't ``held``; calibrate on the held ones, weighted to the share ``prior`` of ones."""
    weights, velocity, square = (np.zeros(FAMILIES * BUCKETS) for _ in range(3))
    bias = 0.0
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    bounds = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    owner = np.repeat(np.arange(len(rows)), np.diff(bounds))
    value *= np.sqrt(len(rows) / (1 + np.bincount(index, minlength=len(weights))))[index]   # rare n-grams count more
    scale = np.zeros(len(weights))
    scale[index] = np.sqrt(len(rows) / (1 + np.bincount(index, minlength=len(weights))))[index]
    sums = lambda: np.bincount(owner, value * weights[index], len(rows))
    balance = np.where(label == 1, 0.5 / max(1, (label[~held] == 1).sum()), 0.5 / max(1, (label[~held] == 0).sum()))
    balance[held] = 0
    for k in range(1, rounds + 1):
        error = balance * (sample.sigmoid(sums() + bias) - label)
        grad = np.bincount(index, value * error[owner], len(weights)) + 1e-6 * weights
        velocity = 0.9 * velocity + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        weights -= 0.5 * (velocity / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-6)
        bias -= error.sum()
    raw, apart = sums(), held if len(set(label[held])) == 2 else np.ones(len(rows), bool)
    share = np.where(label == 1, prior / max(1, (label[apart] == 1).sum()), (1 - prior) / max(1, (label[apart] == 0).sum()))
    slope, intercept = sample.platt(raw[apart], label[apart], share[apart] * apart.sum())
    return Model((weights * scale).astype(np.float32), slope, intercept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = TRAIN_ROWS) -> Model | None:
    """Fit a model on a bounded, repeatable sample of labelled rows; None when a class has no row.

    A quarter of the sample, chosen by the id's CRC, calibrates the probability and isn't fitted on.
    """
    chosen = sample.balanced(labels, label_col, per_class, id_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "__text", 4 << 20):
                made = features(part.column("__text"))
                yield pa.record_batch({
                    "id": part.column("__id").cast(pa.string()), "label": part.column("__label"),
                    "index": pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()),
                    "value": pa.array([b.tobytes() for _, b in made], pa.binary())})

    got = rows.mapInArrow(sparse, "id string, label int, index binary, value binary").collect()
    label = np.array([r["label"] for r in got])
    if len(set(label)) < 2:
        return None
    got.sort(key=lambda r: (r["id"], bytes(r["index"])))
    label = np.array([r["label"] for r in got])
    held = np.array([crc32(r["id"].encode()) % 4 == 0 for r in got])
    if len(set(label[~held])) < 2:
        held[:] = False
    n = sample.class_counts(labels, label_col, id_col)
    return fit([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got],
               label, held, n.get(1, 0) / max(1, sum(n.values())))


def _base(w: W.Words) -> dict[str, np.ndarray]:
    """Counts of the base rules, per text."""
    n, rows = len(w.at) - 1, w.rows
    def per_text(mask):
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[w.at[1:]] - total[w.at[:-1]]

    window, begin = W.shingles(w, REPEAT_WINDOW)
    key = W.join(window, rows[begin].astype(_U))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + REPEAT_WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    starts, ends = W.spans(w.data, w.at, _NEWLINE)
    holds = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[holds], ends[holds]
    owner = np.searchsorted(w.at, starts, "right") - 1
    distinct = np.unique(W.join(W.span_hashes(w.data, starts, ends), owner.astype(_U)), return_index=True)[1]
    again = np.bincount(owner, minlength=n) - np.bincount(owner[distinct], minlength=n)
    return {
        "n_words": np.diff(w.first), "word_chars": per_text(((w.data & 0xC0) != 0x80) & ~W.SPACE[w.data]),
        "n_symbols": per_text(_SYMBOL[w.data]), "n_dup_lines": again,
        "n_repeat_words": np.bincount(rows[repeated], minlength=n),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: float = KEEP_PROBABILITY,
          prefix: str = "", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all if None) plus the base counts, ``base_failed``, ``quality`` (probability) and ``kept``.

    A text fails the base rules with fewer than MIN_WORDS words, or when over MAX_REPEAT_PERCENT of
    them lie in 5-word windows that occur twice or more.  Null and empty texts count as texts without
    words, so they fail.  ``kept`` is false for failed texts, else ``quality >= keep``; without a model
    ``quality`` is null and the base rules decide.  Row for row: repeated rows stay repeated.
    ``prefix`` goes before the new columns' names where those clash with columns of ``docs``.
    """
    names = [f"{prefix}{c}" for c in (*COUNTS, "base_failed", "quality", "kept")]
    carry = docs.columns if carry is None else carry
    if clash := set(names) & set(carry):
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.slope, model.intercept))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text_col):
                w = W.words(part.column(text_col))
                base = _base(w)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                p = Model(*shared.value).probability(w) if shared.value else np.full(part.num_rows, np.nan)
                kept = ~failed & ((p >= keep) if shared.value else True)
                made = [pa.array(base[c], pa.int64()) for c in COUNTS]
                made += [pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *made], [*carry, *names])

    kinds = ["long"] * len(COUNTS) + ["boolean", "double", "boolean"]
    schema = StructType([docs.schema[c] for c in carry])
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(rate, schema)
