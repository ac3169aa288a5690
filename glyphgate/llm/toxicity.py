"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of ASCII letters and digits and non-ASCII bytes with at least one non-digit, A-Z
lower-cased.  Its bag is the word itself and its byte n-grams within ``<word>``; the bag's vectors are averaged, and
a linear softmax over the average (two classes, so one weight vector) gives the word's logit.  An unseen
spelling still has the n-grams it shares with known ones.  Embeddings and weights are trained
together on the words of labelled texts.  A text is scored on the average of its ``SALIENT`` words of highest
logit, so a long text doesn't dilute what a few of its words say; a logistic curve fitted on texts kept out of the
training turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from glyphgate.llm import sample, words as W

BITS, DIM = 16, 8
NGRAMS = (4, 5, 6, 7)
TRAIN_ROWS = 1000         # labelled texts of each class that a model is fitted on, at most
EPOCHS = 25
PRIOR = 4.0               # pseudo texts of even class that each word has been seen in
SALIENT = 3
PREDICT_FROM = 0.7
_U = np.uint64
_STOP = np.ones(256, bool)
_STOP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends, hashes and texts of the words."""
    data, at = W.buffers(texts)
    starts, ends = W.spans(data, at, _STOP)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    keep = digits[ends] - digits[starts] < ends - starts
    starts, ends = starts[keep], ends[keep]
    return _FOLD[data], starts, ends, W.span_hashes(data, starts, ends, W.LOWER), np.searchsorted(at, starts, "right") - 1


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' bags, and the word of each bucket (in no special order)."""
    size = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(starts)), size)
    place = np.arange(begin[-1]) - begin[owner]
    flat = np.where(place == 0, ord("<"), np.where(place == size[owner] - 1, ord(">"), 0)).astype(np.uint8)
    inner = flat == 0
    flat[inner] = data[(starts[owner] + place - 1)[inner]]
    code, buckets, owners = np.zeros(len(flat), np.uint32), [(hashes >> _U(64 - BITS)).astype(np.int32)], [np.arange(len(starts))]
    for k in range(1, max(NGRAMS) + 1):
        code = code[:len(flat) - k + 1] * np.uint32(0x01000193) + flat[k - 1:]
        if k in NGRAMS:
            whole = place[:len(code)] + k <= size[owner[:len(code)]]
            mixed = (code[whole] ^ (code[whole] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
            owners.append(owner[:len(code)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


class Model(NamedTuple):
    vectors: np.ndarray      # 2**BITS x DIM
    weights: np.ndarray      # DIM
    bias: float
    slope: float
    intercept: float


def _logits(logit_of: np.ndarray, bias: float, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, logit_of[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1) + bias


def salient(texts: pa.Array, logit_of: np.ndarray, bias: float) -> np.ndarray:
    """Mean logit of each text's SALIENT strongest words (fewer if it has fewer); NaN without words."""
    data, starts, ends, hashes, rows = _words(texts)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    bucket, owner = bags(data, starts[first], ends[first], hashes[first])
    logit = _logits(logit_of, bias, bucket, owner, len(first))[back]
    order = np.lexsort((-logit, rows))
    edge = np.searchsorted(rows, np.arange(len(texts) + 1))
    top = (np.arange(len(rows)) - edge[rows]) < SALIENT
    held = np.bincount(rows[top], minlength=len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(rows[top], logit[order][top], len(texts)) / held


def fit(vocabulary: list[str], toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors, weights and bias from the numbers of toxic and clean texts that hold each word (full-batch AdaGrad)."""
    data, starts, ends, hashes, _ = _words(pa.array(vocabulary, pa.string()))
    bucket, owner = bags(data, starts, ends, hashes)
    n = len(vocabulary)
    own = np.bincount(owner, minlength=n)
    extra = PRIOR / 2 / max(1, texts[1])
    up, down = toxic / max(1, texts[1]) + extra, clean / max(1, texts[0]) + extra
    rng = np.random.default_rng(7)
    vectors, weights, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), rng.normal(0, 0.5, DIM), 0.0
    square, square_w = np.zeros_like(vectors), np.zeros(DIM)
    average = lambda: np.stack([np.bincount(owner, vectors[:, d][bucket], n) for d in range(DIM)], 1) / own[:, None]
    for _ in range(EPOCHS):
        mean = average()
        error = (up + down) * sample.sigmoid(mean @ weights + bias) - up
        pull = np.bincount(bucket, (error / own)[owner], 1 << BITS)     # equal for all dimensions but for the weight
        grad = pull[:, None] * weights + 1e-6 * vectors
        grad_w = mean.T @ error + 1e-4 * weights
        square += grad * grad
        square_w += grad_w * grad_w
        vectors -= 0.3 * grad / (np.sqrt(square) + 1e-8)
        weights -= 0.1 * grad_w / (np.sqrt(square_w) + 1e-8)
    return vectors, weights, bias


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = TRAIN_ROWS) -> Model | None:
    """Fit on a bounded, repeatable sample of labelled texts (``where`` restricts ``__id``); None if a class is missing.

    A fifth of the sample, chosen by the id's CRC, isn't trained on and calibrates the probability.
    """
    chosen = sample.balanced(labels, label_col, per_class, id_col, where)
    fold = F.crc32(F.concat(F.lit("fold"), F.col("__id").cast("string")).cast("binary")) % 5 == 0
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen.withColumn("__held", fold)), "__id")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "__text"):
                data, starts, ends, hashes, owner = _words(part.column("__text"))
                first = np.unique(W.join(hashes, owner.astype(_U)), return_index=True)[1]
                raw = data.tobytes()
                yield pa.record_batch({
                    "word": pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first], ends[first], strict=True)], pa.string()),
                    "label": part.column("__label").take(pa.array(owner[first]))})

    held = rows.where("__held").select("__text", "__label").collect()
    trained = rows.where("NOT __held")
    sizes = {r["__label"]: r["n"] for r in trained.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    found = (trained.select("__text", "__label").mapInArrow(seen, "word string, label int").groupBy("word")
             .agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).toPandas().sort_values("word"))
    toxic = found["toxic"].to_numpy(float)
    vectors, weights, bias = fit(found["word"].tolist(), toxic, found["n"].to_numpy(float) - toxic, (sizes[0], sizes[1]))
    raw = salient(pa.array([r["__text"] for r in held], pa.string()), vectors @ weights, bias)
    label = np.array([r["__label"] for r in held], int)
    fits = ~np.isnan(raw)
    raw, label = raw[fits], label[fits]
    if len(set(label)) < 2:
        return Model(vectors, weights, bias, 1.0, 0.0)
    counts = sample.class_counts(labels, label_col, id_col, where)
    share = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
    slope, intercept = sample.platt(raw, label, share / share.sum() * len(label))
    return Model(vectors, weights, bias, slope, intercept)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None,
          out: str = "toxicity") -> DataFrame:
    """``carry`` columns (all if None) plus ``out``: the probability from 0 to 1 that the text is toxic.

    Null and empty texts and texts without words score 0, as all do without a model.
    """
    carry = docs.columns if carry is None else carry
    if out in carry:
        raise ValueError(f"column {out} exists; give another name")
    shared = docs.sparkSession.sparkContext.broadcast(model and (
        (model.vectors @ model.weights).astype(np.float32), model.bias, model.slope, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text_col):
                p = np.zeros(part.num_rows)
                if shared.value:
                    logit_of, bias, slope, intercept = shared.value
                    raw = salient(part.column(text_col), logit_of, bias)
                    p = np.where(np.isnan(raw), 0.0, sample.sigmoid(slope * np.nan_to_num(raw) + intercept))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(p)], [*carry, out])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in carry]).add(out, "double"))
