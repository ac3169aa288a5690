"""Periodic runs of words: Lyndon roots from the grouping phase of a suffix sorter, extended into runs.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Every run contains a Lyndon
word of length q that is the longest one at its start, under the order of the words or under the reverse order.  Phase
one of Baier's suffix sorter groups suffixes by exactly these longest Lyndon words; it is run here for both orders and
gives the two Lyndon arrays without sorting suffixes.  Each entry is extended to both sides by longest common
extensions (names of all stretches of 1, 2, 4, ... words), and what is long enough is a run.

Texts go in chunks of bounded size; one text is never cut, so a task holds about 300 bytes per word of its longest
text.  A text can only hold a run of ``min_length`` words and ``min_exponent`` periods when a window of
``min_length * (1 - 1 / min_exponent)`` words occurs twice in it; texts without one skip the grouping.

Null and empty texts have no runs and the collapsed text "".  Repeated ids and rows are answered row by row, null ids
too.  Equal words are those with equal 64-bit hashes (two of n words share one with a probability of n*n/2**65).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphgate.llm import words
from glyphgate.llm.schemas import schema

__all__ = ["find", "lyndon_lengths", "runs_of"]

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by grouping; 0 ends a text and belongs to no word.

    Groups of places are taken from the greatest down.  All places of the group taken now are done; each hands its
    Lyndon word to the nearest place on its left that isn't done, whose own word it prolongs.  Places of one group
    that receive equally many form a new group right above their old one.
    """
    n = len(symbols)
    values = np.unique(symbols)
    group_of = np.searchsorted(values, symbols).tolist()
    order = np.argsort(symbols, kind="stable")
    bounds = np.searchsorted(symbols[order], values).tolist() + [n]
    members = [set(order[bounds[g]:bounds[g + 1]].tolist()) for g in range(len(values))]
    length = [1] * len(values)                    # of the group's common Lyndon word
    below = list(range(-1, len(values) - 1))      # the next smaller group
    above = [*range(1, len(values)), -1]
    left = list(range(-1, n - 1))                 # nearest place on the left that may not be done yet
    done = bytearray(n)
    out = [0] * n
    last = 0 if n and values[0] == 0 else -1
    top = len(values) - 1
    while top > last:
        word = length[top]
        taken = members[top]
        for i in taken:
            done[i] = 1
            out[i] = word
        gets: dict[int, int] = {}
        for i in taken:
            j = left[i]
            if j >= 0 and done[j]:
                path = [i]
                while j >= 0 and done[j]:
                    path.append(j)
                    j = left[j]
                for k in path:
                    left[k] = j
            if j >= 0:
                gets[j] = gets.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in gets.items():
            split.setdefault((times, group_of[j]), []).append(j)
        # smaller numbers of words last: each new group goes right above the old one
        for times, old in sorted(split, reverse=True):
            if old == last:
                continue
            moved = split[times, old]
            members[old].difference_update(moved)
            new = len(members)
            members.append(set(moved))
            length.append(length[old] + times * word)
            for j in moved:
                group_of[j] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
        members[top] = ()
        top = below[top]
    return np.array(out, np.int64)


class _Extensions:
    """Longest common extensions within one array of symbols, by names of its stretches of 2**k symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.names, size = len(symbols), [symbols.astype(np.int64)], 1
        while 2 * size <= self.n:
            last = self.names[-1]
            pairs = last[:-size] * (int(last.max()) + 1) + last[size:]
            values, names = np.unique(pairs, return_inverse=True)
            if len(values) == len(pairs):
                break
            self.names.append(names)
            size *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from a and b on, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            x, y = a + out, b + out
            inside = np.flatnonzero(y + (1 << k) <= self.n)
            out[inside[names[x[inside]] == names[y[inside]]]] += 1 << k
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols that end before a and b, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = np.flatnonzero(x >= 0)
            out[inside[names[x[inside]] == names[y[inside]]]] += 1 << k
        return out


def runs_of(symbols: np.ndarray, min_length: int, min_exponent: Fraction) -> np.ndarray:
    """Rows (start, length, period) of all runs by start, then period; different symbols <= 0 separate texts.

    Words are positive.  Separators all differ, so that no extension passes them.
    """
    word = symbols > 0
    plain = np.where(word, symbols, 0)
    found = []
    extensions = _Extensions(symbols - symbols.min() if len(symbols) else symbols)
    for ranks in (plain, np.where(word, plain.max(initial=0) + 1 - plain, 0)):
        periods = lyndon_lengths(ranks)
        at = np.flatnonzero(word & (np.arange(len(ranks)) + periods < len(ranks)))
        q = periods[at]
        right, left = extensions.right(at, at + q), extensions.left(at, at + q)
        length = left + q + right
        enough = (length >= min_length) & (length * min_exponent.denominator >= q * min_exponent.numerator)
        found.append(np.stack([at - left, q, length], 1)[enough])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _may_repeat(w: words.Words, window: int) -> np.ndarray:
    """Texts in which a window of words occurs twice."""
    hashes, begins = words.shingles(w, window)
    text = w.rows[begins]
    order = np.lexsort((hashes, text))
    twice = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.unique(text[order][1:][twice])


def _collapsed(raw: bytes, found: np.ndarray) -> bytes:
    parts = raw.split()
    if not len(found):
        return b" ".join(parts)
    edge = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: float = 3) -> DataFrame:
    """``id``, ``runs`` (start, length, period, by start and period) and ``collapsed`` for each row.

    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space.
    """
    exponent = Fraction(min_exponent).limit_denominator(1000)
    if exponent < 2 or min_length < 2:
        raise ValueError("runs have at least two periods and two words")
    window = max(1, math.ceil(min_length * (1 - 1 / exponent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                yield one(part)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words.words(part.column("text"))
        chosen = _may_repeat(w, window)
        found: dict[int, np.ndarray] = {}
        if len(chosen):
            # words of the chosen texts end to end, a separator of its own before each and one at the end
            sizes = np.diff(w.first)[chosen]
            begins = np.cumsum(sizes + 1) - sizes
            symbols = np.empty(int(sizes.sum()) + len(chosen) + 1, np.int64)
            symbols[np.append(begins - 1, len(symbols) - 1)] = -np.arange(len(chosen) + 1)
            picked = np.concatenate([w.hashes[w.first[t]:w.first[t + 1]] for t in chosen])
            symbols[np.concatenate([np.arange(b, b + s) for b, s in zip(begins, sizes, strict=True)])] = (
                np.unique(picked, return_inverse=True)[1] + 1)
            rows = runs_of(symbols, min_length, exponent)
            owner = np.searchsorted(begins, rows[:, 0], "right") - 1
            rows[:, 0] -= begins[owner]
            cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
            found = {int(t): rows[cuts[k]:cuts[k + 1]] for k, t in enumerate(chosen)}
        none = np.zeros((0, 3), np.int64)
        per_text = [found.get(t, none) for t in range(part.num_rows)]
        raw = w.data.tobytes()
        texts = [_collapsed(raw[a:b], r) for a, b, r in zip(w.at[:-1], w.at[1:], per_text, strict=True)]
        flat = np.concatenate([none, *per_text])
        runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in (0, 1, 2)], names=["start", "length", "period"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in per_text])]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["id", "runs", "collapsed"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, schema(f"runs {RUNS}, collapsed string", id=docs.schema[id_col].dataType)))
