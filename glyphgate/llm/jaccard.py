"""N-gram Jaccard self join of texts: exact, by partitioning the universe of n-grams and the pigeonhole principle.

For two sets that link, the symmetric difference is at most H, a bound that follows from their
sizes.  N-grams are dealt by hash to the segments of a *size band*, the same for every set of
that band.  H errors can't touch all of H + 1 segments, so two linked sets agree on one segment:
the hash of a segment's content is a key under which they meet.  Three refinements keep it exact:

* A segment may tolerate one error and then counts twice: its keys are its content and its content
  less any one n-gram (one-deletion neighbourhood).  :func:`plan` chooses by cost, per band, how
  many segments do, from the number of keys and the chance that unrelated sets share one; contents
  vary in size as Poisson numbers do, and it is the small ones that unrelated sets share.
* There are ``spare`` more segments than needed, so linked sets agree on ``spare`` + 1 of them.
  Each set leaves out its ``spare`` least telling ones (fewest rare n-grams, fewest n-grams, then by hash and
  position).  Both order equal contents alike, so the most telling agreed one is left out by neither.  Which
  n-grams are common is estimated from a bounded sample; that estimate affects costs, never results.
* A set of a size near the top of its band also emits the keys of the next band.

Equal sets are collapsed first.  A group that shares a key isn't expanded into pairs: its sets join one
*cluster*, and each cluster is compared in blocks of ``BLOCK`` sets against blocks, on the n-grams themselves, by
counting common n-grams in a matrix product.  Blocks hold sets of like size, so that only neighbours in
size need comparing.  A task holds two blocks at most and returns links only.

Chance keys chain unrelated sets, so a cluster of more than one block is split before its sets are copied to
its pairs of blocks.  A *sketch* of a set has a bit or two per n-gram: the parity of the number of n-grams that
fall on it.  Two sketches differ in no more bits than their sets do in n-grams, so sets whose sketches differ in
more than H bits don't link, and what the other pairs connect are clusters of their own (:func:`_split`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from glyphgate.llm import words as W
from glyphgate.llm.ngram_lm import DROP
from glyphgate.llm.work import Folder, components, setting
from glyphgate.operators.joins import lookup_join

NGRAM, PERCENT = 5, 80
BAND_RATIO = 1.25
SAMPLE_DOCUMENTS, COMMON_FROM = 2000, 3           # n-grams that so many documents of the sample have are common
COLLISION_WEIGHT, COLLISION_RATE = 1000.0, 0.3   # cost of sharing a key by chance, per n-gram of a segment
RARE_RATE = 0.1                                  # the same where common n-grams are left out first
BLOCK = 2048                                     # sets of a cluster that a task compares with as many others
SKETCH_BLOCK = 8192                              # the same for sketches
SKETCH_ROWS = 512                                # sketches of a block that are compared at a time
COLUMNS = 4096                                   # n-grams that are counted at a time
SLICE = 1 << 20                                  # bytes of text whose words are held at a time
KEYS = 1 << 17                                   # keys of a range that are sorted at a time
_U = np.uint64


class Plan(NamedTuple):
    top: int         # largest size of the band
    deletion: int    # segments with one-deletion keys
    exact: int       # segments with one key, the spare ones included
    spare: int


def bound(percent: int, total: int) -> int:
    """Largest symmetric difference of two sets with ``total`` elements together that reach the similarity."""
    return (100 - percent) * total // (100 + percent)


def chance(mean: float, left_out: float) -> float:
    """Chance that unrelated sets share a segment of ``mean`` n-grams (Poisson) and it isn't among the smallest share ``left_out``."""
    out, before, p, size = 0.0, 0.0, exp(-mean), 0
    while size <= mean or p > 1e-9:
        out += min(p, max(0.0, before + p - left_out)) * RARE_RATE ** size
        before, size = before + p, size + 1
        p *= mean / size
    return out


@cache
def plan(top: int, percent: int) -> Plan:
    """Cheapest allocation of the error budget of one band over one-deletion and exact segments."""
    need = bound(percent, 2 * top) + 1
    best = None
    for deletion in range(min(need // 2, 8) + 1):
        exact = need - 2 * deletion
        spare = -(-exact // 2)
        size = top / max(1, deletion + exact + spare)
        shared = deletion * (size + 1) * exp(-size * (1 - COLLISION_RATE))
        if exact:
            shared += (exact + spare) * chance(size, spare / (exact + spare))
        cost = exact + deletion * (size + 1) + COLLISION_WEIGHT * shared
        if best is None or cost < best[0]:
            best = (cost, Plan(top, deletion, exact + spare, spare))
    return best[1]


def bands(largest: int) -> list[int]:
    """Upper sizes of the bands."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return [*tops, max(tops[-1] + 1, int(tops[-1] * BAND_RATIO))]


class Sets(NamedTuple):
    rows: np.ndarray      # text of each element
    items: np.ndarray     # distinct n-gram hashes, ascending within a text
    counts: np.ndarray    # elements per text


def sets_of(texts: pa.Array, n: int) -> Sets:
    """Distinct ``n``-word shingles of each text; a text with fewer words is one shingle, without words none."""
    w = W.words(texts, lower=True)
    held, begin = W.shingles(w, n)
    rows = w.rows[begin]
    lengths = np.diff(w.first)
    for k in range(1, n):
        short = np.flatnonzero(lengths == k)
        out = w.hashes[w.first[short]]
        for j in range(1, k):
            out = W.join(out, w.hashes[w.first[short] + j])
        rows, held = np.concatenate([rows, short]), np.concatenate([held, W.mix(out + _U(k))])
    order = np.lexsort((held, rows))
    rows, held = rows[order], held[order]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1]) | (rows[1:] != rows[:-1])
    return Sets(rows[new], held[new], np.bincount(rows[new], minlength=len(texts)))


def _sets_in_slices(batch: pa.RecordBatch, column: str, n: int) -> Sets:
    """:func:`sets_of` a column, a slice of ``SLICE`` bytes at a time, which bounds the memory for words."""
    made = [sets_of(part.column(column), n) for part in W.chunks(batch, column, SLICE)]
    before = np.cumsum([0, *(len(s.counts) for s in made)])
    return Sets(np.concatenate([s.rows + k for s, k in zip(made, before.tolist())]), np.concatenate([s.items for s in made]),
                np.concatenate([s.counts for s in made]))


def fingerprints(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x52DCE729DA3ED81B):
        sums = np.zeros(len(s.items) + 1, _U)
        np.cumsum(W.mix(s.items ^ _U(salt)), out=sums[1:])
        edge = np.concatenate([[0], np.cumsum(s.counts)])
        out.append(W.mix(sums[edge[1:]] - sums[edge[:-1]] + s.counts.astype(_U)))
    return out[0], out[1]


def _band_keys(s: Sets, chosen: np.ndarray, p: Plan, number: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chosen sets in one band, and the set of each."""
    m = p.deletion + p.exact
    place = np.full(len(s.counts), -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[s.rows] >= 0
    owner, items = place[s.rows[inside]], s.items[inside]
    segment = (W.mix(items ^ _U(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(m)).astype(np.int64)
    cell = owner * m + segment
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], W.mix(items[order] + _U(0x632BE59BD9B4E019))
    size = np.bincount(cell, minlength=len(chosen) * m)
    sums = np.zeros(len(value) + 1, _U)
    np.cumsum(value, out=sums[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    content = sums[edge[1:]] - sums[edge[:-1]]
    where = np.tile(np.arange(m), len(chosen)).astype(_U) + _U(number << 32)
    key = W.join(where, content)
    kept = np.tile(np.arange(m) < p.deletion, len(chosen))
    exact = np.flatnonzero(~kept)
    if p.exact:
        rare = np.bincount(cell[~_among(items[order], common)], minlength=len(size))
        rank = np.lexsort((exact, content[exact], -size[exact], -rare[exact], exact // m)).reshape(len(chosen), p.exact)
        kept[exact[rank[:, :p.exact - p.spare].ravel()]] = True
    keys, sets = [key[kept]], [chosen[np.flatnonzero(kept) // m]]
    if p.deletion:
        one = np.flatnonzero(cell % m < p.deletion)
        keys.append(W.join(where[cell[one]], content[cell[one]] - value[one]))
        sets.append(chosen[cell[one] // m])
    return np.concatenate(keys), np.concatenate(sets)


def _among(items: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which items are in an ascending list."""
    if not len(listed):
        return np.zeros(len(items), bool)
    return listed[np.minimum(np.searchsorted(listed, items), len(listed) - 1)] == items


def keys_of(s: Sets, percent: int, common: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """Every key of every set, and the set of each; ``common`` are the n-grams that tell least, ascending."""
    tops = np.array(bands(int(s.counts.max(initial=1))))
    own = np.searchsorted(tops, s.counts)
    keys, sets = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for number, top in enumerate(tops):
        if not bound(percent, 2 * int(top)):
            continue     # only equal sets link
        lower = int(tops[number - 1]) if number else 0
        near = (own == number - 1) & (100 * s.counts >= percent * (lower + 1))
        chosen = np.flatnonzero(((own == number) | near) & (s.counts > 0))
        if len(chosen):
            k, v = _band_keys(s, chosen, plan(int(top), percent), number, common)
            keys.append(k)
            sets.append(v)
    return np.concatenate(keys), np.concatenate(sets)


def _pack(key: np.ndarray, node: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences, and the nodes."""
    gaps = np.diff(key, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(key).to_bytes(8, "little") + pa.compress(gaps, "zstd", asbytes=True) + node.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    end = len(blob) - 8 * n
    gaps = pa.decompress(blob[8:end], 8 * n, "zstd", asbytes=True)
    planes = np.frombuffer(gaps, np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(planes).view(_U).ravel(), dtype=_U), np.frombuffer(blob, _U, n, end).copy()


def _documents(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id``, ``n`` and two hashes of the set of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, "__text"):
                s = sets_of(chunk.column("__text"), n)
                one, two = fingerprints(s)
                yield pa.record_batch([chunk.column("__id"), pa.array(s.counts, pa.int64()), pa.array(one.view(np.int64)),
                                       pa.array(two.view(np.int64))], ["id", "n", "node", "second"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "id long, n long, node long, second long")


def _common_ngrams(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int) -> np.ndarray:
    """N-grams of several documents of a bounded, repeatable sample of different sets, ascending."""
    chosen = classes.select(F.col("first").alias("__id")).where("__id IS NOT NULL").orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_DOCUMENTS)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, "__text"):
                yield pa.record_batch([pa.array(sets_of(chunk.column("__text"), n).items.view(np.int64))], ["item"])

    found = (rows.mapInArrow(run, "item long").groupBy("item").agg(F.count("*").alias("k")).where(f"k >= {COMMON_FROM}")
             .select("item").toPandas()["item"].to_numpy(np.int64))
    return np.sort(found.view(_U))


def _packed_keys(docs: DataFrame, text_col: str, n: int, percent: int, parts: int, common: np.ndarray) -> DataFrame:
    """One row of packed keys per chunk and key range.

    A chunk connects the sets that share keys in it, by one edge each, and sends every key once, for the set that
    stands for those connected.
    """
    top = (64 - (parts - 1).bit_length()) if parts > 1 else 64
    known = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, "__text"):
                s = _sets_in_slices(chunk, "__text", n)
                one, _ = fingerprints(s)
                firsts = np.sort(np.unique(one, return_index=True)[1])
                keep = np.zeros(len(one), bool)
                keep[firsts] = True
                inside = keep[s.rows]
                counts = np.where(keep, s.counts, 0)
                key, owner = keys_of(Sets(s.rows[inside], s.items[inside], counts), percent, known.value)
                node = one[owner]
                order = np.lexsort((node, key))
                key, node = key[order], node[order]
                repeat = np.zeros(len(key), bool)
                repeat[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
                key, node = key[~repeat], node[~repeat]
                first, root, joined = _spanned(key, node)
                key, rows = key[first], []
                sent, met = ((x >> _U(top)).astype(np.int64) if parts > 1 else np.zeros(len(x), np.int64) for x in (key, joined[:, 0]))
                for number in np.union1d(sent, met).tolist():
                    h = slice(*np.searchsorted(sent, (number, number + 1)))
                    m = joined[met == number]
                    rows.append((number, _pack(key[h], root[h]), _pack(m[:, 0], m[:, 1])))
                yield pa.record_batch([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary())], ["part", "heads", "met"])

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "part int, heads binary, met binary")


def _spanned(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Connect nodes with a common key (rows sorted by key): first row of each key, the smallest node its nodes reach, and edges (root, node).

    One edge per node that is not a root, however many keys it shares.  Only rows whose key another row has, too, cost work memory.
    """
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    times = np.diff(begin, append=len(key))
    several = times > 1
    names, at = np.unique(node[np.repeat(several, times)], return_inverse=True)
    times = times[several]
    label, centre = np.arange(len(names)), np.repeat(at[np.cumsum(times) - times], times)
    while len(at):
        least = np.minimum(label[centre], label[at])
        before = label.copy()
        for side in (label[centre], label[at], centre, at):
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(names)))
    root = node[begin]
    joined = np.flatnonzero(_among(root, names))
    root[joined] = names[label[np.searchsorted(names, root[joined])]]
    return begin, root, np.stack([names[label[other]], names[other]], 1)


def _connected(heads: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edges (root, node) that connect the nodes with a common key, from lists of ascending keys and their nodes.

    About ``KEYS`` keys are sorted at a time; the edges of all stretches are connected once more, so that they are those of a single sort.
    """
    heads = [h for h in heads if len(h[0])]
    if not heads:
        return np.zeros((0, 2), _U)
    low, high = min(int(k[0]) for k, _ in heads), max(int(k[-1]) for k, _ in heads)
    steps = -(-sum(len(k) for k, _ in heads) // KEYS)
    limits = np.array([low + (high - low) * s // steps for s in range(1, steps)], _U)
    cuts = [[0, *np.searchsorted(k, limits).tolist(), len(k)] for k, _ in heads]

    def spanned(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        key, node = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(key)
        return _spanned(key[order], node[order])[2]

    found = [spanned([(k[c[s]:c[s + 1]], v[c[s]:c[s + 1]]) for (k, v), c in zip(heads, cuts, strict=True)]) for s in range(steps)]
    return found[0] if steps == 1 else spanned([(e[:, 0], e[:, side]) for e in found for side in (0, 1)])


def _meet(packed: DataFrame, parts: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect all sets with a common key.

    Chunks give the edges that connect their own sets; of each range of keys come those that connect the chunks'.
    """
    def edges(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = pairs.view(np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = []
        for batch in batches:
            for blob, more in zip(batch.column("heads"), batch.column("met"), strict=True):
                heads.append(_unpack(blob.as_py()))
                yield edges(np.stack(_unpack(more.as_py()), 1))
        yield edges(_connected(heads))

    return packed.repartition(parts, "part").select("heads", "met").mapInArrow(run, "a long, b long").distinct()


def _stored_sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``node`` and its n-gram hashes, from the documents that have that set (other texts under the same id don't)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, "__text", 4 << 20):
                s = sets_of(chunk.column("__text"), n)
                edge = np.concatenate([[0], np.cumsum(s.counts)])
                items = pa.LargeListArray.from_arrays(pa.array(edge, pa.int64()), pa.array(s.items.view(np.int64)))
                same = pa.array(fingerprints(s)[0].view(np.int64) == chunk.column("node").to_numpy())
                yield pa.record_batch([chunk.column("node"), items.cast(pa.list_(pa.int64()))], ["node", "items"]).filter(same)

    return docs.select("node", F.col(text_col).alias("__text")).mapInArrow(run, "node long, items array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each left and each right set."""
    items = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        held[owner[i:j], column[i:j] - start] = 1
        out += held[:len(left)] @ held[len(left):].T
    return np.rint(out).astype(np.int64)


def _forest(pairs: np.ndarray, n: int) -> list[int]:
    """Numbers of the pairs that connect what no earlier pair has connected."""
    parent, kept = list(range(n)), []
    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _linked(tasks: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Links ``a`` < ``b`` within each pair of blocks; with ``spanning``, a forest that connects the same sets."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        items = table["items"].combine_chunks()
        edge, flat = items.offsets.to_numpy(), items.values.to_numpy()
        sets = [flat[edge[k]:edge[k + 1]] for k in range(len(node))]
        i, j = np.flatnonzero(block == low), np.flatnonzero(block == high)
        common = _common([sets[k] for k in i], [sets[k] for k in j])
        size = np.diff(edge)
        hit = 100 * common >= percent * (size[i][:, None] + size[j][None, :] - common)
        if low == high:
            hit &= i[:, None] < j[None, :]
        at = np.argwhere(hit)
        pairs = np.stack([i[at[:, 0]], j[at[:, 1]]], 1) if len(at) else np.zeros((0, 2), np.int64)
        if spanning:
            pairs = pairs[_forest(pairs, len(node))]
        a, b = node[pairs[:, 0]], node[pairs[:, 1]]
        a, b = a[a != b], b[a != b]      # repeated rows
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tasks.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def _tasks(wanted: DataFrame, percent: int, size: int) -> DataFrame:
    """``node``, its ``block``, and each pair of blocks of ``size`` (``cluster``, ``low``, ``high``) that it takes part in.

    Clusters of more than one block are cut by size of the sets first: linked sets lie in one band of sizes or in neighbours.
    """
    totals = wanted.groupBy("cluster").agg(F.count("*").alias("total"))
    ratio = 1.01 * 100 / percent
    band = F.when(F.col("total") <= size, F.lit(0)).otherwise(F.floor(F.log("n") / F.log(F.lit(ratio)))).cast("long")
    placed = lookup_join(wanted.select("node", "cluster", "n"), totals, "cluster", "inner").select("node", "cluster", band.alias("band"))
    blocks = placed.groupBy("cluster", "band").agg(F.ceil(F.count("*") / size).alias("blocks"))
    around = blocks.select("cluster", "band", "blocks")
    for name, step in (("below", 1), ("above", -1)):
        other = blocks.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
        around = around.join(other, ["cluster", "band"], "left")
    number = lambda band, k: f"(({band}) * 1048576L + ({k}))"
    own = number("band", "part")
    pairs = (f"concat(transform(sequence(0L, blocks - 1), o -> struct({number('band', 'least(part, o)')} AS low, {number('band', 'greatest(part, o)')} AS high)),"
             f" if(above > 0, transform(sequence(0L, above - 1), o -> struct({own} AS low, {number('band + 1', 'o')} AS high)), array()),"
             f" if(below > 0, transform(sequence(0L, below - 1), o -> struct({number('band - 1', 'o')} AS low, {own} AS high)), array()))")
    return (placed.join(around, ["cluster", "band"]).withColumn("part", F.expr("pmod(xxhash64(node), blocks)"))
            .select("node", "cluster", F.expr(own).alias("block"), F.explode(F.expr(pairs)).alias("pair"))
            .select("node", "cluster", "block", "pair.low", "pair.high"))


def sketches_of(s: Sets) -> list[bytes]:
    """Parities of each set: bit k, of a power of two of bits (64, or as many as n-grams and up to twice as many), tells
    whether an odd number of its n-grams fall on k.  A longer sketch folds into a shorter one."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(s.counts, 1))).astype(np.int64))
    start = np.cumsum(bits) - bits
    mixed = W.mix(s.items ^ _U(0x2545F4914F6CDD1D))
    place = start[s.rows] + (mixed % bits[s.rows].astype(_U)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) % 2 == 1
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[k // 8:(k + n) // 8] for k, n in zip(start.tolist(), bits.tolist(), strict=True)]


def _parities(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest one's bits."""
    short = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, _U).reshape(-1, short), axis=0) for x in sketches])


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits each left and each right sketch differ."""
    out = np.zeros((len(left), len(right)), np.int32)
    for a, b in zip(left.T, right.T, strict=True):
        out += np.bitwise_count(a[:, None] ^ b[None, :])
    return out


def _may_link(tasks: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that connect, in each pair of blocks, all sets whose sketches leave a link possible."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, block, size = (table[c].to_numpy() for c in ("node", "block", "n"))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        parity = _parities(table["sketch"].to_pylist())
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        group, found = np.arange(len(node)), [np.zeros((0, 2), np.int64)]
        first, rows = 0, 16       # few rows connect most of a block whose sets are alike: the others' pairs are known then
        while first < len(left):
            i = left[first:first + rows]
            total = size[i][:, None] + size[right][None, :]
            near = _apart(parity[i], parity[right]) <= (100 - percent) * total // (100 + percent)
            at = np.argwhere(near & (group[i][:, None] != group[right][None, :]))
            pairs = np.stack([i[at[:, 0]], right[at[:, 1]]], 1)
            pairs = pairs[_forest(group[pairs], len(node))]
            if len(pairs):
                found.append(pairs)
                group = _merged(group, pairs)
            first, rows = first + rows, min(2 * rows, SKETCH_ROWS)
        pairs = np.concatenate(found)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return tasks.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def _merged(group: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Groups (each named by its smallest member) after the groups of each pair became one."""
    name = np.arange(len(group))
    ends = group[pairs]
    while True:
        least = name[ends].min(axis=1)
        before = name.copy()
        np.minimum.at(name, ends.ravel(), np.repeat(least, 2))
        np.minimum.at(name, before[ends].ravel(), np.repeat(least, 2))
        name = name[name]
        if (name == before).all():
            return name[group]


def _split(sets: DataFrame, clusters: DataFrame, percent: int, folder: Folder) -> DataFrame:
    """``node``, ``n``, ``cluster``: clusters of more than one block become those that their sketches connect.

    Sets that may link with none are left out.
    """
    totals = folder.kept(clusters.groupBy("cluster").count().where(F.col("count") > BLOCK).select("cluster"))
    if totals.isEmpty():
        return clusters
    large = folder.kept(clusters.join(totals, "cluster"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            counts = np.diff(items.offsets.to_numpy())
            s = Sets(np.repeat(np.arange(len(counts)), counts), items.flatten().to_numpy().view(_U), counts)
            yield pa.record_batch([batch.column("node"), pa.array(counts, pa.int64()), pa.array(sketches_of(s), pa.binary())], ["node", "n", "sketch"])

    sketches = folder.kept(sets.join(large.select("node"), "node", "left_semi").mapInArrow(run, "node long, n long, sketch binary").distinct())
    near = folder.kept(_may_link(sketches.join(_tasks(large, percent, SKETCH_BLOCK), "node"), percent).distinct())
    parts = components(near, folder).withColumnRenamed("component", "cluster")
    return folder.kept(clusters.join(totals, "cluster", "left_anti").select("node", "n", "cluster").unionByName(
        parts.join(large.select("node", "n"), "node").select("node", "n", "cluster")))


class Join(NamedTuple):
    documents: DataFrame    # id, n, node (64-bit hash of the set): one row per input row
    classes: DataFrame      # node, n, first (smallest id), copies: one row per distinct set
    links: DataFrame        # a, b: nodes that link; spanning ones, or every one


def self_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
              percent: int = PERCENT, spanning: bool = True) -> Join:
    """Link documents whose sets of ``n``-word shingles have a Jaccard similarity of ``percent`` or more.

    With ``spanning``, ``links`` holds enough of the links between different sets to tell all components;
    otherwise it holds every one.
    Null or empty texts and texts without words have the empty set (``n`` 0) and link with nothing.
    Repeated rows are copies.  A null id keeps its row and counts as a copy, but is nobody's smallest id;
    a set that only rows without id hold isn't compared.
    """
    with setting(docs.sparkSession, DROP, "true"):      # else the shuffle files of every pass stay until the driver collects its garbage
        return _self_join(docs, id_col, text_col, n, percent, spanning)


def _self_join(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, spanning: bool) -> Join:
    spark = docs.sparkSession
    folder = Folder(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 1 << (parts - 1).bit_length()
    documents = folder.kept(_documents(docs, id_col, text_col, n))
    classes = folder.kept(documents.where("n > 0").groupBy("node", "second", "n").agg(
        F.min("id").alias("first"), F.count("*").alias("copies")))
    common = _common_ngrams(docs, classes, id_col, text_col, n)
    met = folder.kept(_meet(_packed_keys(docs, text_col, n, percent, parts, common), parts))
    if met.isEmpty():
        return Join(documents.drop("second"), classes.drop("second"), spark.createDataFrame([], "a long, b long"))
    clusters = components(met, folder).withColumnRenamed("component", "cluster")
    wanted = folder.kept(clusters.join(classes, "node").select("node", "cluster", "n", F.col("first").alias("__first")))
    texts = docs.select(F.col(id_col).cast("long").alias("__first"), F.col(text_col).alias("__t"))
    found = lookup_join(texts, wanted.select("node", "__first"), "__first", "inner")
    sets = folder.kept(_stored_sets(found, "__t", n))
    clusters = _split(sets, wanted.select("node", "n", "cluster"), percent, folder)
    tasks = sets.join(_tasks(clusters, percent, BLOCK), "node")
    return Join(documents.drop("second"), classes.drop("second"), folder.kept(_linked(tasks, percent, spanning).distinct()))


def with_components(join: Join, folder: Folder) -> DataFrame:
    """``id``, ``n``, ``node``, ``component``: the smallest id reachable by links; a document without any has its own id."""
    first = join.classes.select("node", "first", "copies")
    ends = join.links
    for side in ("a", "b"):
        ends = ends.join(first.select(F.col("node").alias(side), F.col("first").alias(f"first_{side}")), side)
    labels = components(ends.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")), folder)
    named = folder.kept(
        first.join(labels.withColumnRenamed("node", "first"), "first", "left").where("copies > 1 OR component IS NOT NULL")
        .select("node", F.coalesce("component", "first").alias("component")))
    empty = F.col("n") == 0
    return (lookup_join(join.documents, named, "node").select(
        "id", "n", "node", F.when(empty, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
            percent: int = PERCENT) -> DataFrame:
    """``id``, ``n``, ``node``, ``component`` of each document (see :func:`self_join`)."""
    return with_components(self_join(docs, id_col, text_col, n, percent), Folder(docs.sparkSession))


def _with_nodes(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """All columns of ``docs``, ``__n`` and ``__node``: the size and hash of each row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, text_col):
                s = sets_of(chunk.column(text_col), n)
                node = pa.array(fingerprints(s)[0].view(np.int64))
                yield chunk.append_column("__n", pa.array(s.counts, pa.int64())).append_column("__node", node)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("__n long, __node long").fields]))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked texts, one row with its smallest id stays.

    Groups are of sets, not of ids: different texts under one id are different rows, and each stays unless its own
    group has another first row (smallest id, then smallest hash of the set).  Of equal rows one stays, and of rows with
    one id and one set but different texts or other columns, too.  Rows without words and rows without id stay.
    """
    folder = Folder(docs.sparkSession)
    found = self_join(docs, id_col, text_col, n, percent)
    groups = components(found.links, folder).join(found.classes.select("node", "first"), "node")
    firsts = groups.groupBy("component").agg(F.min(F.struct("first", "node"))["node"].alias("__kept"))
    gone = folder.kept(groups.join(firsts, "component").where("node <> __kept").select("node"))
    # what decides on a row: its set goes, or stays for its first id alone
    rule = folder.kept(
        found.classes.where("copies > 1").select("node", "first", F.lit(False).alias("gone"))
        .unionByName(gone.select("node", F.lit(None).cast("long").alias("first"), F.lit(True).alias("gone")))
        .groupBy("node").agg(F.max("first").alias("__first"), F.max("gone").alias("__gone")).withColumnRenamed("node", "__node"))
    several = folder.kept(found.documents.where("n > 0 AND id IS NOT NULL").groupBy("id", "node").count().where("count > 1")
                          .select(F.xxhash64("id", "node").alias("__pair"), F.lit(True).alias("__several")))
    rows = lookup_join(_with_nodes(docs, text_col, n), rule, "__node")
    known = F.col(f"`{id_col}`").isNotNull() & (F.col("__n") > 0)
    kept = rows.where(~known | (~F.coalesce("__gone", F.lit(False)) & (F.col("__first").isNull() | (F.col(f"`{id_col}`") == F.col("__first")))))
    if several.isEmpty():
        return kept.select(*docs.columns)
    marked = lookup_join(folder.kept(kept.withColumn("__pair", F.when(known, F.xxhash64(id_col, "__node")))), several, "__pair")
    again = F.coalesce("__several", F.lit(False))
    one = marked.where(again).groupBy("__pair").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")
    return marked.where(~again).select(*docs.columns).unionByName(one)
