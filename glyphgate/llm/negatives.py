"""Hard negatives for anchors: the best-scoring rows of other labels whose score lies in a window below a positive's.

Candidates are cut into blocks of bounded size, ranged by label, and each block is indexed by a cover tree.  Rows get
one more coordinate, ``sqrt(M*M - |x|*|x|)``, so that all of a block have the norm M; anchors have 0 there, and inner
products order rows as distances do.  The points of a block are taken farthest first; a point's level is the scale at
which it stops being covered, its parent the nearest point of the levels above, so centres of a level lie apart and
cover all below.  With each centre and level the tree keeps the covering radius r of what is still below: all inner
products of that part lie within |anchor| * r of the centre's.  The descent takes the part with the highest bound
first, skips parts that lie outside every window, hold no wanted label or can't beat the rows found, and verifies
parts of up to ``LEAF`` rows exactly, in integers.

Anchors meet blocks in groups of bounded size on both sides; each pair of groups returns at most the wanted number of
rows per window, which are merged per window.  Nothing is left out: bounds only skip what can't be returned.

Rows without id, label or vector, or with a null, NaN or infinite component, take no part.  Shorter vectors count as
padded with zeros.  Repeated ids are separate rows; equal scores go by id, then by place in the input.  Products must
stay below 2**63 (else OverflowError); below 2**53 they are computed in doubles, exactly.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from glyphgate.llm.schemas import schema
from glyphgate.llm.work import Folder

__all__ = ["CoverTree", "mine"]

BLOCK = 4096          # candidates of one tree
ANCHORS = 1024        # anchors of one group, on average
LEAF = 256            # rows of a part that is verified without going further down
SCALE = 1.3           # radius of a level against that of the next
MIXED = -1            # mark of a subtree with several labels


class CoverTree:
    """Cover tree over integer vectors; arrays are in depth-first order, so that a subtree is a slice."""

    ARRAYS = ("size", "own", "first", "begin", "stop", "rest", "following", "kids")

    @classmethod
    def loaded(cls, arrays) -> "CoverTree":
        out = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(out, name, arrays[name])
        return out

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        plain = vectors.astype(np.float64)
        square = (plain * plain).sum(1)
        points = np.concatenate([plain, np.sqrt(square.max(initial=0) - square)[:, None]], 1)
        # all points have one norm, so a product gives a distance; radii are measured exactly below
        twice = 2 * float(square.max(initial=0))
        near = self._distance(points, points[0], twice)
        radius = max(float(near.max(initial=0)), 1.0)
        level, parent = np.zeros(n, np.int64), np.full(n, -1)
        nearest, covered = np.zeros(n, np.int64), np.zeros(n, np.int64)   # nearest centre now, and when the level began
        now, order = 0, [0]
        near[0] = -1.0
        for _ in range(n - 1):
            far = int(np.argmax(near))
            at = 1 + int(np.floor(np.log(radius / max(float(near[far]), 1e-9)) / np.log(SCALE)))
            if at > now:
                now, covered = at, nearest.copy()
            level[far], parent[far] = at, covered[far]
            order.append(far)
            away = self._distance(points, points[far], twice)
            closer = away < near
            nearest[closer], near[closer] = far, away[closer]
            near[far] = -1.0
        self._lay_out(points, level, parent, order)

    @staticmethod
    def _distance(points, centre, twice):
        return np.sqrt(np.maximum(twice - 2 * (points @ centre), 0))

    def _lay_out(self, points, level, parent, order):
        n = len(points)
        children = [[] for _ in range(n)]
        for k in order[1:]:                       # by level, since levels rise along the order
            children[parent[k]].append(k)
        size = np.ones(n, np.int64)
        for k in reversed(order[1:]):
            size[parent[k]] += size[k]
        place = np.zeros(n, np.int64)
        for k in order:
            at = place[k] + 1
            for c in children[k]:
                place[c] = at
                at += size[c]
        self.source = np.argsort(place)           # row of the input at each place
        own = np.zeros(n)                         # radius of a subtree around its centre
        edge = np.zeros(n)                        # radius of a child's subtree around the parent
        via, up = np.arange(n), parent.copy()
        while (live := np.flatnonzero(up >= 0)).size:
            gap = points[live] - points[up[live]]
            far = np.sqrt((gap * gap).sum(1))
            np.maximum.at(edge, via[live], far)
            np.maximum.at(own, up[live], far)
            via[live] = up[live]
            up[live] = parent[up[live]]
        # one entry per group of siblings of one level: where it begins, ends, and the radius of it and what follows
        self.size, self.own = size[self.source], own[self.source]
        self.first = np.full(n, -1)               # first group of each place's children
        begin, stop, rest, following, kids = [], [], [], [], []
        for k in order:
            groups = []
            for c in children[k]:
                if not groups or level[groups[-1][-1]] != level[c]:
                    groups.append([])
                groups[-1].append(c)
            reach = 0.0
            for after, group in enumerate(reversed(groups)):
                reach = max(reach, float(edge[group].max()))
                begin.append(len(kids))
                kids += place[group].tolist()
                stop.append(len(kids))
                rest.append(reach)
                following.append(len(begin) - 2 if after else -1)
            if groups:
                self.first[place[k]] = len(begin) - 1
        self.begin, self.stop, self.following, self.kids = (np.array(x, np.int64) for x in (begin, stop, following, kids))
        self.rest = np.array(rest, np.float64)


class _Products:
    """Integer inner products of the rows of a matrix with a query: in doubles while they are exact there."""

    def __init__(self, matrix: np.ndarray, queries: np.ndarray):
        bound = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * matrix.shape[1]
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        self.matrix, self.queries = matrix.astype(self.kind), queries.astype(self.kind)

    def of(self, k: int, at: np.ndarray) -> np.ndarray:
        out = self.matrix[at] @ self.queries[k]
        if self.kind is object and len(out) and max(map(abs, out)) >= 1 << 63:
            raise OverflowError("an inner product exceeds 63 bits")
        return out.astype(np.int64)


class _Best:
    """The first rows of one window: highest scores, then smallest ranks."""

    def __init__(self, low: int, high: int, count: int):
        self.low, self.high, self.count, self.rows, self.floor = low, high, count, [], low

    def add(self, scores: np.ndarray, ranks: np.ndarray) -> None:
        fit = (scores >= self.floor) & (scores <= self.high)
        if fit.any():
            self.rows = sorted([*self.rows, *zip((-scores[fit]).tolist(), ranks[fit].tolist(), strict=True)])[:self.count]
            if len(self.rows) == self.count:
                self.floor = max(self.floor, -self.rows[-1][0])


class _Search:
    """Best-first descents in the tree of one block."""

    def __init__(self, tree: CoverTree, vectors: np.ndarray, queries: np.ndarray, labels: np.ndarray, ranks: np.ndarray):
        self.tree, self.labels, self.ranks, self.products = tree, labels, ranks, _Products(vectors, queries)
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        change = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        last = np.arange(len(labels)) + tree.size - 1
        self.pure = np.where(change[last] == change, labels, MIXED)   # the one label of a subtree
        self.centres = np.flatnonzero(tree.first >= 0)
        self.visited = 0

    def fill(self, k: int, label: int, same: bool, but: np.ndarray, windows: list[_Best]) -> None:
        """Fill the windows of query ``k`` with rows of the label (or, if not ``same``, of the others), without the places ``but``."""
        tree, norm = self.tree, float(self.norms[k])
        scores = np.zeros(len(self.labels), np.int64)
        scores[self.centres] = self.products.of(k, self.centres)
        wanted = (self.labels == label) == same
        wanted[but] = False

        def verify(at):
            at = at[wanted[at]]
            self.visited += len(at)
            if len(at):
                exact = self.products.of(k, at)
                fit = np.flatnonzero((exact >= min(w.floor for w in windows)) & (exact <= max(w.high for w in windows)))
                if len(fit):
                    exact, ranks = exact[fit], self.ranks[at[fit]]
                    for w in windows:
                        w.add(exact, ranks)

        def open_(high, low):
            return any(high >= w.floor and low <= w.high for w in windows)

        def push(centre, group):
            if group >= 0:
                score, slack = int(scores[centre]), _slack(norm, float(tree.rest[group]), int(scores[centre]))
                if open_(score + slack, score - slack):
                    heapq.heappush(heap, (-score - slack, score - slack, centre, int(group)))

        heap: list[tuple] = []
        verify(np.zeros(1, np.int64))
        push(0, tree.first[0])
        while heap:
            high, low, centre, group = heapq.heappop(heap)
            if not open_(-high, low):
                continue
            kids = tree.kids[tree.begin[group]:tree.stop[group]]
            kids = kids[(self.pure[kids] == MIXED) | ((self.pure[kids] == label) == same)]
            large = tree.size[kids] > LEAF
            self._leaves(kids[~large], scores, norm, windows, verify)
            for c in kids[large].tolist():
                verify(np.array([c]))
                push(c, tree.first[c])
            push(centre, tree.following[group])

    def _leaves(self, small, scores, norm, windows, verify):
        """Verify small subtrees, highest bounds first; single rows have no bound of their own."""
        size = self.tree.size[small]
        slack = _slack(norm, self.tree.own[small], scores[small])
        high = np.where(size > 1, scores[small] + slack, np.inf)
        low = np.where(size > 1, scores[small] - slack, -np.inf)
        order = np.argsort(-high, kind="stable")
        k, step = 0, 4 * LEAF
        while k < len(order):
            some = order[k:k + step]
            k, step = k + step, 4 * step          # the first ones raise the windows' floors for the rest
            open_ = np.zeros(len(some), bool)
            for w in windows:
                open_ |= (high[some] >= w.floor) & (low[some] <= w.high)
            some = some[open_]
            if len(some):
                ends = np.cumsum(size[some])
                verify(np.arange(ends[-1]) + np.repeat(small[some] - (ends - size[some]), size[some]))


def _slack(norm, radius, score):
    """How far inner products within ``radius`` of a centre are from the centre's, rounding included."""
    return norm * radius * (1 + 1e-9) + 1 + 1e-12 * abs(score)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    column = vectors.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    flat, sizes = column.values.to_numpy(zero_copy_only=False).astype(np.int64)[at[0]:at[-1]], np.diff(at)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - (at[:-1] - at[0])[rows]] = flat
    return out


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _trees(rows: DataFrame) -> DataFrame:
    """One row per block: its rows in the order of its cover tree, and the tree."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    kept = schema("block int, rows array<bigint>, tree binary", ids=T.ArrayType(kinds["id"]), labels=T.ArrayType(kinds["label"]))

    def build(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector"))
        tree = CoverTree(vectors)
        laid = table.take(pa.array(tree.source))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(laid)], pa.int32()), laid.column(c).combine_chunks())
                 for c in ("id", "label", "row")]
        blob = _packed({"vectors": vectors[tree.source], **{name: getattr(tree, name) for name in CoverTree.ARRAYS}})
        return pa.table([*lists[:2], table.column("block")[:1], lists[2], pa.array([blob])], names=kept.names)

    return rows.groupBy("block").applyInArrow(build, kept)


def _found(anchors: DataFrame, trees: DataFrame, same: bool, count: int, low: int, high: int) -> DataFrame:
    """The first ``count`` rows of each pair of an anchor and a window, from each block that the anchor meets."""
    kept = schema("anchor_row bigint, window int, score bigint, row bigint", id=anchors.schema["id"].dataType)

    def descend(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and blocks.num_rows:
            with np.load(io.BytesIO(blocks.column("tree")[0].as_py())) as arrays:
                tree = CoverTree.loaded(arrays)
                vectors = arrays["vectors"]
            queries = _matrix(asked.column("vector"))
            wide = max(vectors.shape[1], queries.shape[1])
            vectors, queries = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (vectors, queries))
            ids, rows, labels = (blocks.column(c).combine_chunks().flatten() for c in ("ids", "rows", "labels"))
            by_rank = pc.sort_indices(pa.table({"id": ids, "row": rows}), [("id", "ascending"), ("row", "ascending")]).to_numpy()
            ranks = np.empty(len(by_rank), np.int64)
            ranks[by_rank] = np.arange(len(by_rank))
            codes = {label: k for k, label in enumerate(dict.fromkeys(labels.to_pylist()))}
            search = _Search(tree, vectors, queries, np.array([codes[x] for x in labels.to_pylist()]), ranks)
            place = rows.to_numpy()
            for k, (row, label, scores) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("row", "label", "scores")), strict=True)):
                windows = ([_Best(-1 << 63, (1 << 63) - 1, count)] if scores is None
                           else [_Best(-(-low * s // 100), high * s // 100, count) for s in scores])
                if windows:
                    search.fill(k, codes.get(label, MIXED - 1), same, place == row, windows)
                out += ((row, w, -score, int(by_rank[rank])) for w, best in enumerate(windows) for score, rank in best.rows)
            chosen = pa.array([o[3] for o in out], pa.int64())
            ids, rows = ids.take(chosen), rows.take(chosen)
        else:
            ids, rows = pa.array([], blocks.schema.field("ids").type.value_type), pa.array([], pa.int64())
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
        return pa.table([ids, *columns, rows], names=kept.names)

    return anchors.groupBy("block", "group").cogroup(trees.groupBy("block", "group")).applyInArrow(descend, kept)


def _first(found: DataFrame, count: int, rank: str) -> DataFrame:
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def _spread(df: DataFrame, most: int, number: str) -> DataFrame:
    """Rows in ranges of their label of about ``most`` rows, with the number of their range."""
    ranges = max(1, -(-df.count() // most))
    return df.repartitionByRange(ranges, F.col("label"), F.xxhash64("row")).withColumn(number, F.spark_partition_id())


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the inner product of vectors with components floor(scale * x).  An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with
    low% <= score / positive's score <= high% are returned.  ``anchors`` is a condition on the input's columns.
    """
    folder = Folder(rows.sparkSession)
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = folder.kept(
        rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & finite)
        .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole.alias("vector"),
                F.coalesce(anchors, F.lit(False)).alias("anchor")))
    kept = kept.withColumn("row", F.monotonically_increasing_id())
    placed = folder.kept(_spread(kept, BLOCK, "block"))
    asking = folder.kept(_spread(placed.where("anchor").select("id", "label", "vector", "row"), ANCHORS, "group"))
    trees = folder.kept(_trees(placed.select("block", "id", "row", "label", "vector")))

    # positives: groups of anchors and blocks that share a label
    pairs = folder.kept(asking.select("label", "group").distinct().join(placed.select("label", "block").distinct(), "label")
                        .select("group", "block").distinct())
    none = F.lit(None).cast("array<bigint>")
    near = _first(_found(asking.join(pairs, "group").withColumn("scores", none), trees.join(pairs, "block"), True, positives, low, high),
                  positives, "rank")
    near = folder.kept(near.select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                   (F.col("rank") - 1).alias("window")))

    # negatives: all groups of anchors in all blocks but those that hold only their one label
    scores = near.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))),
                                                        lambda x: x["positive_score"]).alias("scores"))
    asking = folder.kept(asking.join(scores.withColumnRenamed("anchor_row", "row"), "row"))
    blocks, groups = (df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0] for df, c in ((placed, "block"), (asking, "group")))
    found = _first(_found(
        asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks)))),
        trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups)))), False, negatives, low, high), negatives, "rank")
    names = asking.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (found.join(near, ["anchor_row", "window"]).join(names, "anchor_row")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
