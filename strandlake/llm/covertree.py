"""Hard negatives by inner product, through cover trees over norm-augmented candidates.

A candidate x gets one more component, the root of M^2 - |x|^2, where M is the
largest norm of all; an anchor gets a zero there.  Then all candidates have norm
M, and distance d and inner product s are one to the other: 2 s = |q|^2 + M^2 - d^2.
A cover tree halves (by ``BASE``) its covering radius from level to level; a node knows the
nearest and the farthest of its descendants, so its distance to an anchor bounds
the scores below it from both sides.  A search goes down best first, leaves out nodes that lie outside
all windows of scores or below what has been found, and computes the scores of
leaves exactly, in whole numbers.

Candidates are dealt to cells by the nearest of a bounded number of pivots; a
cell of many candidates is cut into several trees.  An anchor first searches the
tree of its own cell for a floor, then only trees of cells whose bounds reach
above that floor.  Equal vectors of one label are one candidate with its
smallest ids, which are all that a ranking can ask for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import bounded_sample, small_batches, stored

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: Vectors that pivots are chosen from, pivots at most, and candidates of one tree, about.
SAMPLE, PIVOTS, PER_TREE = 4096, 256, 2048
#: Factor between the covering radii of two levels, children of a node at most (what is left lies in the node's own leaves), vectors of a leaf.
BASE, FANOUT, LEAF = 1.3, 48, 96
#: Requests that meet a tree in one task.
REQUESTS = 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles or longs where they cannot overflow, else in Python's integers; beyond a long, the nearest long."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)), np.int64)
    bound = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(points.astype(np.float64)).max()) * queries.shape[1]
    if bound < 2**52:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return queries @ points.T
    exact = queries.astype(object) @ points.T.astype(object)
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


class CoverTree:
    """A cover tree over whole-number vectors of norm ``top`` at most."""

    def __init__(self, points: np.ndarray, top: float):
        self.points, self.top = points, top
        wide = points.astype(np.float64)
        self.wide = np.hstack((wide, np.sqrt(np.maximum(0.0, top * top - (wide * wide).sum(axis=1)))[:, None]))
        self.centers: list[int] = []
        self.near: list[float] = []
        self.far: list[float] = []
        self.children: list[list[int]] = []
        self.leaves: list[np.ndarray | None] = []
        if len(points):
            self._build()

    def _gaps(self, center: int, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * (self.top * self.top - self.wide[ids] @ self.wide[center])))

    def _node(self, center: int, gaps: np.ndarray, leaf: np.ndarray | None) -> int:
        self.centers.append(center)
        self.near.append(float(gaps.min()))
        self.far.append(float(gaps.max()))
        self.children.append([])
        self.leaves.append(leaf)
        return len(self.centers) - 1

    def _build(self) -> None:
        ids = np.arange(len(self.points))
        gaps = self._gaps(0, ids)
        open_ = [(self._node(0, gaps, None), ids, gaps, float(gaps.max()))]
        while open_:
            node, ids, gaps, radius = open_.pop()
            if len(ids) <= LEAF or radius <= 1e-6 * self.top:
                self._leaves_of(node, ids, gaps)
                continue
            # The next level covers the node's points by balls of a smaller radius; the node's center is its first ball's (nesting), the others lie apart.
            radius /= BASE
            own, nearest, center, balls = np.zeros(len(ids), np.int64), gaps.copy(), self.centers[node], [self.centers[node]]
            while len(balls) < FANOUT and nearest.max() > radius:
                center = int(ids[nearest.argmax()])
                away = self._gaps(center, ids)
                closer = away < nearest
                own[closer], nearest[closer] = len(balls), away[closer]
                balls.append(center)
            rest = nearest > radius
            for k, center in enumerate(balls):
                mine = (own == k) & ~rest
                if mine.any():
                    child = self._node(center, nearest[mine], None)
                    self.children[node].append(child)
                    open_.append((child, ids[mine], nearest[mine], min(radius, float(nearest[mine].max()))))
            if rest.any():
                self._leaves_of(node, ids[rest], gaps[rest])

    def _leaves_of(self, node: int, ids: np.ndarray, gaps: np.ndarray) -> None:
        """Points straight under a node, in leaves that each hold a ring around its center."""
        order = np.argsort(gaps, kind="stable")
        for k in range(0, len(ids), LEAF):
            part = order[k : k + LEAF]
            self.children[node].append(self._node(self.centers[node], gaps[part], ids[part]))

    def _bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of the scores below each node for each query, level by level: a child's are never wider than its parent's."""
        wide = queries.astype(np.float64)
        sizes = np.sqrt((wide**2).sum(axis=1))
        both = (sizes**2 + self.top**2)[:, None]
        distance = np.sqrt(np.maximum(0.0, both - 2 * wide @ self.points[self.centers].T.astype(np.float64)))
        near, far = np.array(self.near), np.array(self.far)
        slack = 1e-7 * (both + 1) + 0.5
        upper = (both - np.maximum(0.0, np.maximum(distance - far, near - distance)) ** 2) / 2 + slack
        lower = np.minimum((both - (distance + far) ** 2) / 2 - slack, HIGHEST)
        level = self.children[0]
        parent = np.zeros(len(self.centers), np.int64)
        for node, children in enumerate(self.children):
            parent[children] = node
        while level:
            upper[:, level] = np.minimum(upper[:, level], upper[:, parent[level]])
            lower[:, level] = np.maximum(lower[:, level], lower[:, parent[level]])
            level = [c for node in level for c in self.children[node]]
        return upper, lower

    def search(self, queries: np.ndarray, floor: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidates, their scores) of the leaves that may matter, each query's best first.

        A query is done when the best leaf that is left lies below its
        ``floor``, which the caller raises as it learns; leaves above ``high``
        are left out.  Queries that go to one leaf at once are scored together.
        """
        if not self.centers or not len(queries):
            return
        upper, lower = self._bounds(queries)
        leaves = np.array([k for k, x in enumerate(self.leaves) if x is not None])
        order = leaves[np.argsort(-upper[:, leaves], axis=1, kind="stable")]
        rows, alive = np.arange(len(queries)), np.ones(len(queries), bool)
        for own in order.T:
            alive &= upper[rows, own] >= floor
            if not alive.any():
                return
            todo = np.flatnonzero(alive & (lower[rows, own] <= high))
            for leaf in np.unique(own[todo]).tolist():
                at = todo[own[todo] == leaf]
                yield at, self.leaves[leaf], scores(queries[at], self.points[self.leaves[leaf]])


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): rows that take part, each once, their vectors as whole numbers."""
    label = F.when(F.col("vec_id").cast("long") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return rows.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("vector"))


def candidates(rows: DataFrame) -> DataFrame:
    """(label, vector, ids): of equal vectors of a label the six smallest ids, a null one last; a ranking asks for five besides the anchor.

    Ranks are cut on the map side first, so copies of one vector are never gathered.
    """
    order = Window.partitionBy("label", "vector").orderBy(F.col("vec_id").asc_nulls_last())
    most = max(POSITIVES, NEGATIVES) + 1
    few = rows.distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "vec_id"))), lambda x: x["vec_id"])
    return few.groupBy("label", "vector").agg(ids.alias("ids"))


def _packed(rows: Iterable, width: int) -> np.ndarray:
    """Arrays of whole numbers as one matrix, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """The centers of a cover: each the vector farthest from those before it."""
    wide = sample.astype(np.float64)
    chosen, nearest = [0], ((wide - wide[0]) ** 2).sum(axis=1)
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((wide - wide[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _list_matrix(column, width: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    return _packed(column.to_pylist(), width)


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    wide = points.astype(np.float64)
    return ((pivots * pivots).sum(axis=1)[None] - 2 * wide @ pivots.T).argmin(axis=1)


def _cells(rows: DataFrame, pivots: np.ndarray, name: str) -> DataFrame:
    """Adds ``name``, the nearest pivot's number."""
    wide = pivots.astype(np.float64)

    def run(batches):
        for batch in batches:
            cell = _nearest(_list_matrix(batch.column("vector"), wide.shape[1]), wide)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, IntegerType())]))


class Trees:
    """The candidates of a table in cover trees, with what is known of every cell.

    ``table`` has a row for each tree: its cell, its number within the cell, and
    its candidates (labels, ids, vectors).
    """

    def __init__(self, rows: DataFrame, per_tree: int = PER_TREE):
        small_batches(rows.sparkSession, rows=8192, megabytes=16)
        found = stored(candidates(rows), "candidates")
        whole = found.agg(F.max(F.size("vector")), F.count("*")).first()
        self.width, self.count = max(1, whole[0] or 1), whole[1]
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.top = float(np.sqrt(found.agg(F.max(square)).first()[0] or 0.0))
        sample = [r[0] for r in bounded_sample(found.select("vector"), ["vector"], SAMPLE).collect()]
        # As many pivots as there are trees in need of them, up to a bound: beyond it cells are cut.
        self.pivots = pivots_of(_packed(sorted(sample), self.width), max(1, min(PIVOTS, -(-self.count // max(1, per_tree // 2))))) if sample else np.zeros((1, self.width), np.int64)
        dealt = stored(_cells(found, self.pivots, "cell"), "tree-candidates")
        sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.parts = np.ones(len(self.pivots), np.int64)
        for cell, n in sizes.items():
            self.parts[cell] = max(1, -(-n // per_tree))
        parts = F.array(*[F.lit(int(n)) for n in self.parts])
        part = F.pmod(F.xxhash64("vector", "label"), F.get(parts, "cell")).cast("int")
        self.table = dealt.withColumn("part", part)
        self.bounds = self._bounds()

    def _bounds(self) -> np.ndarray:
        """For each cell the nearest and the farthest of its candidates from its pivot, augmented; cells without any are infinitely far."""
        pivots, top, width = self.pivots, self.top, self.width
        wide = augmented(pivots, top)

        def run(batches):
            for batch in batches:
                own = augmented(_list_matrix(batch.column("vector"), width), top)
                cell = batch.column("cell").to_numpy()
                gap = np.sqrt(((own - wide[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(gap)], names=["cell", "gap"])

        out = np.full((len(pivots), 2), np.inf)
        for r in self.table.select("cell", "vector").mapInArrow(run, "cell int, gap double").groupBy("cell").agg(F.min("gap").alias("a"), F.max("gap").alias("b")).collect():
            out[r["cell"]] = r["a"], r["b"]
        return out

    def cell_bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of the scores in each cell for each query."""
        sizes = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        both = (sizes**2 + self.top**2)[:, None]
        distance = np.sqrt(np.maximum(0.0, both - 2 * queries.astype(np.float64) @ self.pivots.T.astype(np.float64)))
        slack = 1e-7 * (both + 1) + 0.5
        near, far = self.bounds[:, 0], self.bounds[:, 1]
        filled = np.isfinite(far)
        far, near = np.where(filled, far, 0), np.where(filled, near, 0)
        least = np.maximum(0.0, np.maximum(distance - far, near - distance))
        upper = np.where(filled, (both - least**2) / 2 + slack, -np.inf)
        lower = np.where(filled, np.minimum((both - (distance + far) ** 2) / 2 - slack, HIGHEST), np.inf)
        return upper, lower


def augmented(points: np.ndarray, top: float) -> np.ndarray:
    wide = points.astype(np.float64)
    return np.hstack((wide, np.sqrt(np.maximum(0.0, top * top - (wide * wide).sum(axis=1)))[:, None]))


FOUND = "request string, window int, score long, vec_id long"


def first_of(asks: DataFrame, anchors: DataFrame, trees: Trees, most: int, same: bool) -> DataFrame:
    """(request, window, score, vec_id, rank) of the first ``most`` candidates of each window, of higher scores first and equal ones by smaller id.

    A row of ``asks`` (request, window, low, high) asks for candidates with
    scores from ``low`` to ``high`` for the vector of the row of ``anchors``
    (request, anchor_id, label, vector): candidates of its label (``same``), its own id left out, or
    of any other label.
    """
    asks = asks.withColumn("floor", F.col("low"))
    parts = F.array(*[F.lit(int(n)) for n in trees.parts])
    home = _cells(_gathered(asks, anchors), trees.pivots, "cell").withColumn("part", F.pmod(F.xxhash64("request"), F.get(parts, "cell")).cast("int"))
    at_home = stored(_met(home, trees, most, same), "found-at-home")
    # The last of enough found at home is a floor for all other trees.
    order = Window.partitionBy("request", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    floors = at_home.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == most).select("request", "window", F.col("score").alias("_floor"))
    raised = asks.join(floors, ["request", "window"], "left").withColumn("floor", F.greatest("floor", F.coalesce("_floor", F.col("floor")))).drop("_floor")
    found = at_home
    if trees.parts.sum() > 1:
        found = at_home.unionByName(_met(_others(_gathered(raised, anchors), trees), trees, most, same))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _gathered(asks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors that ask, each with its windows."""
    windows = asks.groupBy("request").agg(F.collect_list(F.struct("window", "low", "high", "floor")).alias("windows"))
    return anchors.join(windows, "request")


def _others(requests: DataFrame, trees: Trees) -> DataFrame:
    """Each request with every tree but its home whose cell's bounds reach into one of its windows."""
    names = [*requests.columns, "cell", "part", "home"]
    schema = StructType([*requests.schema.fields, *[StructField(n, IntegerType()) for n in names[-3:]]])
    cells, width, parts, pivots = _Bounds(trees), trees.width, trees.parts, trees.pivots.astype(np.float64)

    def run(batches):
        for batch in batches:
            own = _list_matrix(batch.column("vector"), width)
            upper, lower = cells(own)
            meets = np.zeros(upper.shape, bool)
            for k, windows in enumerate(batch.column("windows").to_pylist()):
                for w in windows:
                    meets[k] |= (upper[k] >= float(w["floor"])) & (lower[k] <= float(w["high"]))
            row, cell = np.nonzero(meets)
            each = parts[cell]
            part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            row, cell = np.repeat(row, each), np.repeat(cell, each)
            home = _nearest(own, pivots)
            for k in range(0, len(row), 4096):
                at = slice(k, k + 4096)
                taken = batch.take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(x[at].astype(np.int32)) for x in (cell, part, home[row])]], names=names)

    spread = requests.mapInArrow(run, schema)
    mine = F.pmod(F.xxhash64("request"), F.get(F.array(*[F.lit(int(n)) for n in trees.parts]), "home")).cast("int")
    return spread.where(~((F.col("cell") == F.col("home")) & (F.col("part") == mine))).drop("home")


class _Bounds:
    """``Trees.cell_bounds`` without the trees' tables, for the executors."""

    def __init__(self, trees: Trees):
        self.pivots, self.top, self.bounds = trees.pivots, trees.top, trees.bounds

    __call__ = Trees.cell_bounds


def _met(requests: DataFrame, trees: Trees, most: int, same: bool) -> DataFrame:
    """What each request finds in the tree that it is sent to, up to ``most`` a window; a tree is sent along for every ``REQUESTS`` of them."""
    width, top = trees.width, trees.top
    met = stored(requests, "tree-requests")
    load = met.groupBy("cell", "part").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("copies"))
    dealt = met.join(load, ["cell", "part"]).withColumn("copy", F.pmod(F.xxhash64("request"), F.col("copies")).cast("int")).drop("copies")
    sent = trees.table.join(load, ["cell", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def run(key, wanted, held):
        out = []
        if held.num_rows and wanted.num_rows:
            tree = CoverTree(_list_matrix(held.column("vector").combine_chunks(), width), top)
            labels, ids = np.array(held.column("label").to_pylist(), np.int64), held.column("ids").to_pylist()
            queries = _list_matrix(wanted.column("vector").combine_chunks(), width)
            whose = wanted.drop_columns(["vector"]).to_pylist()
            label = np.array([r["label"] for r in whose], np.int64)
            best = [[[] for _ in r["windows"]] for r in whose]
            lows = [[w["floor"] for w in r["windows"]] for r in whose]
            floor, high = np.array([min(x) for x in lows], np.float64), np.array([max(w["high"] for w in r["windows"]) for r in whose], np.float64)
            for at, leaf, found in tree.search(queries, floor, high):
                near = found.astype(np.float64)
                right = ((labels[leaf][None] == label[at][:, None]) == same) & (near >= floor[at][:, None]) & (near <= high[at][:, None])
                for row in np.flatnonzero(right.any(axis=1)).tolist():
                    q, columns = int(at[row]), np.flatnonzero(right[row])
                    each = list(zip(found[row, columns].tolist(), leaf[columns].tolist()))
                    for k, w in enumerate(whose[q]["windows"]):
                        fresh = [(-score, x is None, x) for score, i in each if lows[q][k] <= score <= w["high"] for x in ids[i] if not (same and x == whose[q]["anchor_id"])]
                        if fresh:
                            best[q][k] = sorted(best[q][k] + fresh, key=lambda x: (x[0], x[1], x[2] or 0))[:most]
                            if len(best[q][k]) == most:
                                lows[q][k] = max(lows[q][k], -best[q][k][-1][0])
                    floor[q] = min(lows[q])
            out = [(r["request"], w["window"], -score, x) for r, b in zip(whose, best) for w, own in zip(r["windows"], b) for score, _, x in own]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["request", "window", "score", "vec_id"])

    return dealt.groupBy("cell", "part", "copy").cogroup(sent.groupBy("cell", "part", "copy")).applyInArrow(run, FOUND)


def hard_negatives(rows: DataFrame, anchor: Column | None = None, share: tuple[int, int] = (80, 100), per_tree: int = PER_TREE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, embedding, label, and any others).

    Anchors are the rows where ``anchor`` holds (vec_id divisible by 100).  An
    anchor's positives are its first rows of the same label, its own id left
    out; a positive's negatives the first rows of other labels whose score is
    between the given share (numerator, denominator) of the positive's and the
    positive's.  Higher scores come first, equal ones by smaller id, a null id
    last.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part.  A row that repeats in id, label and vector counts once; rows
    of one id that differ are rows of their own.  Vectors of different lengths
    are filled up with zeros, an empty one scores zero with all.  Components
    beyond what a long holds become the nearest long, and so do scores; others
    are exact.  An empty table gives no rows.
    """
    taken = stored(vectors(rows).distinct(), "whole-vectors")
    trees = Trees(taken, per_tree)
    key = F.sha2(F.concat_ws(",", "vec_id", "label", F.array_join(F.col("vector").cast("array<string>"), " ")), 256)
    anchors = taken.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    anchors = stored(anchors.select(key.alias("request"), F.col("vec_id").alias("anchor_id"), "label", "vector"), "anchors")
    asked = anchors.select("request", F.lit(0).alias("window"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high"))
    positives = first_of(asked, anchors, trees, POSITIVES, True)
    positives = stored(positives.select("request", F.col("rank").alias("window"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    part, whole = share
    # The least whole score that is at least the share of the positive's; no score is below a negative one's share and below itself.
    least = F.expr(f"cast((cast(positive_score as decimal(20,0)) * {part} + {whole - 1}) div {whole} as bigint)")
    asked = positives.where("positive_score >= 0").select("request", "window", least.alias("low"), F.col("positive_score").alias("high"))
    negatives = first_of(asked, anchors, trees, NEGATIVES, False)
    negatives = negatives.select("request", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = negatives.join(positives, ["request", "window"]).join(anchors.select("request", "anchor_id"), "request")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
