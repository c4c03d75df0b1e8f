"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors get one more coordinate, ``sqrt(M^2 - |x|^2)`` with the largest norm M,
and queries a zero, scaled to norm M: the nearest by distance on that sphere are
those of the largest inner product. ``trees`` trees split it by random
directions at medians. They are fitted on the driver on at most ``sample``
distinct vectors (those of the least hash); the forest is sent to all tasks and
its size is bounded by ``sample``, whatever the number of vectors.

*Index*: every distinct vector goes to one leaf of each tree, as rows of a cell
(tree, leaf, part); leaves are counted on all vectors, and those of more than
``CELL`` are cut into parts. *Search*: one priority queue over the nodes of all
trees serves a query: nodes come in the order of the least margin by which the
query lies on their side, until the leaves taken hold a given share of all
vectors, and those of some one tree at least ``k + 1`` vectors, or all there are.
That share is calibrated, not guessed: for at most ``tests`` vectors of the
sample, the exact nearest among all vectors are found in one pass, and the share
is the least that finds ``recall`` of them. It falls as vectors become more, where
data are clustered. Queries are rows of the cells they take. *Rerank*: cells are
dealt out, and in each the exact inner products in double precision of its queries
and its vectors give the nearest of the cell; each task merges those of its cells,
and their union is ranked. Equal scores are told apart by the smallest id, in
cells as in the union.

Equal vectors are one class, indexed once, with their ``k + 1`` smallest ids: no
result needs more of them, so a vector that a third of all rows share costs no
more than others. Queries of one class are searched once, too.

Defined results: vectors that are null, all zeros, hold a null or a non-finite
component, or don't have the most frequent length take no part, nor do rows with
a null id. Rows that repeat id and vector are one; an id with several vectors is
several candidates, and as a query is searched with each, ranked as one.
Fewer candidates than ``k``: all of them. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprism.llm.shared import materialize

SAMPLE = 20000

#: Vectors that a task holds of a cell; larger cells are cut into blocks, and queries go to each.
CELL = 16384

#: Nearest vectors that a task holds before it merges them.
HELD = 1 << 20
PAIRS = 1 << 16


@dataclass(frozen=True)
class Search:
    """Parameters of index and search."""

    k: int = 20
    trees: int = 4
    recall: float = 0.95
    tests: int = 200
    sample: int = SAMPLE
    seed: int = 11


@dataclass
class Tree:
    """Inner node i has a direction, a threshold and two children; a child below 0 is leaf ``-child - 1``."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    share: np.ndarray
    root: int

    def leaves(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (at >= 0).any():
            inner = np.flatnonzero(at >= 0)
            node = at[inner]
            right = np.einsum("ij,ij->i", points[inner], self.directions[node]) > self.cuts[node]
            at[inner] = self.children[node, right.astype(int)]
        return -at - 1


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over ``points`` with leaves of at most ``leaf`` of them."""
    directions, cuts, children, share = [], [], [], []

    def split(rows: np.ndarray, depth: int) -> int:
        if len(rows) <= leaf or depth > 40:
            share.append(len(rows) / len(points))
            return -len(share)
        # A direction between two points follows the data where it is clustered.
        a, b = points[rng.choice(rows, 2, replace=False)]
        way = a / max(np.linalg.norm(a), 1e-30) - b / max(np.linalg.norm(b), 1e-30)
        if not way.any():
            way = rng.standard_normal(points.shape[1])
        way = way / np.linalg.norm(way)
        values = points[rows] @ way
        cut = float(np.median(values))
        right = values > cut
        if not right.any() or right.all():
            share.append(len(rows) / len(points))
            return -len(share)
        node = len(cuts)
        directions.append(way)
        cuts.append(cut)
        children.append([0, 0])
        children[node] = [split(rows[~right], depth + 1), split(rows[right], depth + 1)]
        return node

    root = split(np.arange(len(points)), 0)
    dim = points.shape[1]
    return Tree(np.array(directions).reshape(-1, dim), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(share), root)


@dataclass
class Forest:
    trees: list[Tree]
    norm: float
    share: float = 1.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Indexed vectors on the sphere."""
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors * vectors).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def lift_query(self, vectors: np.ndarray) -> np.ndarray:
        scale = self.norm / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.concatenate([vectors * scale, np.zeros((len(vectors), 1))], axis=1)

    def probes(self, point: np.ndarray, share: float, least: float = 0) -> list[tuple[int, int]]:
        """Cells (tree, leaf) to look into, by one queue over all trees, for a share of all vectors and at least so much of them in one tree."""
        margins = [t.directions @ point - t.cuts for t in self.trees]
        queue = [(-np.inf, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, held, by_tree = [], 0.0, [0.0] * len(self.trees)
        while queue and (held < share or max(by_tree) < least):
            cost, i, node = heapq.heappop(queue)
            tree, margin = self.trees[i], margins[i]
            while node >= 0:
                side = margin[node] > 0
                heapq.heappush(queue, (max(cost, abs(margin[node])), i, int(tree.children[node, 1 - side])))
                node = int(tree.children[node, int(side)])
            found.append((i, -node - 1))
            held += tree.share[-node - 1]
            by_tree[i] += tree.share[-node - 1]
        return found

    def needed(self, queries: np.ndarray, near: list[np.ndarray], recall: float) -> float:
        """The share of vectors to look at for ``recall`` of all nearest vectors; ``near`` has the leaves of those of each query, a row each."""
        first = []
        for query, leaf in zip(self.lift_query(queries), near):
            when, held = np.full([len(self.trees), max(len(t.share) for t in self.trees)], np.inf), 0.0
            for i, j in self.probes(query, np.inf):
                held += self.trees[i].share[j]
                when[i, j] = held
            first.append(np.take_along_axis(when, leaf.T, axis=1).min(axis=0))
        found = np.concatenate(first) if first else np.zeros(0)
        return float(np.quantile(found, recall, method="higher")) if len(found) else float(len(self.trees))


def near_within(vectors: np.ndarray, tests: np.ndarray, k: int) -> list[np.ndarray]:
    """The numbers of the ``k`` nearest to each of the test vectors among all, without itself."""
    out = []
    for own in tests:
        scores = vectors @ vectors[own]
        scores[own] = -np.inf
        out.append(np.argsort(-scores, kind="stable")[: min(k, len(vectors) - 1)])
    return out


def usable(vector: Column) -> Column:
    """No null, no non-finite component, and not all zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, p: Search) -> DataFrame:
    """(c1, c2, vector, members): each distinct vector with its ``k + 1`` smallest ids.

    The rank limit is applied within each task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.distinct().withColumn("n", rank).where(F.col("n") <= p.k + 1)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return grouped.select(F.element_at("members", 1).alias("c1"), F.xxhash64("vector").alias("c2"), "vector", "members")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit(known: DataFrame, p: Search) -> tuple[Forest, list[np.ndarray]] | None:
    """The forest, fitted on a bounded sample and calibrated on all vectors, and the number of parts of each tree's leaves."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total, largest = known.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not total:
        return None
    rows = known.select("vector", "c1", "c2", F.xxhash64("vector", F.lit(p.seed)).alias("h")).orderBy("h", "c1", "c2").limit(p.sample).drop("h").toArrow()
    sample = _matrix(rows["vector"].combine_chunks())
    forest = Forest([], float(largest) * (1 + 1e-12))
    points, tests = forest.lift(sample), np.random.default_rng(p.seed).permutation(len(sample))[: p.tests]
    near, leaves = near_within(sample, tests, p.k), 16
    while True:
        in_leaf = max(4, -(-len(sample) // leaves))
        forest.trees = [grow(points, in_leaf, np.random.default_rng([p.seed, i])) for i in range(p.trees)]
        where = np.stack([t.leaves(points) for t in forest.trees], axis=1)
        forest.share = forest.needed(sample[tests], [where[n] for n in near], p.recall)
        if forest.share * leaves > 16 or in_leaf <= 16:
            break
        leaves *= 4
    if total == len(sample):
        counts = [np.bincount(where[:, i], minlength=len(t.share)) for i, t in enumerate(forest.trees)]
    else:
        asked = [sample[tests], np.asarray(rows["c1"])[tests], np.asarray(rows["c2"])[tests]]
        counts, near = _measured(known, forest, asked, p)
    for tree, n in zip(forest.trees, counts):
        tree.share = n / total
    if total > len(sample):
        forest.share = forest.needed(asked[0], near, p.recall)
    return forest, [np.maximum(1, -(-n // CELL)).astype(np.int64) for n in counts]


def _measured(known: DataFrame, forest: Forest, asked: list[np.ndarray], p: Search) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(vectors in each leaf of each tree, leaves of the nearest to each test vector), over all vectors.

    The driver gets a number for each leaf and ``k`` rows for each test.
    """
    shared = known.sparkSession.sparkContext.broadcast((forest, asked))
    row = "q int, score double, c1 long, c2 long, leaves array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value[0]
        for batch in batches:
            points = forest.lift(_matrix(batch.column("vector")))
            for i, tree in enumerate(forest.trees):
                n = np.bincount(tree.leaves(points), minlength=len(tree.share))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], ["tree", "leaf", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, (queries, q1, q2) = shared.value
        for batch in batches:
            vectors, c1, c2 = _matrix(batch.column("vector")), np.asarray(batch.column("c1")), np.asarray(batch.column("c2"))
            scores = queries @ vectors.T
            scores[(q1[:, None] == c1[None, :]) & (q2[:, None] == c2[None, :])] = -np.inf
            n = min(p.k, len(vectors))
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            x, y = np.repeat(np.arange(len(queries)), n), top.ravel()
            x, y = x[np.isfinite(scores[x, y])], y[np.isfinite(scores[x, y])]
            points = forest.lift(vectors[y])
            leaves = np.stack([t.leaves(points) for t in forest.trees], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(y) + 1) * leaves.shape[1]).astype(np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(scores[x, y]), pa.array(c1[y]), pa.array(c2[y]), lists], ["q", "score", "c1", "c2", "leaves"])

    counts = [np.zeros(len(t.share), np.int64) for t in forest.trees]
    for r in known.select("vector").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.tree][r.leaf] = r.n
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c1", "c2"))
    top = known.select("vector", "c1", "c2").mapInArrow(best, row).withColumn("place", place).where(F.col("place") <= p.k).select("q", "leaves").toPandas()
    return counts, [np.array(top["leaves"][top["q"] == q].tolist(), np.int64).reshape(-1, len(forest.trees)) for q in range(len(asked[0]))]


def _top(scores: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` largest scores, equal ones by the least ids."""
    if len(scores) > n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((second[some], first[some], -scores[some]))[:n]]


class _Nearest:
    """The nearest classes of each query of a task, over all of its cells."""

    def __init__(self, n: int):
        self.n, self.parts, self.size = n, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """q1, q2, c1, c2 and score of pairs."""
        self.parts.append(columns)
        self.size += len(columns[0])

    def merge(self) -> None:
        q1, q2, c1, c2, score = (np.concatenate([x[j] for x in self.parts]) for j in range(5))
        order = np.lexsort((c2, c1, -score, q2, q1))
        q1, q2, c1, c2, score = (x[order] for x in (q1, q2, c1, c2, score))
        new = np.ones(len(q1), bool)
        new[1:] = (q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        q1, q2, c1, c2, score = (x[new] for x in (q1, q2, c1, c2, score))
        start = np.flatnonzero(np.concatenate([[True], (q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1])])) if len(q1) else np.zeros(0, np.int64)
        rank = np.arange(len(q1)) - np.repeat(start, np.diff(np.append(start, len(q1))))
        keep = rank < self.n
        self.parts, self.size = [tuple(x[keep] for x in (q1, q2, c1, c2, score))], int(keep.sum())

    def rows(self) -> pa.RecordBatch:
        self.merge()
        (columns,), self.parts, self.size = self.parts, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q1", "q2", "c1", "c2", "score"])


def nearest(vectors: DataFrame, queries: Column, p: Search | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of ``vectors`` (vec_id, vector) to those that ``queries`` selects.

    ``queries`` is a condition on ``vec_id``.
    """
    p = p or Search()
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    modal = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    good = good.join(F.broadcast(modal.select("n")), F.size("vector") == F.col("n"), "left_semi")
    known = materialize(classes(good, p), "classes")
    asked = materialize(good.where(queries).distinct().join(known.select("c1", "c2", F.col("vector").alias("v")), F.col("vector") == F.col("v")).select(F.col("vec_id").alias("query_id"), "c1", "c2"), "queries")
    fitted = fit(known, p)
    schema = "query_id long, rank int, vec_id long, score double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    total = known.count()
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)
    least = min(p.k + 1, total) / total * (1 - 1e-9)
    searched = known.select("c1", "c2", "vector").join(asked.select("c1", "c2").distinct(), ["c1", "c2"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = shared.value
        for batch in batches:
            points = forest.lift(_matrix(batch.column("vector")))
            salt = np.asarray(batch.column("c2")).view(np.uint64) >> np.uint64(1)
            for i, tree in enumerate(forest.trees):
                leaf = tree.leaves(points)
                part = salt.astype(np.int64) % parts[i][leaf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), i, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(points), bool)), *[batch.column(c) for c in ("c1", "c2", "vector")]],
                    ["tree", "leaf", "part", "asks", "c1", "c2", "vector"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = shared.value
        for batch in batches:
            points = forest.lift_query(_matrix(batch.column("vector")))
            held: list[tuple] = []
            for j in range(len(points)):
                held += [(j, *cell, part) for cell in forest.probes(points[j], forest.share, least) for part in range(parts[cell[0]][cell[1]])]
                if len(held) > 32768 or j == len(points) - 1:
                    cells, held = np.array(held, np.int32).reshape(-1, 4), []
                    row = pa.array(cells[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(cells[:, c]) for c in (1, 2, 3)], pa.array(np.ones(len(cells), bool)), *[batch.column(c).take(row) for c in ("c1", "c2", "vector")]],
                        ["tree", "leaf", "part", "asks", "c1", "c2", "vector"],
                    )

    item = known.schema["vector"].dataType.simpleString()
    cell_schema = f"tree int, leaf int, part int, asks boolean, c1 long, c2 long, vector {item}"
    cells = known.select("c1", "c2", "vector").mapInArrow(index, cell_schema).unionByName(searched.mapInArrow(probe, cell_schema))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, own, found = None, [], None, _Nearest(p.k + 1)
        for now, asks, rows in _runs(batches):
            if now != cell:
                cell, held, own = now, [], None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue
            if own is None:
                table = pa.Table.from_batches(held)
                own = _matrix(table.column("vector").combine_chunks()), np.asarray(table.column("c1")), np.asarray(table.column("c2"))
            vectors, c1, c2 = own
            for at in range(0, len(rows), 128):
                some = rows.slice(at, 128)
                q, q1, q2 = _matrix(some.column("vector")), np.asarray(some.column("c1")), np.asarray(some.column("c2"))
                rough = q @ vectors.T
                # Those within rounding of the last place are computed again, each product in the same order.
                n = min(p.k + 1, len(vectors))
                edge = np.partition(rough, len(vectors) - n, axis=1)[:, len(vectors) - n]
                slack = 1e-12 * np.abs(q).sum(axis=1) * np.abs(vectors).max()
                x, y = np.nonzero(rough >= (edge - slack)[:, None])
                exact = np.concatenate([(q[x[i : i + PAIRS]] * vectors[y[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(x), PAIRS)])
                bounds = np.searchsorted(x, np.arange(len(q) + 1))
                keep = np.concatenate([a + _top(exact[a:b], c1[y[a:b]], c2[y[a:b]], n) for a, b in zip(bounds[:-1], bounds[1:])])
                x, y, exact = x[keep], y[keep], exact[keep]
                found.add(q1[x], q2[x], c1[y], c2[y], exact)
            if found.size > HELD:
                found.merge()
                if found.size > HELD // 2:
                    yield found.rows()
        if found.size:
            yield found.rows()

    dealt = cells.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "asks")
    pairs = dealt.mapInArrow(rerank, "q1 long, q2 long, c1 long, c2 long, score double").groupBy("q1", "q2", "c1", "c2").agg(F.max("score").alias("score"))
    # Of equal scores the class of the smaller id is the nearer one.
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "c1", "c2"))).where(F.col("n") <= p.k + 1)
    named = best.join(known.select("c1", "c2", "members"), ["c1", "c2"]).select("q1", "q2", "score", F.explode("members").alias("vec_id"))
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= p.k + 1)
    each = asked.join(ranked.select(F.col("q1").alias("c1"), F.col("q2").alias("c2"), "score", "vec_id"), ["c1", "c2"]).where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """((tree, leaf, part), asks, rows): pieces of batches sorted by cell, a cell's vectors before its queries."""
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("tree", "leaf", "part", "asks")])
        edges = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), len(batch))
        for a, b in zip(edges[:-1], edges[1:]):
            yield tuple(keys[:3, a].tolist()), bool(keys[3, a]), batch.slice(a, b - a)
