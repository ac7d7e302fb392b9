"""Centroid clustering: Lloyd's rounds over two cover trees, one of vectors and one of centroids.

Vectors are put into cover trees once, one for each block of rows as it is read; these are written and read again in every round. A round
makes a tree of the centroids, sends it to all tasks, and goes down both trees at once: pairs of a vector node and a centroid node are
dropped where no vector of the one can have its nearest centroid in the other. A node left with one centroid is
assigned whole; in leaves, what is left is compared exactly, in integers. Only sums by cluster and component leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.topk import quantised
from textloom.plans.scratch import settle

WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
VECTORS_A_TREE = 1024
VECTORS_A_LEAF = 16
#: Below this components, squared distances are whole numbers that doubles hold exactly.
EXACT_BELOW = 1 << 22
LARGEST = (1 << 63) - 1


# ---- trees ----------------------------------------------------------------------------------------


class CoverTree:
    """Nodes in breadth-first order: a pivot (one of the node's rows), a radius, a range of ``order``, and a range of children.

    Children's pivots are further apart than the scale of their level, a power of two, and cover the node within it; the first child has its
    parent's pivot.
    """

    def __init__(self, order: np.ndarray, pivot: np.ndarray, radius: np.ndarray, rows: np.ndarray, children: np.ndarray):
        self.order, self.pivot, self.radius, self.rows, self.children = order, pivot, radius, rows, children


def _distances(x: np.ndarray) -> np.ndarray:
    norm = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(0, norm[:, None] - 2 * (x @ x.T) + norm[None, :]))


def cover_tree(x: np.ndarray, leaf: int) -> CoverTree:
    """The tree over the rows of ``x``, one at least, down to nodes of ``leaf`` rows or of equal ones."""
    far = _distances(x)
    nodes: list[tuple[int, np.ndarray]] = [(0, np.arange(len(x)))]
    radius, children = [], []
    n = 0
    while n < len(nodes):
        pivot, rows = nodes[n]
        own = far[pivot, rows]
        radius.append(float(own.max()))
        first = len(nodes)
        if len(rows) > leaf and radius[-1] > 0:
            scale = 2.0 ** (np.ceil(np.log2(radius[-1])) - 1)
            left, centre = rows, pivot
            while len(left):
                near = far[centre, left] <= scale
                near[left == centre] = True
                nodes.append((centre, left[near]))
                left = left[~near]
                centre = int(left[0]) if len(left) else -1
        children.append((first, len(nodes)))
        n += 1
    # rows in the order of the leaves, so that each node has a range
    ranges = np.zeros((len(nodes), 2), int)
    order: list[np.ndarray] = []
    at, stack = 0, [(0, False)]
    while stack:
        n, done = stack.pop()
        a, b = children[n]
        if done:
            ranges[n] = ranges[a, 0], ranges[b - 1, 1]
        elif a == b:
            ranges[n] = at, at + len(nodes[n][1])
            order.append(nodes[n][1])
            at += len(nodes[n][1])
        else:
            stack += [(n, True), *((c, False) for c in reversed(range(a, b)))]
    return CoverTree(np.concatenate(order), np.array([p for p, _ in nodes]), np.array(radius), ranges, np.array(children))


def _expanded(pairs: np.ndarray, side: int, children: np.ndarray) -> np.ndarray:
    """Pairs with each node of one side replaced by its children; leaves stay."""
    a, b = children[pairs[:, side]].T
    times = np.maximum(1, b - a)
    out = np.repeat(pairs, times, axis=0)
    step = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    out[:, side] = np.where(np.repeat(b > a, times), np.repeat(a, times) + step, out[:, side])
    return out


def candidates(x: np.ndarray, tree: CoverTree, c: np.ndarray, centroids: CoverTree) -> np.ndarray:
    """For each row of ``x``, in the tree's order, which centroids may be its nearest: all that are, and few others."""
    far = np.sqrt(np.maximum(0, (x[tree.pivot] ** 2).sum(axis=1)[:, None] - 2 * x[tree.pivot] @ c.T + (c**2).sum(axis=1)[None, :]))
    slack = 1e-6 * (1 + np.sqrt(max((x**2).sum(axis=1).max(), (c**2).sum(axis=1).max())))
    mask = np.zeros((len(x), len(c)), bool)
    pairs = np.zeros((1, 2), int)
    while len(pairs):
        node, other = pairs.T
        d = far[node, centroids.pivot[other]]
        most = np.full(len(tree.pivot), np.inf)
        np.minimum.at(most, node, d + tree.radius[node])
        pairs = pairs[d - tree.radius[node] - centroids.radius[other] <= most[node] + slack]
        node, other = pairs.T
        inner = centroids.children[other, 1] > centroids.children[other, 0]
        if inner.any():
            pairs = _expanded(pairs, 1, centroids.children)
            continue
        # a centroid node that is a leaf has its rows at one point: all of them stay
        several = np.bincount(node, minlength=len(tree.pivot)) > 1
        end = (tree.children[node, 1] == tree.children[node, 0]) | ~several[node]
        for n, o in pairs[end]:
            (a, b), (p, q) = tree.rows[n], centroids.rows[o]
            mask[a:b, centroids.order[p:q]] = True
        pairs = _expanded(pairs[~end], 0, tree.children)
    return mask


def _squared(x: np.ndarray, c: np.ndarray, largest: int) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from ``c``: doubles that are whole numbers, or Python's integers."""
    if largest < EXACT_BELOW:
        return ((x - c).astype(float) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def nearest(ordered: np.ndarray, tree: CoverTree, c: np.ndarray, centroids: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """For each row, in the tree's order, the number of its nearest centroid, the smaller of equally near ones, and the squared distance."""
    x = np.empty(ordered.shape)
    x[tree.order] = ordered
    mask = candidates(x, tree, c.astype(float), centroids)
    largest = max(abs(int(ordered.max())), abs(int(ordered.min())), abs(int(c.max())), abs(int(c.min())))
    best = np.zeros(len(x), int)
    least = np.full(len(x), np.inf, dtype=float if largest < EXACT_BELOW else object)
    for k in range(len(c)):
        rows = np.flatnonzero(mask[:, k])
        d = _squared(ordered[rows], c[k], largest)
        closer = (d < least[rows]).astype(bool)
        best[rows[closer]], least[rows[closer]] = k, d[closer]
    return best, least


# ---- tables ---------------------------------------------------------------------------------------

_TREE = "ids array<long>, vectors array<long>, place array<int>, pivot array<int>, radius array<double>, row_ranges array<int>, child_ranges array<int>"


def _trees(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """A row a tree: vectors in the tree's order, and its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                batch = whole.slice(lo, size)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                tree = cover_tree(x.astype(float), leaf)
                ids = batch.column(0).take(pa.array(tree.order)).to_pylist()
                parts = [ids, x[tree.order].ravel(), tree.order, tree.pivot, tree.radius, tree.rows.ravel(), tree.children.ravel()]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                columns = [pa.array([p], pa.list_(t)) for p, t in zip(parts, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _TREE.split(", ")])

    return rows.mapInArrow(run, _TREE)


def _read(row: dict) -> tuple[pa.Array, np.ndarray, CoverTree]:
    flat = [row[f.split()[0]].values for f in _TREE.split(", ")]
    n = len(flat[0])
    order, pivot, radius, rows, children = (p.to_numpy(zero_copy_only=False) for p in flat[2:])
    tree = CoverTree(order, pivot, radius, rows.reshape(-1, 2), children.reshape(-1, 2))
    return flat[0], flat[1].to_numpy(zero_copy_only=False).reshape(n, -1), tree


def _each_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _read({name: batch.column(name)[i] for name in batch.schema.names})


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids become the rounded-down means of their vectors; those without any stay.

    A task returns a sum for a cluster and component at most, and that many sums come to the driver.
    """
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        of_centroids = cover_tree(c.astype(float), 1)
        sums, counts = np.zeros(c.shape, object), np.zeros(len(c), object)
        for _, x, tree in _each_tree(batches):
            best, _ = nearest(x, tree, c, of_centroids)
            for k in np.unique(best):
                mine = x[best == k]
                small = max(abs(int(mine.max())), abs(int(mine.min()))) < EXACT_BELOW
                sums[k] += (mine if small else mine.astype(object)).sum(axis=0).astype(object)
                counts[k] += len(mine)
        there = [k for k in range(len(c)) if counts[k]]
        rows = [(k, j, Decimal(int(sums[k, j])), int(counts[k])) for k in there for j in range(c.shape[1])]
        types = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = [pa.array(col, t) for col, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["k", "j", "s", "n"])

    made = trees.mapInArrow(run, "k int, j int, s decimal(38,0), n long").groupBy("k", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in made.collect():
        out[r["k"], r["j"]] = int(r["s"]) // r["n"]
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        of_centroids = cover_tree(c.astype(float), 1) if len(c) else None
        for ids, x, tree in _each_tree(batches):
            best, least = nearest(x, tree, c, of_centroids)
            distance = pa.array([min(LARGEST, int(d)) for d in least], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), distance], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, size: int = VECTORS_A_TREE, leaf: int = VECTORS_A_LEAF) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of all vectors of ``width`` components.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Components are multiplied by 64
    and rounded down; such beyond 64 bits count as the nearest 64-bit number, and so do distances and their sums. The first
    centroids are the vectors whose SHA-256 of ``1:<vec_id>`` sorts first (a null id as no text; of one id, the lesser vector
    first); with fewer vectors there are fewer centroids. Equally near centroids: the smaller number. Repeated rows
    count as often as they occur. An empty table gives an empty result; other columns are ignored.

    A task holds one tree of ``size`` vectors at a time, whatever their number and however many are equal.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == width))
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(named, "v").limit(clusters).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    trees = settle(_trees(rows, size, leaf), "cover-trees")
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(trees, centroids)
    assigned = settle(_assigned(trees, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(LARGEST, sum(sums.values()))
    told = [(k, min(LARGEST, s), whole, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    # a row a cluster
    figures = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
