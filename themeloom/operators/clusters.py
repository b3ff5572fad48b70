"""Grouping of points ``<..., w array<double>>`` into clusters.

What the driver holds is centroids and merge trees: at most ``MAX_CENTERS`` of them. Points stay in
their partitions; labels are added by narrow passes, so they need no join back.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.operators.ranking import top_rows
from themeloom.session import drop_staged, stage

MAX_CENTERS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long arrays as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _square_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences, so that equal points are at distance zero."""
    out = np.empty((len(x), len(centers)))
    for c, center in enumerate(centers):
        gap = x - center
        out[:, c] = np.einsum("ij,ij->i", gap, gap)
    return out


def sample_rows(points: DataFrame, k: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``k`` distinct rows in the order of md5("key:seed"): the same rows for any partitioning."""
    return top_rows(points, [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key], k)


def _vectors_of(rows: DataFrame, value: str, limit: int = MAX_CENTERS) -> np.ndarray:
    got = rows.select(value).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} centers")
    return np.array([r[0] for r in got], dtype=np.float64)


def nearest_center(centers: np.ndarray, value: str = "w") -> Column:
    """``struct<cluster, distance>`` of the nearest center by Euclidean distance, ties to the lowest."""
    if len(centers) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers")

    @F.arrow_udf("struct<cluster:int,distance:double>")
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            best, gap = np.zeros(0, np.int32), np.zeros(0)
        else:
            squares = _square_distances(_matrix(column), centers)
            best = squares.argmin(axis=1).astype(np.int32)
            gap = np.sqrt(squares[np.arange(len(best)), best])
        return pa.StructArray.from_arrays([pa.array(best), pa.array(gap)], ["cluster", "distance"])

    return nearest(F.col(value))


def assign_nearest(points: DataFrame, centers: np.ndarray, value: str = "w") -> DataFrame:
    """Add ``cluster`` and ``distance``; narrow."""
    found = points.withColumn("_near", nearest_center(centers, value))
    return found.select(*points.columns, "_near.cluster", "_near.distance")


def cluster_means(labelled: DataFrame, value: str = "w") -> DataFrame:
    """``<cluster, n, mean>``; partial means are combined map-side, so a hot cluster is no hot task."""
    return labelled.groupBy("cluster").agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector(value))).alias("mean")
    )


def update_centroids(labelled: DataFrame, old: DataFrame, value: str = "w") -> DataFrame:
    """``<cluster, mean>`` for every row of ``old <cluster, mean>``; an empty cluster keeps its old mean."""
    new = cluster_means(labelled, value).select("cluster", F.col("mean").alias("_new"))
    return old.join(new, "cluster", "left").select("cluster", F.coalesce("_new", "mean").alias("mean"))


def _with_bounds(rows: DataFrame, centers: np.ndarray, value: str) -> DataFrame:
    """``<value, near, upper, lower>``: the nearest center, its distance, and the distance of the second nearest."""

    @F.arrow_udf("struct<near:int,upper:double,lower:double>")
    def bounds(column: pa.Array) -> pa.Array:
        squares = _square_distances(_matrix(column), centers) if len(column) else np.zeros((0, len(centers)))
        near, place = squares.argmin(axis=1) if len(squares) else np.zeros(0, np.int64), np.arange(len(squares))
        upper = np.sqrt(squares[place, near])
        squares[place, near] = np.inf
        lower = np.sqrt(squares.min(axis=1)) if len(squares) else upper
        return pa.StructArray.from_arrays([pa.array(near.astype(np.int32)), pa.array(upper), pa.array(lower)], ["near", "upper", "lower"])

    return stage(rows.withColumn("_b", bounds(value)).select(value, "_b.*"), "bounds")


def _lloyd_round(rows: DataFrame, centers: np.ndarray, value: str, drift: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """Means of the rows nearest to each center, how many rows there are, and for how many no distance was computed.

    A center without rows stays where it is. A task sends one row per center it met, with the count and the sum of its rows. With ``drift``, how
    far each center has moved since ``rows`` got their bounds, a row keeps its center if that can't be farther than any other can be near.
    """
    most = None if drift is None else np.where(np.arange(len(centers)) == np.argmax(drift), np.partition(drift, -2)[-2] if len(drift) > 1 else 0.0, drift.max())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, skipped = np.zeros(centers.shape), np.zeros(len(centers), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            if drift is None:
                near = _square_distances(x, centers).argmin(axis=1)
            else:
                near, upper, lower = (np.array(batch.column(k)) for k in (1, 2, 3))
                # A sliver less than the bounds allow, for rounding.
                open_ = np.flatnonzero((upper + drift[near]) * (1 + 1e-9) + 1e-12 >= lower - most[near])
                near[open_] = _square_distances(x[open_], centers).argmin(axis=1)
                skipped += len(x) - len(open_)
            counts += np.bincount(near, minlength=len(centers))
            order = np.argsort(near, kind="stable")
            met, first = np.unique(near[order], return_index=True)
            sums[met] += np.add.reduceat(x[order], first, axis=0)
        met = np.flatnonzero(counts)
        if len(met):
            offsets = pa.array(np.arange(len(met) + 1) * sums.shape[1], pa.int32())
            packed = pa.ListArray.from_arrays(offsets, pa.array(sums[met].ravel()))
            columns = [pa.array(met, pa.int32()), pa.array(counts[met]), packed, pa.array([skipped] + [0] * (len(met) - 1))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums", "skipped"])

    total = (
        rows.mapInArrow(partial, "cluster int, n bigint, sums array<double>, skipped bigint")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"), F.sum("skipped").alias("skipped"))
    )
    moved, n, skipped = centers.copy(), 0, 0
    for row in total.collect():
        moved[row.cluster] = row.sums.toArray() / row.n
        n, skipped = n + row.n, skipped + row.skipped
    return moved, n, skipped


def kmeans_lloyd(
    points: DataFrame,
    start: np.ndarray,
    max_iter: int = 100,
    tol: float = 1e-4,
    value: str = "w",
    bounded_from: int = 3,
    trace: list[tuple[int, int]] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd rounds from given start rows; returns ``(centers of the last labels, updated centers)``.

    A round is one pass that assigns and averages. It stops when the norm of the whole change of the
    centroids is below ``tol``; labels are those of the last assignment.

    After ``bounded_from`` rounds the rows are staged with their nearest center and the distances of the two nearest. Later rounds widen
    these bounds by the way the centers have gone since, and compute no distance for rows that they decide; labels are those of plain
    rounds. Bounds that decide less than half of the rows are staged anew, five rounds later at the earliest. ``trace`` gets
    ``(rows, rows without distances)`` of every round.
    """
    centers = np.array(start, dtype=np.float64)
    previous, used = None, centers
    rows = points.select(value)
    known, origin, staged = None, centers, 0
    for n in range(max_iter):
        if n >= bounded_from and (known is None or share < 0.5 and n - staged >= 5):
            if known is not None:
                drop_staged(known)
            known, origin, staged = _with_bounds(rows, centers, value), centers, n
        drift = None if known is None else np.linalg.norm(centers - origin, axis=1)
        used, (moved, count, skipped) = centers, _lloyd_round(rows if known is None else known, centers, value, drift)
        share = skipped / max(1, count)
        if trace is not None:
            trace.append((count, skipped))
        if previous is not None and np.linalg.norm(moved - previous) < tol:
            break
        centers = previous = moved
    if known is not None:
        drop_staged(known)
    return used, centers


def kmeans_labels(
    points: DataFrame, k: int, seed: int = 42, max_iter: int = 100, tol: float = 1e-4, value: str = "w"
) -> DataFrame:
    """k-means from ``k`` random distinct rows; adds ``cluster`` and ``distance``.

    The start rows are drawn by a seeded hash of ``doc_id``, so runs repeat on any cluster.
    """
    start = _vectors_of(sample_rows(points, k, seed), value)
    used, _ = kmeans_lloyd(points, start, max_iter, tol, value)
    return assign_nearest(points, used, value)


def bisecting_labels(points: DataFrame, k: int, seed: int = 42, max_iter: int = 20, value: str = "w") -> DataFrame:
    """Top-down hierarchical clusters from MLlib; adds ``cluster``."""
    ready = points.withColumn("features", array_to_vector(value))
    model = BisectingKMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(
        ready.select("features")
    )
    return model.transform(ready).drop("features")


# --- clustering features ----------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureTree:
    """Micro-clusters as the leaves of a tree; an inner node sends a point left if its coordinate on ``axis`` is at most ``cut``.

    ``left`` and ``right`` are node numbers, -1 at a leaf. ``leaf`` has a leaf's number, in the order of the nodes. ``centers`` and
    ``weights`` are means and counts of the leaves' points.
    """

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    centers: np.ndarray
    weights: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        return self.leaf[_descend(x, self.axis, self.cut, self.left, self.right)]

    def column(self, value: str = "w") -> Column:
        """The leaf of the point in a column; narrow."""

        @F.arrow_udf("int")
        def micro(column: pa.Array) -> pa.Array:
            found = self.place(_matrix(column)) if len(column) else np.zeros(0)
            return pa.array(found.astype(np.int32))

        return micro(F.col(value))


def _descend(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    node, moving = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(moving):
        at = node[moving]
        inner = left[at] >= 0
        moving, at = moving[inner], at[inner]
        node[moving] = np.where(x[moving, axis[at]] <= cut[at], left[at], right[at])
    return node


def _features(points: DataFrame, value: str, place: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, middle: np.ndarray) -> dict:
    """Count, sum and squares (both less ``middle``), least and greatest coordinates of the points of each wanted node.

    These features of two parts of a node add up to those of the whole, so a task sends one row per node and Spark combines them.
    """
    number = np.full(int(wanted.max()) + 1, -1)
    number[wanted] = np.arange(len(wanted))
    width = len(middle)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(wanted), np.int64)
        sums, low = np.zeros((len(wanted), 2 * width)), np.full((len(wanted), 2 * width), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            node = place(x)
            own = np.where(node < len(number), number[np.minimum(node, len(number) - 1)], -1)
            x, own = x[own >= 0], own[own >= 0]
            by = np.argsort(own, kind="stable")
            met, first = np.unique(own[by], return_index=True)
            if len(met):
                gap = x[by] - middle
                count[met] += np.bincount(own, minlength=len(wanted))[met]
                sums[met] += np.add.reduceat(np.concatenate([gap, gap * gap], axis=1), first, axis=0)
                low[met] = np.minimum(low[met], np.minimum.reduceat(np.concatenate([x[by], -x[by]], axis=1), first, axis=0))
        met = np.flatnonzero(count)
        if len(met):
            ends = pa.array(np.arange(len(met) + 1) * 2 * width, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(m[met].ravel())) for m in (sums, low)]
            yield pa.RecordBatch.from_arrays([pa.array(wanted[met]), pa.array(count[met]), *lists], ["node", "n", "sums", "low"])

    total = (
        points.select(value)
        .mapInArrow(partial, "node bigint, n bigint, sums array<double>, low array<double>")
        .groupBy("node")
        .agg(
            F.sum("n").alias("n"),
            Summarizer.sum(array_to_vector("sums")).alias("sums"),
            Summarizer.min(array_to_vector("low")).alias("low"),
        )
    )
    return {r.node: (r.n, r.sums.toArray(), r.low.toArray()) for r in total.collect()}


def feature_tree(points: DataFrame, micro: int = 512, value: str = "w") -> FeatureTree:
    """At most ``micro`` micro-clusters, by splitting nodes of clustering features from the top.

    A node splits at the mean of its coordinate of the largest variance. Nodes whose squared error is above the ``micro``-th part of the
    whole split at once, the others as long as leaves are left over; a node of equal points never does, so a corpus of ``micro`` or
    fewer distinct points has one leaf for each. A round is one pass that only sends features of the nodes that are new. The tree is a function
    of the points alone (but for rounding of sums), however they are dealt to tasks.
    """
    if not 0 < micro <= MAX_CENTERS:
        raise ValueError(f"between 1 and {MAX_CENTERS} micro-clusters")
    if points.isEmpty():
        raise ValueError("no points")
    middle = points.select(Summarizer.mean(array_to_vector(value)).alias("m")).first().m.toArray()
    axis, cut, left, right = ([v] for v in (0, 0.0, -1, -1))
    known: dict[int, tuple] = {}
    fresh = [0]
    while fresh:
        arrays = (np.array(axis), np.array(cut), np.array(left), np.array(right))
        known |= _features(points, value, lambda x, a=arrays: _descend(x, *a), np.array(fresh), middle)
        leaves = [n for n in range(len(left)) if left[n] < 0]
        spread = {n: _spread(*known[n]) for n in leaves}
        error = {n: float(s.sum()) for n, s in spread.items()}
        room, bar = micro - len(leaves), sum(error.values()) / micro
        divisible = sorted((n for n in leaves if _is_spread(known[n])), key=lambda n: (-error[n], n))
        least = max(sum(error[n] > bar for n in divisible), -(-room // 8))
        fresh = []
        for node in divisible[: min(room, least)]:
            n, sums, low = known.pop(node)
            width = len(middle)
            low, high = low[:width], -low[width:]
            # Rounding can leave a coordinate without spread in the sums but not in the box.
            by = int(np.argmax(np.where(high > low, np.maximum(spread[node], 0.0), -1.0)))
            mean = sums[by] / n + middle[by]
            axis[node], cut[node] = by, mean if low[by] <= mean < high[by] else low[by]
            left[node], right[node] = len(left), len(left) + 1
            fresh += [len(left), len(left) + 1]
            for column, empty in ((axis, 0), (cut, 0.0), (left, -1), (right, -1)):
                column += [empty, empty]
    leaves = np.flatnonzero(np.array(left) < 0)
    leaf = np.full(len(left), -1)
    leaf[leaves] = np.arange(len(leaves))
    weights = np.array([known[n][0] for n in leaves])
    centers = np.array([known[n][1][: len(middle)] / known[n][0] + middle for n in leaves])
    for k, n in enumerate(leaves):
        if not _is_spread(known[n]):
            centers[k] = known[n][2][: len(middle)]  # equal points are their center to the last bit
    return FeatureTree(np.array(axis), np.array(cut), np.array(left), np.array(right), leaf, centers, weights)


def _spread(n: int, sums: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Squared error of each coordinate."""
    width = len(sums) // 2
    return np.maximum(sums[width:] - sums[:width] ** 2 / n, 0.0)


def _is_spread(features: tuple) -> bool:
    low = features[2]
    return bool((low[: len(low) // 2] < -low[len(low) // 2 :]).any())


# --- bottom-up hierarchy ----------------------------------------------------------------------------


def ward_merges(centers: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Merges ``(kept, absorbed)`` of weighted centers by least growth of the squared error, along chains of nearest neighbours.

    A chain goes from a cluster to its nearest one until two are nearest to each other; these merge, as no later merge can bring
    another one nearer. Each step costs one row of distances, so all merges cost the square of the centers. Sorted by their growth they
    are the merges of the greedy order; of equal growth, the pair with the smaller numbers comes first where the order is free.
    """
    c, n = np.array(centers, dtype=np.float64), np.array(weights, dtype=np.float64)
    m = len(c)
    alive, growth = np.ones(m, bool), np.zeros(m)
    chain: list[int] = []
    found: list[tuple[float, int, int]] = []
    while len(found) < m - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        top = chain[-1]
        others = np.flatnonzero(alive)
        others = others[others != top]
        gap = c[others] - c[top]
        cost = np.einsum("ij,ij->i", gap, gap) * (n[others] * n[top] / (n[others] + n[top]))
        least = cost.min()
        if len(chain) > 1 and cost[np.searchsorted(others, chain[-2])] <= least:
            a, b = sorted((chain.pop(), chain.pop()))
            # Rounding must not put a merge before those below it.
            growth[a] = max(float(least), growth[a], growth[b])
            found.append((growth[a], a, b))
            c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
            n[a] += n[b]
            alive[b] = False
        else:
            chain.append(int(others[np.argmin(cost)]))
    return _greedy_order(found, m)


def _greedy_order(found: list[tuple[float, int, int]], m: int) -> list[tuple[int, int]]:
    """Merges by growth, each after those of its parts."""
    waits: list[list[int]] = [[] for _ in found]
    last: dict[int, int] = {}
    missing = []
    for k, (_, a, b) in enumerate(found):
        parts = [last[x] for x in (a, b) if x in last]
        for part in parts:
            waits[part].append(k)
        missing.append(len(parts))
        last[a] = k
    ready = [(found[k], k) for k in range(len(found)) if not missing[k]]
    heapq.heapify(ready)
    out = []
    while ready:
        (_, a, b), k = heapq.heappop(ready)
        out.append((a, b))
        for later in waits[k]:
            missing[later] -= 1
            if not missing[later]:
                heapq.heappush(ready, (found[later], later))
    return out


@dataclass(frozen=True)
class Hierarchy:
    """Micro-clusters and the merges above them; every cut of the tree is a clustering."""

    tree: FeatureTree
    merges: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return len(self.tree.centers)

    @property
    def weights(self) -> np.ndarray:
        return self.tree.weights

    def cut(self, k: int) -> np.ndarray:
        """Cluster of each micro-cluster; clusters are numbered by their first micro-cluster.

        More clusters than the tree has leaves are an error, unless the points themselves are no more: give the fit more micro-clusters.
        """
        if k > self.size and self.weights.sum() > self.size:
            raise ValueError(f"{k} clusters from {self.size} micro-clusters")
        owner = np.arange(self.size)
        for a, b in self.merges[: max(0, self.size - k)]:
            owner[owner == b] = a
        return np.unique(owner, return_inverse=True)[1].astype(int)

    def labels(self, points: DataFrame, k: int, value: str = "w") -> DataFrame:
        """Add ``cluster`` for the cut at ``k``; narrow."""
        cut = F.array(*[F.lit(int(c)) for c in self.cut(k)])
        return points.withColumn("cluster", F.get(cut, self.tree.column(value)))


def fit_hierarchy(points: DataFrame, micro: int = 512, value: str = "w") -> Hierarchy:
    """Bottom-up Ward hierarchy over at most ``micro`` micro-clusters.

    Merging points pairwise is quadratic, so they are first reduced to the leaves of a :func:`feature_tree`. The path is the same for
    every size: with ``micro`` or fewer distinct points each is its own leaf.
    """
    tree = feature_tree(points, micro, value)
    return Hierarchy(tree, tuple(ward_merges(tree.centers, tree.weights)))


def micro_for(k: int) -> int:
    """Enough micro-clusters for cuts of up to ``k`` clusters."""
    return min(MAX_CENTERS, max(512, 2 * k))


def hierarchical_labels(points: DataFrame, k: int, micro: int | None = None, value: str = "w") -> DataFrame:
    """Add ``cluster`` for the cut at ``k``. Without ``micro`` there are at least twice as many micro-clusters as clusters."""
    return fit_hierarchy(points, micro or micro_for(k), value).labels(points, k, value)


def score_cuts(points: DataFrame, tree: Hierarchy, max_k: int, value: str = "w") -> DataFrame:
    """``<k, score>``: mean squared-distance silhouette of every cut from 2 to ``max_k`` clusters.

    The summed squared distance from a point to a cluster follows from the cluster's count, sum and sum
    of squares, and is additive under merges. One pass over the points therefore scores all cuts; each
    task sends one row per k.
    """
    top = min(max_k, tree.size)
    if top < 2:
        raise ValueError("fewer than two distinct points")
    sums = (
        points.select(value, tree.tree.column(value).alias("cluster"))
        .withColumn("_q", F.aggregate(value, F.lit(0.0), lambda a, v: a + v * v))
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), Summarizer.sum(array_to_vector(value)).alias("y"), F.sum("_q").alias("q"))
        .collect()
    )
    m, d = tree.tree.centers.shape
    count, total, square = np.zeros(m), np.zeros((m, d)), np.zeros(m)
    for r in sums:
        count[r.cluster], total[r.cluster], square[r.cluster] = r.n, r.y.toArray(), r.q
    leaves, merges = tree.tree, tree.merges

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, rows = np.zeros(top + 1), 0
        for batch in batches:
            whole = _matrix(batch.column(0))
            for lo in range(0, len(whole), 2048):
                x = whole[lo : lo + 2048]
                rows += len(x)
                owner = leaves.place(x)
                n = count.copy()
                far = (x * x).sum(1)[:, None] * n + square - 2.0 * (x @ total.T)
                live = n > 0
                k = int(live.sum())
                step = 0
                while k >= 2:
                    if k <= top:
                        score[k] += _silhouette_sum(far[:, live], n[live], (np.cumsum(live) - 1)[owner])
                    a, b = merges[step]
                    step += 1
                    owner[owner == b] = a
                    far[:, a] += far[:, b]
                    n[a] += n[b]
                    n[b] = 0
                    if live[b]:
                        k -= 1
                    live[a] |= live[b]
                    live[b] = False
        if rows:
            ks = np.arange(2, top + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int32()), pa.array(score[2:]), pa.array(np.full(len(ks), rows), pa.int64())],
                ["k", "s", "n"],
            )

    return (
        points.select(value)
        .mapInArrow(partial, "k int, s double, n bigint")
        .groupBy("k")
        .agg((F.sum("s") / F.sum("n")).alias("score"))
    )


def _silhouette_sum(far: np.ndarray, n: np.ndarray, own: np.ndarray) -> float:
    rows = np.arange(len(far))
    size = n[own]
    a = np.maximum(far[rows, own], 0.0) / np.maximum(size - 1, 1)
    other = np.maximum(far, 0.0) / n
    other[rows, own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
    return float(s.sum())


def select_k(scores: DataFrame) -> DataFrame:
    """The row ``<k, score>`` with the highest score; the smallest k wins ties."""
    return scores.orderBy(F.desc("score"), "k").limit(1)
