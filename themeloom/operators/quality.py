"""Quality of a given clustering ``<..., w array<double>, cluster int>``.

Rows are only ever reduced by cluster with map-side combine, so a cluster that holds most rows is no hot
task. Cluster-level tables are broadcast after their size is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.operators.clusters import MAX_CENTERS, _matrix, _square_distances, cluster_means
from themeloom.operators.ranking import bounded
from themeloom.session import stage


def _distance(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))


def silhouette_squared(labelled: DataFrame, value: str = "w") -> float:
    """Mean silhouette over squared distances; linear in the rows."""
    ready = labelled.select(array_to_vector(value).alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(ready)


def silhouette_candidates(labelled: DataFrame, value: str = "w") -> DataFrame:
    """``<id, x, cluster, wanted>``: the clusters whose mean distance to a row its silhouette can depend on.

    The mean distance to a cluster is at least the distance to its mean, and at most the root of that distance squared plus the cluster's
    mean squared spread. ``wanted`` has the row's own cluster and the others whose lower bound does not exceed the least upper one; the
    rest can't be the nearest. The clusters' means are broadcast, so at most ``MAX_CENTERS`` clusters are allowed.
    """
    rows = bounded(_moments(labelled, value), MAX_CENTERS, "clusters").collect()
    rows.sort(key=lambda r: r.cluster)
    names = np.array([r.cluster for r in rows])
    means = np.array([r["mean"].toArray() for r in rows])
    spread = np.array([max(r.within, 0.0) / r.n for r in rows])

    @F.arrow_udf("array<int>")
    def wanted(vectors: pa.Array, owners: pa.Array) -> pa.Array:
        found = []
        own = np.searchsorted(names, np.asarray(owners))
        x = _matrix(vectors) if len(vectors) else np.zeros((0, 1))
        for lo in range(0, len(x), 1024):
            part, mine = x[lo : lo + 1024], own[lo : lo + 1024]
            square = _square_distances(part, means)
            most = np.sqrt(square + spread)
            place = np.arange(len(part))
            most[place, mine] = np.inf
            # A sliver more than the bound, for rounding.
            keep = np.sqrt(square) <= most.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12
            keep[place, mine] = True
            found.append(keep)
        keep = np.concatenate(found) if found else np.zeros((0, len(names)), bool)
        ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[np.nonzero(keep)[1]].astype(np.int32)))

    x = F.col(value).cast("array<double>").alias("x")
    rows = labelled.select(x, F.col("cluster").cast("int").alias("cluster"))
    return rows.select(F.monotonically_increasing_id().alias("id"), "x", "cluster", wanted("x", "cluster").alias("wanted"))


def silhouette_exact(labelled: DataFrame, value: str = "w", block: int = 4096) -> DataFrame:
    """One row ``<silhouette>``: mean silhouette over plain Euclidean distances; singletons score 0, fewer than two clusters give null.

    Each row meets the members of its own cluster, and of those others that can be its nearest (:func:`silhouette_candidates`). Members and
    the rows that ask for them are dealt in blocks, so that a task holds two bounded blocks of one cluster whatever its size, and
    sends back one sum per row. The work is that of all distances inside the clusters, plus what the bounds leave over.
    """
    rows = stage(silhouette_candidates(labelled, value), "silhouette")
    asked = rows.select("id", "x", "cluster", F.explode(F.col("wanted")).alias("c"))
    sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}
    asking = {r.c: r["count"] for r in asked.groupBy("c").count().collect()}
    if len(sizes) < 2:
        return labelled.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))

    def blocks(counts: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, -(-n // block))])

    def every(counts: dict[int, int], cluster: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(counts)[F.col(cluster)] - 1))

    def home(counts: dict[int, int], cluster: str) -> Column:
        return F.pmod(F.xxhash64("id"), blocks(counts)[F.col(cluster)]).cast("int")

    left = asked.select("c", home(asking, "c").alias("a"), every(sizes, "c").alias("b"), "id", "x", (F.col("c") == F.col("cluster")).alias("mine"))
    members = rows.select(F.col("cluster").alias("mc"), every(asking, "cluster").alias("ma"), home(sizes, "cluster").alias("mb"), "id", "x")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.schema([("id", pa.int64()), ("c", pa.int32()), ("mine", pa.bool_()), ("far", pa.float64())]).empty_table()
        (x, y), (ids, own) = ([f(t) for t in (left, right)] for f in (lambda t: _matrix(t.column(4).combine_chunks()), lambda t: np.asarray(t.column(3))))
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        square, total = (y * y).sum(1), np.empty(len(x))
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            gap = np.sqrt(np.maximum((part * part).sum(1)[:, None] + square - 2.0 * (part @ y.T), 0.0))
            gap[ids[lo : lo + 512, None] == own] = 0.0
            total[lo : lo + 512] = gap.sum(axis=1)
        return pa.table({"id": ids, "c": left.column(0), "mine": left.column(5), "far": total})

    parts = left.groupBy("c", "a", "b").cogroup(members.groupBy("mc", "ma", "mb")).applyInArrow(sums, "id bigint, c int, mine boolean, far double")
    n = F.create_map(*[F.lit(v) for c, k in sizes.items() for v in (c, float(k))])
    means, mine = parts.groupBy("id", "c", "mine").agg(F.sum("far").alias("far")), F.col("mine")
    both = means.groupBy("id").agg(
        F.max(F.when(mine, n[F.col("c")])).alias("n"),
        F.max(F.when(mine, F.col("far") / F.greatest(n[F.col("c")] - 1, F.lit(1.0)))).alias("a"),
        F.min(F.when(~mine, F.col("far") / n[F.col("c")])).alias("b"),
    )
    top = F.greatest("a", "b")
    score = F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return both.agg(F.avg(score).alias("silhouette"))


def _moments(labelled: DataFrame, value: str) -> DataFrame:
    """``<cluster, n, mean, within>``; the spread comes from per-dimension variances of a single pass."""
    both = Summarizer.metrics("mean", "variance").summary(array_to_vector(value))
    got = labelled.groupBy("cluster").agg(F.count("*").alias("n"), both.alias("s"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
    return got.select("cluster", "n", F.col("s.mean").alias("mean"), ((F.col("n") - 1) * spread).alias("within"))


def calinski_harabasz(labelled: DataFrame, value: str = "w") -> DataFrame:
    """One row: between-cluster over within-cluster variance. One shuffle of one row per task and cluster."""
    clusters = _moments(labelled, value)
    whole = clusters.agg(vector_to_array(Summarizer.mean(F.col("mean"), F.col("n").cast("double")))).scalar()
    spread = F.aggregate(
        F.zip_with("center", "whole", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v
    )
    placed = clusters.withColumns({"center": vector_to_array("mean"), "whole": whole})
    sums = placed.agg(
        F.sum(F.col("n") * spread).alias("between"),
        F.sum("within").alias("within"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
    )
    ratio = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select(F.when(F.col("within") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz_score"))


def center_distances(labelled: DataFrame, value: str = "w") -> DataFrame:
    """``<cluster, n, mean, spread>``: spread is the mean distance of a cluster's rows to their mean.

    The means are counted first and then broadcast, so the rows do not move and a large cluster is no hot key. More
    than ``MAX_CENTERS`` clusters are an error, as everywhere in this module.
    """
    means = F.broadcast(bounded(cluster_means(labelled, value), MAX_CENTERS, "clusters"))
    near = labelled.select("cluster", F.col(value).alias("_x")).join(means, "cluster")
    return near.groupBy("cluster").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg(_distance("_x", "mean")).alias("spread")
    )


def davies_bouldin(centers: DataFrame) -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / distance between means.

    ``centers`` is :func:`center_distances`. Each cluster meets the others through one array of at most
    ``MAX_CENTERS`` clusters, so there is no join of clusters with clusters.
    """
    clusters = bounded(centers.select("cluster", "spread", "mean"), MAX_CENTERS, "clusters")
    everyone = clusters.agg(F.collect_list(F.struct("cluster", "spread", "mean"))).scalar()
    own = F.col("cluster")
    worst = F.array_max(
        F.transform(
            F.filter("everyone", lambda o: o["cluster"] != own),
            lambda o: F.try_divide(F.col("spread") + o["spread"], _distance(F.col("mean"), o["mean"])),
        )
    )
    rated = clusters.withColumn("everyone", everyone).select(worst.alias("r"))
    return rated.agg(F.avg("r").alias("davies_bouldin_score"))


def cluster_density(centers: DataFrame) -> DataFrame:
    """One row: mean over non-empty clusters of the mean distance to the cluster mean."""
    return centers.agg(F.avg("spread").alias("cluster_density"))


def cluster_volumes(labelled: DataFrame) -> DataFrame:
    """``<cluster, volume>``: rows per non-empty cluster."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("volume"))


def cluster_sizes(labelled: DataFrame, k: int) -> DataFrame:
    """One row: sizes of clusters ``0..k-1`` as an array, 0 for an empty one."""
    if k > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} clusters")
    found = F.map_from_entries(F.collect_list(F.struct("cluster", "volume")))
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at("found", c), F.lit(0))
    )
    return (
        cluster_volumes(labelled.where(F.col("cluster").between(0, k - 1)))
        .agg(found.alias("found"))
        .select(sizes.alias("cluster_sizes"))
    )


def largest_cluster(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """The most frequent label with its volume; the smallest label wins ties."""
    return (
        labelled.groupBy(label).agg(F.count("*").alias("volume")).orderBy(F.desc("volume"), label).limit(1)
    )


def quality_record(labelled: DataFrame, k: int, value: str = "w") -> DataFrame:
    """One row with the five quality fields that accompany a volume, for ``k <= MAX_CENTERS`` clusters."""
    centers = bounded(center_distances(labelled, value), MAX_CENTERS, "clusters")
    return labelled.sparkSession.range(1).select(
        F.lit(silhouette_squared(labelled, value)).alias("silhouette_score"),
        calinski_harabasz(labelled, value).scalar().alias("calinski_harabasz_score"),
        davies_bouldin(centers).scalar().alias("davies_bouldin_score"),
        cluster_sizes(labelled, k).scalar().alias("cluster_sizes"),
        cluster_density(centers).scalar().alias("cluster_density"),
    )
