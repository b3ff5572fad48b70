"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.session import drop_staged, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``<v, component>`` for every end of ``edges`` ``<a, b>`` (bigint); component is the smallest ``v`` of its group.

    Each round gives every vertex the best of itself and its neighbours, and replaces the ends of all edges by
    these. The first round prefers small ids, which folds stars at once; the others prefer small salted hashes, so
    that a chain of any order shrinks by a constant share. A vertex's choice is an aggregate with map-side combine
    and a join, both of which Spark can split where a vertex is hot. Every round is staged, nothing is
    collected. Loops and repeated edges are allowed; null ends are ignored.
    """
    edges = stage(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").distinct(), "edges")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("now", F.col("v"))
    left = not edges.isEmpty()
    for n in range(max_rounds):
        if not left:
            break
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        ends = both.select(F.col("e.a").alias("v"), F.col("e.b").alias("w"))
        best = ends.groupBy("v").agg(F.min(_ranked("w", n)).alias("best"))
        moves = best.select("v", F.least("best", _ranked("v", n)).getField("id").alias("to"))
        moves = stage(moves.where("v <> to"), "moves")
        before = edges, vertices, moves
        vertices = stage(
            vertices.join(moves.withColumnRenamed("v", "now"), "now", "left").select("v", F.coalesce("to", "now").alias("now")),
            "vertices",
        )
        edges = stage(_moved(_moved(edges, moves, "a"), moves, "b").where("a <> b").distinct(), "edges")
        drop_staged(*before)
        left = not edges.isEmpty()
    if left:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = vertices.groupBy("now").agg(F.min("v").alias("component"))
    components = stage(vertices.join(least, "now").select("v", "component"), "components")
    drop_staged(edges, vertices)
    return components


def _ranked(vertex: str, n: int) -> Column:
    """What round ``n`` prefers the smaller of."""
    rank = F.xxhash64(F.lit(n), vertex) if n else F.lit(0).cast("bigint")
    return F.struct(rank.alias("rank"), F.col(vertex).alias("id"))


def _moved(edges: DataFrame, moves: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    joined = edges.join(moves.withColumnRenamed("v", end), end, "left")
    return joined.select(F.coalesce("to", end).alias(end), other).select("a", "b")
