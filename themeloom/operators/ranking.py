"""Ranking helpers shared by the theme tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# Scores are ranked after rounding: the order of floating sums must not decide between equal scores.
RANK_DIGITS = 10


def by_score(score: str) -> Column:
    return F.desc(F.round(score, RANK_DIGITS))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """Add ``rank`` and keep the first ``n`` rows of each group under a full order.

    Spark cuts every partition to ``n`` rows per group before the shuffle, so a hot group sends at most
    ``n`` rows per task.
    """
    if not keys:
        first = df.orderBy(*order).limit(n)
        return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order: Sequence[Column | str], n: int, groups: int = 64) -> DataFrame:
    """The first ``n`` rows under a full order, in two levels.

    A plain ``orderBy().limit()`` sends ``n`` rows of every partition to one task. Here groups of partitions
    are cut to ``n`` rows first, so the last task sees at most ``groups * n`` rows. Spark cuts below the shuffle only up to a
    thousand rows per group; for more, narrow a large table by :func:`at_least_top` first.
    """
    grouped = df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    first = top_n_per_group(grouped, ["_group"], order, n, "_place")
    return first.select(*df.columns).orderBy(*order).limit(n)


def at_least_top(df: DataFrame, score: str, n: int, levels: int = 16) -> DataFrame:
    """The rows that can be among the ``n`` with the highest positive ``score``, and few others.

    Scores are counted in levels of a logarithmic scale, so what reaches the driver is some hundred counts; the rows
    of the level that the n-th row is on, and of all above it, pass a narrow filter.
    """
    level = F.floor(F.log2(score) * levels)
    counts = df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    left, least = n, None
    for row in sorted(counts, key=lambda r: -r.level):
        least, left = row.level, left - row.n
        if left <= 0:
            break
    return df if least is None else df.where(level >= least)


def bounded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """A copy of a small table held by the plan itself; an error when it has more than ``limit`` rows.

    Joins and subqueries against the copy need no shuffle, and its size is known before they are planned.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def dedup_keep_max(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """One row per key with its highest score."""
    return df.groupBy(*keys).agg(F.max(score).alias(score))
