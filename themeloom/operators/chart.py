"""Chart-ready columns over theme tables ``<grp, rank, word, score>`` and volume tables ``<grp, volume>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.operators.themes import GLOBAL


def chart_words(themes: DataFrame, n_global: int = 100, n_peripheral: int = 50) -> DataFrame:
    """The words a chart shows: more for the global group than for the others."""
    return themes.where(F.col("rank") <= F.when(F.col("grp") == GLOBAL, n_global).otherwise(n_peripheral))


def numeric_volumes(volumes: DataFrame) -> DataFrame:
    """Rows whose volume (any type) is a number."""
    number = F.col("volume").try_cast("double")
    return volumes.where(number.isNotNull() & ~F.isnan(number))


def relative_volume(volumes: DataFrame, volume_scale: float = 1.2) -> DataFrame:
    """Add ``relative``: volume over ``volume_scale`` times the largest peripheral volume."""
    largest = volumes.where(F.col("grp") != GLOBAL).agg(F.max("volume")).scalar()
    return volumes.withColumn("relative", F.col("volume") / (largest * volume_scale))


def score_scale(score: Column, is_global: Column, global_range=(12.0, 48.0), peripheral_range=(8.0, 24.0)) -> Column:
    """Square-root scale from a score in 0..1 to a size range, one range per kind of group."""

    def scaled(low: float, high: float) -> Column:
        return F.lit(low) + F.lit(high - low) * F.sqrt(score)

    return F.when(is_global, scaled(*global_range)).otherwise(scaled(*peripheral_range))


def theme_share(themes: DataFrame, floor: float = 0.01) -> DataFrame:
    """Add ``share`` of each word in its group; scores are floored at ``floor`` of the group's maximum.

    Theme tables hold a few dozen ranked words per group, which bounds the join with the group totals.
    """
    top = themes.groupBy("grp").agg(F.max("score").alias("_top"))
    weighed = themes.join(top, "grp").withColumn("_w", F.greatest("score", F.col("_top") * floor))
    total = weighed.groupBy("grp").agg(F.sum("_w").alias("_total"))
    return weighed.join(total, "grp").select(*themes.columns, (F.col("_w") / F.col("_total")).alias("share"))


def log_frequency(summary: DataFrame, factor: float = 10.0) -> DataFrame:
    return summary.withColumn("size", F.log("frequency") * factor)


def validate_theme_map(themes: DataFrame, volumes: DataFrame) -> DataFrame:
    """``<grp, violation>``: empty when the two tables can be charted.

    Checked: a global list, at least one peripheral group, no group without words, and a numeric volume for
    every peripheral group.
    """
    groups = themes.groupBy("grp").agg(F.count("word").alias("words"))
    totals = groups.agg(
        F.count_if(F.col("grp") == GLOBAL).alias("n_global"),
        F.count_if(F.col("grp") != GLOBAL).alias("n_peripheral"),
    )
    missing = totals.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n_global") == 0, F.struct(F.lit(GLOBAL).alias("grp"), F.lit("no global themes").alias("violation"))),
                    F.when(
                        F.col("n_peripheral") == 0,
                        F.struct(F.lit(None).cast("string").alias("grp"), F.lit("no peripheral group").alias("violation")),
                    ),
                )
            )
        ).alias("v")
    ).select("v.*")
    empty = groups.where("words = 0").select("grp", F.lit("no words").alias("violation"))
    unsized = (
        groups.where(F.col("grp") != GLOBAL)
        .join(numeric_volumes(volumes).select("grp"), "grp", "left_anti")
        .select("grp", F.lit("no numeric volume").alias("violation"))
    )
    return missing.unionByName(empty).unionByName(unsized)


def check_theme_map(themes: DataFrame, volumes: DataFrame) -> None:
    """Raise when :func:`validate_theme_map` finds anything."""
    found = validate_theme_map(themes, volumes).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.grp}: {r.violation}" for r in found))
