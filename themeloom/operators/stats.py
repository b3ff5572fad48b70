"""Word statistics of ``<doc_id, category, content, word_count>``.

Everything is a grouped aggregate with map-side combine, so a category that holds a third of the corpus
reaches the final stage as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themeloom.functions.text import split_words
from themeloom.operators.ranking import top_n_per_group
from themeloom.session import stage


def words_by_category(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.sum("word_count").alias("total_words"))


def category_share(docs: DataFrame) -> DataFrame:
    """``<category, total_words, share>`` with the share of all words in percent."""
    words = words_by_category(docs)
    everything = words.agg(F.sum("total_words")).scalar()
    return words.withColumn("share", F.col("total_words") / everything * 100)


def category_metrics(docs: DataFrame) -> DataFrame:
    """``<category, word_count, verse_count, avg_words_per_verse>``."""
    return docs.groupBy("category").agg(
        F.sum("word_count").alias("word_count"),
        F.count("*").alias("verse_count"),
        F.avg("word_count").alias("avg_words_per_verse"),
    )


def category_tokens(docs: DataFrame) -> DataFrame:
    """``<category, token, n>`` over case-sensitive whitespace tokens."""
    tokens = docs.select("category", F.explode(split_words(F.col("content"))).alias("token"))
    return tokens.groupBy("category", "token").agg(F.count("*").alias("n"))


def category_unique_words(docs: DataFrame) -> DataFrame:
    return category_tokens(docs).groupBy("category").agg(F.count("*").alias("unique_words"))


def category_common_words(docs: DataFrame, n_words: int = 10) -> DataFrame:
    """``<category, rank, token, n>``, ties by token."""
    ranked = top_n_per_group(category_tokens(docs), ["category"], [F.desc("n"), "token"], n_words)
    return ranked.select("category", "rank", "token", "n")


def category_report(docs: DataFrame) -> DataFrame:
    """All category metrics in one row per category, the common words as a map."""
    counted = category_tokens(docs)
    unique = counted.groupBy("category").agg(F.count("*").alias("unique_words"))
    common = (
        top_n_per_group(counted, ["category"], [F.desc("n"), "token"], 10)
        .groupBy("category")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("most_common_words"))
    )
    return category_metrics(docs).join(unique, "category", "left").join(common, "category", "left")


def volumes_grouping_sets(docs: DataFrame) -> DataFrame:
    """``<grp, volume, documents>``: every category and the global total.

    Categories are summed first; the grand total then runs over one row per category.
    """
    by_category = docs.groupBy("category").agg(
        F.sum("word_count").alias("volume"), F.count("*").alias("documents")
    )
    return (
        by_category.rollup("category")
        .agg(
            F.sum("volume").alias("volume"),
            F.sum("documents").alias("documents"),
            F.grouping_id().alias("_level"),
        )
        .select(F.when(F.col("_level") == 1, "global").otherwise(F.col("category")).alias("grp"), "volume", "documents")
    )


def category_volume_records(docs: DataFrame, max_categories: int = 100_000, repeat: bool = True) -> DataFrame:
    """Volume records of given categories: scores 0.0, the sizes are the category word totals.

    Sizes follow the order of first appearance. They are one array repeated on every row, so the number of categories is checked.
    Without ``repeat`` the array stands once, on the ``global`` row.
    """
    sizes = docs.groupBy("category").agg(
        F.min("doc_id").alias("first_doc"), F.sum("word_count").alias("volume")
    )
    sizes = stage(sizes, "category-sizes")  # read three times below, counted once
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("first_doc", "volume"))), lambda s: s["volume"]
    )
    checked = F.when(F.count("*") <= max_categories, listed).otherwise(
        F.raise_error(F.lit(f"more than {max_categories} categories"))
    )
    everything = sizes.limit(max_categories + 1).agg(checked.alias("s")).scalar()
    total = sizes.agg(F.lit("global").alias("grp"), F.sum("volume").alias("volume")).withColumn("cluster_sizes", everything)
    own = everything if repeat else F.lit(None).cast("array<bigint>")
    zero = F.lit(0.0)
    return total.unionByName(sizes.select(F.col("category").alias("grp"), "volume", own.alias("cluster_sizes"))).select(
        "grp",
        "volume",
        zero.alias("silhouette_score"),
        zero.alias("calinski_harabasz_score"),
        zero.alias("davies_bouldin_score"),
        "cluster_sizes",
        zero.alias("cluster_density"),
    )
