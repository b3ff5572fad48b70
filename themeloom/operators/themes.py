"""Ranked theme words per group, volumes, and the global/peripheral split.

Inputs: ``points <..., w array<double>, cluster>`` and the bounded word table
``words <topic, rank, word, weight>`` of :func:`themeloom.operators.topics.topic_top_words`.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.functions.text import clean_theme_word, term_counts
from themeloom.operators.quality import cluster_volumes, largest_cluster
from themeloom.operators.ranking import RANK_DIGITS, bounded, by_score, dedup_keep_max, top_n_per_group
from themeloom.session import stage

GLOBAL = "global"
MAX_WORDS = 50_000  # topics times words per topic


def attach_labels(points: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join labels that were made elsewhere; labels of our own clusterings are already in the rows."""
    return points.join(labels.select(key, "cluster"), key)


def topic_means(points: DataFrame) -> DataFrame:
    """``<cluster, topic, importance>``: mean weight of every topic in every cluster."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("w"))).alias("mean")
    return points.groupBy("cluster").agg(mean).select("cluster", F.posexplode("mean").alias("topic", "importance"))


def cluster_themes_topic_mean(points: DataFrame, words: DataFrame, n_themes: int = 20) -> DataFrame:
    """``<cluster, rank, word, score>``: the words of the strongest topics, scored by the topic's mean.

    Words may repeat; ties keep topic order, then word order.
    """
    scored = topic_means(points).join(words.select("topic", F.col("rank").alias("word_rank"), "word"), "topic")
    ranked = top_n_per_group(scored, ["cluster"], [by_score("importance"), "topic", "word_rank"], n_themes)
    return ranked.select("cluster", "rank", "word", F.col("importance").alias("score"))


def cluster_top_topics(points: DataFrame, words: DataFrame, n_topics: int = 20) -> DataFrame:
    """``<cluster, rank, topic, theme array<string>, importance>``: the strongest topics of each cluster."""
    lists = words.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("theme")
    )
    ranked = top_n_per_group(topic_means(points), ["cluster"], [by_score("importance"), "topic"], n_topics)
    return ranked.join(lists, "topic").select("cluster", "rank", "topic", "theme", "importance")


def cluster_themes_weighted(points: DataFrame, words: DataFrame, n_themes: int = 50) -> DataFrame:
    """``<cluster, rank, word, score>``: topic mean times word weight, cleaned, best score per word."""
    scored = topic_means(points).join(words.select("topic", "word", "weight"), "topic")
    clean = scored.select(
        "cluster",
        clean_theme_word(F.col("word")).alias("word"),
        (F.col("importance") * F.col("weight")).alias("score"),
    ).where("word is not null")
    best = dedup_keep_max(clean, ["cluster", "word"])
    ranked = top_n_per_group(best, ["cluster"], [by_score("score"), "word"], n_themes)
    return ranked.select("cluster", "rank", "word", "score")


def _tfidf_themes(rows: DataFrame, sizes: DataFrame, words: DataFrame, n_themes: int, keys: list[str]) -> DataFrame:
    """Mean TF-IDF of each topic word over a group (zeros counted) times its topic weight.

    ``sizes <keys..., n_docs>`` has one row per group. Only cells of topic words, a bounded broadcast table, reach the
    aggregate, and only words with a score are ranked. A group that has fewer than ``n_themes`` of them is filled up
    with the first other topic words by name, score 0.
    """
    words = bounded(words.select("term_id", "word", "weight"), MAX_WORDS, "topic words")
    words = words.withColumn("word", clean_theme_word(F.col("word"))).where("word is not null")
    used = rows.join(F.broadcast(words.select("term_id").distinct()), "term_id", "left_semi")
    mass = used.groupBy(*keys, "term_id").agg(F.sum("tfidf").alias("mass")).join(F.broadcast(words), "term_id")
    size = F.col("n_docs") if keys else sizes.select("n_docs").scalar()
    placed = mass.join(sizes, keys) if keys else mass
    scored = placed.select(*keys, "word", (F.col("mass") / size * F.col("weight")).alias("score"))
    best = dedup_keep_max(scored, [*keys, "word"]).where(F.round("score", RANK_DIGITS) > 0)
    ranked = top_n_per_group(best, keys, [by_score("score"), "word"], n_themes).select(*keys, "rank", "word", "score")
    ranked = stage(ranked, "themes")

    names = words.agg(F.slice(F.sort_array(F.collect_set("word")), 1, 2 * n_themes)).scalar()
    have = F.collect_list("word").alias("have")
    groups = sizes.select(*keys).join(ranked.groupBy(*keys).agg(have), keys, "left") if keys else ranked.agg(have)
    counted = groups.select(*keys, F.coalesce("have", F.array().cast("array<string>")).alias("have"), names.alias("names"))
    short = counted.where(F.size("have") < n_themes)
    more = F.filter("names", lambda w: ~F.array_contains(F.col("have"), w))
    filled = short.select(*keys, F.size("have").alias("n"), F.posexplode(F.slice(more, 1, n_themes - F.size("have"))).alias("pos", "word"))
    return ranked.unionByName(filled.select(*keys, (F.col("n") + F.col("pos") + 1).alias("rank"), "word", F.lit(0.0).alias("score")))


def global_themes_tfidf(rows: DataFrame, sizes: DataFrame, words: DataFrame, n_themes: int = 50) -> DataFrame:
    """``<rank, word, score>`` over all documents; ``sizes <n_docs>`` is a one-row count."""
    return _tfidf_themes(rows, sizes, words, n_themes, [])


def category_themes_tfidf(rows: DataFrame, sizes: DataFrame, words: DataFrame, n_themes: int = 50) -> DataFrame:
    """``<category, rank, word, score>``; ``sizes <category, n_docs>`` counts the documents.

    ``rows <category, term_id, tfidf>`` is reduced map-side to one row per category and term.
    """
    return _tfidf_themes(rows, sizes, words, n_themes, ["category"])


def group_name(cluster: Column, largest: Column) -> Column:
    """``global`` for the largest cluster, ``c<n+1>`` for the others."""
    return F.when(cluster == largest, GLOBAL).otherwise(
        F.concat(F.lit("c"), (cluster + 1).cast("string"))
    )


def theme_map(themes: DataFrame, volumes: DataFrame) -> DataFrame:
    """``<grp, rank, word, score, volume>`` from per-cluster themes and ``<cluster, volume>``."""
    largest = volumes.orderBy(F.desc("volume"), "cluster").limit(1).select("cluster").scalar()
    return themes.join(volumes, "cluster").select(
        group_name(F.col("cluster"), largest).alias("grp"), "rank", "word", "score", "volume"
    )


def named_volumes(labelled: DataFrame) -> DataFrame:
    """``<grp, volume>`` with the largest cluster as ``global``."""
    largest = largest_cluster(labelled).select("cluster").scalar()
    return cluster_volumes(labelled).select(group_name(F.col("cluster"), largest).alias("grp"), "volume")


def volume_records(volumes: DataFrame, quality: DataFrame) -> DataFrame:
    """The one-row quality record repeated beside each ``<grp, volume>``."""
    fields = (
        "silhouette_score",
        "calinski_harabasz_score",
        "davies_bouldin_score",
        "cluster_sizes",
        "cluster_density",
    )
    one = quality.select(F.struct(*fields)).scalar()
    return volumes.withColumn("_q", one).select("grp", "volume", *[F.col("_q")[f].alias(f) for f in fields])


def peripheral_groups(df: DataFrame) -> DataFrame:
    return df.where(F.col("grp") != GLOBAL)


def group_slice(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one group; the filter reaches the scan."""
    return df.where(F.col(column) == value)


def distinct_categories(docs: DataFrame) -> DataFrame:
    """``<category, first_doc>``; sorting by ``first_doc`` gives the order of first appearance."""
    return docs.groupBy("category").agg(F.min("doc_id").alias("first_doc"))


def word_summary(docs: DataFrame, n_words: int = 50, by: str | None = None) -> DataFrame:
    """``<[by,] rank, word, frequency>``: the most frequent tokens of ``<[by,] tokens>``."""
    keys = [by] if by else []
    counted = (
        docs.select(*keys, F.inline(term_counts(F.col("tokens"))).alias("word", "tf"))
        .groupBy(*keys, "word")
        .agg(F.sum("tf").alias("frequency"))
    )
    ranked = top_n_per_group(counted, keys, [F.desc("frequency"), "word"], n_words)
    return ranked.select(*keys, "rank", "word", "frequency")
