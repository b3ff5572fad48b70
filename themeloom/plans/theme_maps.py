"""Complete theme maps: documents in, ranked themes and volumes out.

Each plan fits in three steps. The vocabulary is one aggregate over the corpus; the TF-IDF vectors are one
narrow pass, staged to shared storage because the topic fit reads them once per round; the topic
weights and cluster labels are narrow passes over the staged vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.functions.stopwords import ENGLISH
from themeloom.functions.text import (
    extract_span,
    normalize_text,
    remove_stopwords,
    tokenize_alpha,
    tokenize_words,
)
from themeloom.operators import clusters, features, quality, responses, sections, stats, themes, topics
from themeloom.operators.ranking import bounded
from themeloom.session import stage
from themeloom.sources.checks import prepare_documents, refuse_value, require_columns, require_nonempty
from themeloom.sources.theme_files import (
    labelled_sections,
    themes_export_json,
    volumes_export_json,
    write_themes,
    write_volumes,
)


@dataclass(frozen=True)
class ThemeMap:
    """``themes <grp, rank, word, score>``, ``volumes <grp, volume, ...>`` and, where documents were
    clustered, ``labels`` (section key and cluster). A map of whole documents has their dominant topics in ``document_themes``."""

    themes: DataFrame
    volumes: DataFrame
    labels: DataFrame | None = None
    sections: DataFrame | None = None
    document_themes: DataFrame | None = None

    def labelled_sections(self) -> DataFrame:
        if self.labels is None or self.sections is None:
            raise ValueError("this map was made from given categories")
        return labelled_sections(self.sections, self.labels)

    def write(self, path: str) -> None:
        write_themes(self.themes, f"{path}/themes")
        write_volumes(self.volumes, f"{path}/volumes")

    def export_json(self, path: str, scalar_volumes: bool = False) -> None:
        themes_export_json(self.themes, f"{path}/themes.json")
        volumes_export_json(self.volumes, f"{path}/volumes.json", scalar=scalar_volumes)


@dataclass(frozen=True)
class Topics:
    """Staged rows with topic weights ``w``, and the vocabulary and word tables of the fit."""

    rows: DataFrame
    model: topics.TopicModel
    vocab: features.Vocabulary
    n_rows: int

    def words(self, n_words: int) -> DataFrame:
        spark = self.rows.sparkSession
        ranked = topics.topic_top_words(self.model.topic_terms(spark, n_words), self.vocab.table(spark), n_words)
        return bounded(ranked, themes.MAX_WORDS, "topic words")


def fit(
    docs: DataFrame,
    tokens: Callable[[Column], Column],
    min_df: int,
    max_df: float,
    n_topics: int = 20,
    max_iter: int = 200,
    max_features: int = 20_000,
    seed: int = 42,
    stop_words: Sequence[str] = ENGLISH,
) -> Topics:
    """Vocabulary, staged TF-IDF vectors and topics of ``<keys..., content>``."""
    ready = stage(docs.withColumn("tokens", remove_stopwords(tokens(F.col("content")), stop_words)).drop("content"), "tokens")
    vocab = features.Vocabulary.fit(ready, min_df, max_df, max_features)
    vectors = stage(features.tfidf_vectors(ready, vocab).drop("counts"), "tfidf")
    n_rows = vectors.count()
    k = features.clamp_topics(n_rows, n_topics)
    model = topics.fit_topics(vectors, len(vocab), k, seed, max_iter)
    return Topics(vectors, model, vocab, n_rows)


def _weights(fitted: Topics, *keys: str) -> DataFrame:
    """Topic weights of every row; staged, because clustering reads them many times."""
    return stage(fitted.model.transform(fitted.rows).select(*keys, "w"), "weights")


def _clustered_map(points: DataFrame, ranked: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    counted = quality.cluster_volumes(points)
    named = themes.theme_map(ranked, counted).select("grp", "rank", "word", "score")
    volumes = themes.named_volumes(points)
    if k is not None:
        volumes = themes.volume_records(volumes, quality.quality_record(points, k))
    return named, volumes


def news_theme_map(
    docs: DataFrame, max_clusters: int = 100, n_themes: int = 20, n_topics: int = 20, max_iter: int = 200, seed: int = 42,
    stop_words: Sequence[str] = ENGLISH,
) -> ThemeMap:
    """Articles ``<doc_id, content>``: hierarchical groups, their number chosen by silhouette."""
    clean = docs.select("doc_id", normalize_text(F.col("content")).alias("content"))
    fitted = fit(clean, tokenize_words, 2, 0.5, n_topics, max_iter, seed=seed, stop_words=stop_words)
    points = _weights(fitted, "doc_id")
    labelled = _chosen_labels(points, max_clusters)
    ranked = themes.cluster_themes_topic_mean(labelled, fitted.words(5), n_themes)
    named, volumes = _clustered_map(labelled, ranked, None)
    title = F.col("title") if "title" in docs.columns else F.concat(F.lit("Document "), F.col("doc_id"))
    whole = docs.select("doc_id", title.alias("title"), "content", F.lit(0).alias("position"))
    dominant = topics.document_theme(labelled, fitted.words(5)).select("doc_id", "topic", "theme")
    return ThemeMap(named, volumes, labelled.select("doc_id", "cluster"), whole, dominant)


def _chosen_labels(points: DataFrame, max_clusters: int) -> DataFrame:
    """Staged ``points`` with the hierarchy's clusters, their number chosen by silhouette."""
    tree = clusters.fit_hierarchy(points, clusters.micro_for(max_clusters))
    best = clusters.select_k(clusters.score_cuts(points, tree, max_clusters)).first()
    return stage(tree.labels(points, best.k), "labels")


def _sections_map(
    parts: DataFrame, n_clusters: int, max_df: float, n_themes: int, n_topics: int, max_iter: int, seed: int,
    stop_words: Sequence[str],
) -> ThemeMap:
    """Sections ``<doc_id, position, title, content>`` grouped by k-means."""
    require_nonempty(parts)
    fitted = fit(parts.select("doc_id", "position", "content"), tokenize_alpha, 2, max_df, n_topics, max_iter, seed=seed, stop_words=stop_words)
    points = _weights(fitted, "doc_id", "position").withColumn("_key", F.struct("doc_id", "position"))
    k = features.clamp_clusters(fitted.n_rows, n_clusters)
    start = clusters._vectors_of(clusters.sample_rows(points, k, seed, "_key"), "w")
    used, _ = clusters.kmeans_lloyd(points, start)
    labelled = stage(clusters.assign_nearest(points, used), "labels")
    ranked = themes.cluster_themes_weighted(labelled, fitted.words(10), n_themes)
    named, volumes = _clustered_map(labelled, ranked, k)
    return ThemeMap(named, volumes, labelled.select("doc_id", "position", "cluster"), parts)


def chunk_theme_map(
    docs: DataFrame,
    n_clusters: int = 17,
    chunk_size: int = 1000,
    overlap: int = 100,
    min_chunk_size: int = 100,
    n_themes: int = 50,
    n_topics: int = 20,
    max_iter: int = 300,
    seed: int = 42,
    stop_words: Sequence[str] = ENGLISH,
) -> ThemeMap:
    """Books ``<doc_id, content>``: overlapping chunks of sentences, k-means groups, quality scores."""
    parts = stage(sections.text_sections(docs, chunk_size, overlap, min_chunk_size), "sections")
    return _sections_map(parts, n_clusters, 0.95, n_themes, n_topics, max_iter, seed, stop_words)


def scripture_sections(docs: DataFrame, heading: str, size: int = 10) -> DataFrame:
    """Verse sections of ``<doc_id, content>``; ``position`` runs over all parts of a document."""
    span = docs.select("doc_id", extract_span(F.col("content")).alias("content"))
    parts = sections.split_headings(span, heading)
    cut = sections.verse_sections(parts, size)
    # Both numbers are ints, so a part can't run into the next one.
    return cut.withColumn("position", F.col("part").cast("bigint") * (1 << 32) + F.col("position"))


def verse_theme_map(
    docs: DataFrame,
    heading: str,
    n_clusters: int = 23,
    n_themes: int = 50,
    n_topics: int = 20,
    max_iter: int = 300,
    seed: int = 42,
    stop_words: Sequence[str] = ENGLISH,
) -> ThemeMap:
    """Scripture ``<doc_id, content>``: sections of ten verses, k-means groups."""
    parts = stage(scripture_sections(docs, heading), "sections")
    return _sections_map(parts, n_clusters, 0.95, n_themes, n_topics, max_iter, seed, stop_words)


def verse_hierarchy_map(
    docs: DataFrame,
    heading: str,
    max_clusters: int = 200,
    n_themes: int = 50,
    n_topics: int = 20,
    max_iter: int = 300,
    seed: int = 42,
    stop_words: Sequence[str] = ENGLISH,
) -> ThemeMap:
    """Scripture as above with hierarchical groups, their number chosen by silhouette."""
    parts = require_nonempty(stage(scripture_sections(docs, heading), "sections"))
    fitted = fit(parts.select("doc_id", "position", "content"), tokenize_alpha, 2, 0.5, n_topics, max_iter, seed=seed, stop_words=stop_words)
    points = _weights(fitted, "doc_id", "position")
    labelled = _chosen_labels(points, max_clusters)
    ranked = themes.cluster_themes_weighted(labelled, fitted.words(10), n_themes)
    named, volumes = _clustered_map(labelled, ranked, None)
    return ThemeMap(named, volumes, labelled.select("doc_id", "position", "cluster"), parts)


def category_theme_map(
    docs: DataFrame, n_themes: int = 50, n_topics: int = 10, max_iter: int = 200, seed: int = 42,
    stop_words: Sequence[str] = ENGLISH, bounds: tuple[int, float] | None = None,
) -> ThemeMap:
    """Documents ``<doc_id, category, headline, content>`` grouped by their category.

    ``bounds`` are the least document count and the largest document share of a term; without them they follow the corpus size.
    """
    require_columns(docs, ["category", "headline", "content"])
    refuse_value(docs, "category", themes.GLOBAL)
    prepared = prepare_documents(docs)
    n_docs = prepared.count()
    fitted = fit(
        prepared.select("doc_id", "category", "content"),
        tokenize_alpha,
        *(bounds or features.adaptive_bounds(n_docs)),
        n_topics,
        max_iter,
        seed=seed,
        stop_words=stop_words,
    )
    cells = fitted.rows.select("category", F.explode(F.arrays_zip("indices", "values")).alias("c")).select(
        "category", F.col("c.indices").alias("term_id"), F.col("c.values").alias("tfidf")
    )
    words = fitted.words(50)
    overall = fitted.rows.agg(F.count("*").alias("n_docs"))
    by_category = fitted.rows.groupBy("category").agg(F.count("*").alias("n_docs"))
    whole = themes.global_themes_tfidf(cells, overall, words, n_themes).select(
        F.lit(themes.GLOBAL).alias("grp"), "rank", "word", "score"
    )
    split = themes.category_themes_tfidf(cells, by_category, words, n_themes)
    named = whole.unionByName(split.withColumnRenamed("category", "grp"))
    return ThemeMap(named, stats.category_volume_records(prepared, repeat=False))


def category_prompts(docs: DataFrame, span: int = 64) -> DataFrame:
    """Prompts for the whole corpus (``global``) and for each category of ``<doc_id, category, content>``."""
    refuse_value(docs, "category", themes.GLOBAL)
    whole = sections.concat_group_text(docs.withColumn("grp", F.lit(themes.GLOBAL)), ["grp"], span)
    split = sections.concat_group_text(docs.withColumnRenamed("category", "grp"), ["grp"], span)
    return responses.prompt_table(whole.unionByName(split))


def response_theme_map(docs: DataFrame, answers: DataFrame) -> ThemeMap:
    """Themes merged from a response table, volumes from the words of each category."""
    refuse_value(docs, "category", themes.GLOBAL)
    keys = [c for c in ("grp", "perspective", "segment") if c in answers.columns]
    chosen = responses.first_valid_attempt(responses.validate_responses(answers), keys)
    return ThemeMap(responses.merge_perspectives(chosen), stats.category_volume_records(docs, repeat=False))
