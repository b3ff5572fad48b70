"""The stand-in topic model of the SQL cross-checks, built with the library's own operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.catalog.base import MAX_DF, MAX_FEATURES, MIN_DF, documents
from themeloom.functions.text import remove_stopwords, tokenize_alpha
from themeloom.operators import features, topics
from themeloom.operators.ranking import bounded
from themeloom.session import stage


def tokenized(docs: DataFrame) -> DataFrame:
    tokens = remove_stopwords(tokenize_alpha(F.col("content")))
    return docs.withColumn("tokens", tokens).drop("content")


def fit_vocabulary(docs: DataFrame) -> features.Vocabulary:
    return features.Vocabulary.fit(tokenized(docs), MIN_DF, MAX_DF, MAX_FEATURES)


@dataclass(frozen=True)
class StandIn:
    vectors: DataFrame
    cells: DataFrame
    topic_terms: DataFrame
    points: DataFrame
    vocab: DataFrame

    def words(self, n: int) -> DataFrame:
        return topics.topic_top_words(self.topic_terms, self.vocab, n)


def stand_in(spark: SparkSession, sf: str) -> StandIn:
    docs = documents(spark, sf)
    cluster = F.regexp_extract("category", "[0-9]+", 0).cast("int").alias("cluster")
    ready = stage(tokenized(docs).select("doc_id", "lang", "category", cluster, "tokens"), "tokens")
    vocab = features.Vocabulary.fit(ready, MIN_DF, MAX_DF, MAX_FEATURES)
    vectors = stage(features.tfidf_vectors(ready, vocab), "tfidf")
    cells = features.tfidf_rows(vectors)
    # Languages are the topics of this model; more of them than a model may have is an error.
    langs = sorted(r.lang for r in bounded(docs.select("lang").distinct(), topics.MAX_TOPICS, "languages").collect())
    sizes = vectors.groupBy("lang").agg(F.count("*").alias("n"))
    by_lang = cells.groupBy("lang", "term_id").agg(F.sum("tfidf").alias("s")).join(sizes, "lang")
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    topic_terms = by_lang.select(
        number.cast("int").alias("topic"), "term_id", (F.col("s") / F.col("n")).alias("weight")
    )
    h = topic_terms.groupBy("term_id").agg(
        *[F.coalesce(F.max(F.when(F.col("topic") == t, F.col("weight"))), F.lit(0.0)).alias(f"h{t}") for t in range(len(langs))]
    )
    mass = [
        F.coalesce(F.sum(F.col("tfidf") * F.col(f"h{t}")), F.lit(0.0)).alias(f"w{t}") for t in range(len(langs))
    ]
    weighted = cells.join(h, "term_id").groupBy("doc_id").agg(F.array(*mass).alias("_w"))
    zero = F.array(*[F.lit(0.0)] * len(langs))
    points = (
        vectors.select("doc_id", "lang", "category", "cluster")
        .join(weighted, "doc_id", "left")
        .withColumn("w", F.coalesce("_w", zero))
        .drop("_w")
    )
    return StandIn(vectors, cells, topic_terms, points, vocab.table(spark))
