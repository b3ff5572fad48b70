"""Queries over features, topics and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.catalog.base import (
    MAX_DF,
    MAX_FEATURES,
    MIN_DF,
    MODEL_SQL,
    STOP_SQL,
    TFIDF_SQL,
    TOKENS_SQL,
    VOCAB_SQL,
    WORDS_SQL,
    documents,
    query,
    table,
)
from themeloom.catalog.model import fit_vocabulary, stand_in, tokenized
from themeloom.functions.text import remove_stopwords, tokenize_alpha
from themeloom.operators import clusters, features, quality, topics
from themeloom.session import spread, stage

# --- features ---------------------------------------------------------------------------------------


@query("document_frequency", "WITH " + TOKENS_SQL + " SELECT term, count(*) AS df FROM tf GROUP BY term")
def _df(spark: SparkSession, sf: str) -> DataFrame:
    return features.document_frequency(tokenized(documents(spark, sf)))


@query("term_frequency", "WITH " + TOKENS_SQL + " SELECT doc_id, term, tf FROM tf")
def _tf(spark: SparkSession, sf: str) -> DataFrame:
    return features.term_frequency(tokenized(documents(spark, sf))).withColumn("tf", F.col("tf").cast("bigint"))


@query("vocabulary", "WITH " + VOCAB_SQL + " SELECT term_id, term, df, tf, round(idf, 6) AS idf FROM vocab")
def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    found = features.vocabulary(tokenized(documents(spark, sf)), MIN_DF, MAX_DF, MAX_FEATURES)
    return found.withColumn("idf", F.round("idf", 6))


@query(
    "count_vocabulary",
    "WITH "
    + TOKENS_SQL
    + """,
    top AS (
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000
    )
    SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, tf FROM top""",
)
def _count_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return features.count_vocabulary(tokenized(documents(spark, sf)))


@query(
    "adaptive_bounds",
    """
    SELECT n, CASE WHEN n < 100 THEN 1 WHEN n < 1000 THEN 2 ELSE 3 END AS min_df,
      CAST(CASE WHEN n < 100 THEN 0.95 WHEN n < 1000 THEN 0.9 ELSE 0.85 END AS DOUBLE) AS max_df
    FROM (SELECT count(*) AS n FROM documents)""",
)
def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    return features.adaptive_bounds_table(table(spark, sf, "documents"))


@query(
    "clamp_params",
    """
    SELECT n, CAST(greatest(1, least(20, n - 1)) AS INTEGER) AS topics,
      CAST(least(17, greatest(3, n // 3)) AS INTEGER) AS clusters
    FROM (SELECT count(*) AS n FROM documents)""",
)
def _clamps(spark: SparkSession, sf: str) -> DataFrame:
    return features.clamp_params(table(spark, sf, "documents"))


@query("tfidf", "WITH " + TFIDF_SQL + " SELECT doc_id, term_id, tf, round(tfidf, 6) AS tfidf FROM tfidf")
def _tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokenized(documents(spark, sf)).select("doc_id", "tokens")
    return features.tfidf(docs, MIN_DF, MAX_DF, MAX_FEATURES).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_transform",
    "WITH "
    + VOCAB_SQL
    + rf""",
new_tf AS (
  SELECT item_id, term, count(*) AS tf
  FROM (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS term FROM benchmark)
  WHERE regexp_matches(term, '^[a-z]+$') AND term NOT IN ({STOP_SQL}) GROUP BY item_id, term
),
weighed AS (SELECT item_id, term_id, new_tf.tf AS tf, new_tf.tf * idf AS v FROM new_tf JOIN vocab USING (term))
SELECT item_id, term_id, tf, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS tfidf FROM weighed""",
)
def _transform(spark: SparkSession, sf: str) -> DataFrame:
    vocab = fit_vocabulary(documents(spark, sf))
    tokens = remove_stopwords(tokenize_alpha(F.col("text")))
    new = spread(table(spark, sf, "benchmark")).select("item_id", tokens.alias("tokens"))
    return features.tfidf_rows(features.tfidf_vectors(new, vocab)).withColumn("tfidf", F.round("tfidf", 6))


@query("embed_documents")
def _embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = features.embed_documents(documents(spark, sf).select("doc_id", "content"))
    return docs.select("doc_id", "embedding")


@query(
    "masked_mean_pool",
    """
    SELECT doc_id, dim, round(avg(v), 4) AS value
    FROM (SELECT vec_id // 5 AS doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim
          FROM embeddings WHERE vec_id % 3 <> 0)
    GROUP BY doc_id, dim""",
)
def _pool(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("doc_id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"),
    )
    pooled = features.masked_mean_pool(tokens)
    long = pooled.select("doc_id", F.posexplode("embedding").alias("pos", "value"))
    return long.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round("value", 4).alias("value"))


@query(
    "abs_embedding",
    """
    SELECT vec_id, dim, round(abs(v), 5) AS value
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)""",
)
def _abs(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", features.abs_embedding(F.col("embedding")).alias("e"))
    long = vectors.select("vec_id", F.posexplode("e").alias("pos", "v"))
    return long.select(
        "vec_id", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round(F.col("v").cast("double"), 5).alias("value")
    )


# --- topics -----------------------------------------------------------------------------------------


def _fit(spark: SparkSession, sf: str, n_topics: int = 20, max_iter: int = 200, seed: int = 42):
    docs = stage(tokenized(documents(spark, sf)).select("doc_id", "tokens"), "tokens")
    vocab = features.Vocabulary.fit(docs, MIN_DF, MAX_DF, MAX_FEATURES)
    vectors = stage(features.tfidf_vectors(docs, vocab).drop("counts"), "tfidf")
    return topics.fit_topics(vectors, len(vocab), n_topics, seed, max_iter), vocab, vectors


def _long(weighted: DataFrame, key: str) -> DataFrame:
    """One row per topic. The array is rebuilt inside the explode, because Spark adds a filter on an exploded
    column and would compute the weights once for the filter and once for the rows."""
    same = F.transform("w", lambda v: v + 0.0)
    return weighted.select(key, F.posexplode(same).alias("topic", "weight"))


@query("nmf_topics")
def _nmf(spark: SparkSession, sf: str) -> DataFrame:
    model, vocab, _ = _fit(spark, sf)
    return topics.topic_top_words(model.topic_terms(spark, 10), vocab.table(spark), 10)


@query("nmf_transform")
def _nmf_transform(spark: SparkSession, sf: str) -> DataFrame:
    model, _, vectors = _fit(spark, sf)
    return _long(model.transform(vectors), "doc_id")


@query("nmf_embeddings")
def _nmf_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", features.abs_embedding(F.col("embedding")).alias("embedding"))
    rows = stage(topics.dense_rows(spread(vectors), "embedding").select("vec_id", "indices", "values"), "dense")
    model = topics.fit_topics(rows, 64, 20, 42)
    return _long(model.transform(rows), "vec_id")


@query("topic_stability")
def _stability(spark: SparkSession, sf: str) -> DataFrame:
    docs = stage(tokenized(documents(spark, sf)).select("doc_id", "tokens"), "tokens")
    vocab = features.Vocabulary.fit(docs, MIN_DF, MAX_DF, MAX_FEATURES)
    vectors = stage(features.tfidf_vectors(docs, vocab).drop("counts"), "tfidf")
    runs = {s: (topics.fit_topics(vectors, len(vocab), 20, s, start="random"), vocab) for s in (1, 2, 3)}
    return topics.topic_stability(runs, spark)


@query(
    "topic_top_words",
    "WITH " + MODEL_SQL + " SELECT topic, rank, term_id, word, round(weight, 6) AS weight FROM ranked_words WHERE rank <= 10",
)
def _top_words(spark: SparkSession, sf: str) -> DataFrame:
    return stand_in(spark, sf).words(10).withColumn("weight", F.round("weight", 6))


@query(
    "document_theme",
    "WITH "
    + MODEL_SQL
    + """,
names AS (SELECT topic, string_agg(word, ' ' ORDER BY rank) AS theme FROM ranked_words WHERE rank <= 5 GROUP BY topic),
best AS (SELECT doc_id, topic FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) = 1)
SELECT doc_id, topic, theme FROM best JOIN names USING (topic)""",
)
def _document_theme(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    return topics.document_theme(model.points, model.words(5)).select("doc_id", "topic", "theme")


@query(
    "topic_coherence",
    "WITH "
    + MODEL_SQL
    + """,
tops AS (SELECT topic, rank, word FROM ranked_words WHERE rank <= 10),
held AS (SELECT DISTINCT doc_id, topic, rank FROM tops JOIN tf ON tf.term = tops.word),
alone AS (SELECT topic, rank, count(*) AS d FROM held GROUP BY topic, rank),
pairs AS (
  SELECT a.topic, a.rank AS earlier, b.rank AS later, count(*) AS d
  FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.topic = b.topic AND a.rank < b.rank GROUP BY ALL
)
SELECT e.topic, round(sum(ln((coalesce(p.d, 0) + 1) / x.d)), 6) AS coherence
FROM tops e JOIN tops l ON e.topic = l.topic AND e.rank < l.rank
JOIN alone x ON x.topic = e.topic AND x.rank = e.rank
LEFT JOIN pairs p ON p.topic = e.topic AND p.earlier = e.rank AND p.later = l.rank
GROUP BY e.topic""",
)
def _coherence(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokenized(documents(spark, sf)).select("tokens")
    return topics.topic_coherence(docs, stand_in(spark, sf).words(10)).withColumn("coherence", F.round("coherence", 6))


# --- clusters ---------------------------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table as labelled points."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("w"),
        F.col("label").alias("cluster"),
    )


def _start(spark: SparkSession, sf: str, k: int) -> np.ndarray:
    first = points(spark, sf).where(F.col("doc_id") < k).orderBy("doc_id").select("w").collect()
    return np.array([r.w for r in first])


POINTS_SQL = """
p AS (SELECT vec_id AS doc_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
cells AS (SELECT doc_id, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM p),
means AS (SELECT cluster, dim, avg(v) AS m FROM cells GROUP BY cluster, dim),
sizes AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster),
gaps AS (
  SELECT c.doc_id, c.cluster, sum((c.v - m.m) * (c.v - m.m)) AS sq FROM cells c JOIN means m USING (cluster, dim)
  GROUP BY c.doc_id, c.cluster
),
spreads AS (SELECT cluster, avg(sqrt(sq)) AS spread FROM gaps GROUP BY cluster)"""


def _assign_sql(centers: str, name: str) -> str:
    """Labels of the nearest of ``centers <cluster, x>``."""
    return f"""
{name} AS (
  SELECT doc_id, x, cluster, distance FROM (
    SELECT p.doc_id, p.x, c.cluster, list_distance(p.x, c.x) AS distance FROM p CROSS JOIN {centers} c
  ) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster) = 1
)"""


def _update_sql(labels: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT cluster, list(m ORDER BY dim) AS x FROM (
    SELECT cluster, dim, avg(v) AS m
    FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {labels}) GROUP BY cluster, dim
  ) GROUP BY cluster
)"""


START_SQL = """
p AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c0 AS (SELECT CAST(doc_id AS INTEGER) AS cluster, x FROM p WHERE doc_id < 8)"""


@query(
    "assign_nearest",
    "WITH " + START_SQL + "," + _assign_sql("c0", "l0") + " SELECT doc_id, cluster, round(distance, 6) AS distance FROM l0",
)
def _assign(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.assign_nearest(points(spark, sf).drop("cluster"), _start(spark, sf, 8))
    return found.select("doc_id", "cluster", F.round("distance", 6).alias("distance"))


@query(
    "update_centroids",
    "WITH "
    + START_SQL
    + ","
    + _assign_sql("c0", "l0")
    + ","
    + _update_sql("l0", "c1")
    + " SELECT cluster, unnest([round(v, 6) FOR v IN x]) AS value, generate_subscripts(x, 1) AS dim FROM c1",
)
def _update(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    start = _start(spark, sf, 8)
    old = pts.where(F.col("doc_id") < 8).select(F.col("doc_id").cast("int").alias("cluster"), F.col("w").alias("mean"))
    moved = clusters.update_centroids(clusters.assign_nearest(pts.drop("cluster"), start), old)
    long = moved.select("cluster", F.posexplode("mean").alias("pos", "value"))
    return long.select("cluster", F.round("value", 6).alias("value"), (F.col("pos") + 1).cast("bigint").alias("dim"))


# Rounds go on from the second one until the centers move less than the tolerance; a center without points stays.
LLOYD_SQL = """
lloyd(round, cluster, x, moved) AS (
  SELECT 0, cluster, x, NULL::DOUBLE FROM c0
  UNION ALL
  SELECT round, cluster, x, sqrt(sum(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - old[i]) ** 2))) OVER ())
  FROM (
    SELECT l.round + 1 AS round, l.cluster, coalesce(m.x, l.x) AS x, l.x AS old
    FROM lloyd l LEFT JOIN (
      SELECT cluster, list(v ORDER BY dim) AS x FROM (
        SELECT cluster, dim, avg(v) AS v FROM (
          SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM (
            SELECT any_value(p.x) AS x, CAST(min([list_distance(p.x, k.x), k.cluster])[2] AS INTEGER) AS cluster FROM p, lloyd k GROUP BY p.doc_id
          )
        ) GROUP BY cluster, dim
      ) GROUP BY cluster
    ) m ON m.cluster = l.cluster
    WHERE l.round < 100 AND (l.round < 2 OR l.moved >= 1e-4)
  )
),
used AS (SELECT cluster, x FROM lloyd WHERE round = (SELECT max(round) - 1 FROM lloyd))"""


@query(
    "kmeans_lloyd",
    "WITH RECURSIVE " + START_SQL + "," + LLOYD_SQL + "," + _assign_sql("used", "labels")
    + " SELECT doc_id, cluster, round(distance, 6) AS distance FROM labels",
)
def _lloyd(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf).drop("cluster")
    used, _ = clusters.kmeans_lloyd(pts, _start(spark, sf, 8))
    return clusters.assign_nearest(pts, used).select("doc_id", "cluster", F.round("distance", 6).alias("distance"))


@query("kmeans_labels")
def _kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.kmeans_labels(points(spark, sf).drop("cluster"), 10).select("doc_id", "cluster")


@query("hierarchical_labels")
def _hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.hierarchical_labels(points(spark, sf).drop("cluster"), 10).select("doc_id", "cluster")


@query("bisecting_labels")
def _bisecting(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.bisecting_labels(points(spark, sf).drop("cluster"), 10).select("doc_id", "cluster")


@query("select_k")
def _select_k(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf).drop("cluster")
    return clusters.select_k(clusters.score_cuts(pts, clusters.fit_hierarchy(pts), 100))


@query("sample_rows", "SELECT vec_id AS doc_id FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 17")
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.sample_rows(points(spark, sf), 17).select("doc_id")


def _silhouette_sql(distance: str) -> str:
    return f"""
p AS (SELECT vec_id AS doc_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sizes AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster),
far AS (
  SELECT a.doc_id, a.cluster AS own, b.cluster AS other, sum({distance}) AS d FROM p a CROSS JOIN p b
  GROUP BY a.doc_id, a.cluster, b.cluster
),
ab AS (
  SELECT doc_id, own, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b
  FROM far JOIN sizes ON sizes.cluster = far.other GROUP BY doc_id, own
)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""


@query("silhouette_squared", "WITH " + _silhouette_sql("pow(list_distance(a.x, b.x), 2)"))
def _silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    score = quality.silhouette_squared(points(spark, sf))
    return spark.range(1).select(F.round(F.lit(score), 6).alias("silhouette"))


@query("silhouette_exact", "WITH " + _silhouette_sql("list_distance(a.x, b.x)"))
def _silhouette_exact(spark: SparkSession, sf: str) -> DataFrame:
    return quality.silhouette_exact(points(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


@query(
    "calinski_harabasz",
    "WITH "
    + POINTS_SQL
    + """,
whole AS (SELECT dim, avg(v) AS m FROM cells GROUP BY dim),
bet AS (SELECT sum(n * (means.m - whole.m) * (means.m - whole.m)) AS b FROM means JOIN whole USING (dim) JOIN sizes USING (cluster)),
wit AS (SELECT sum(sq) AS w, count(*) AS n FROM gaps)
SELECT round((b / ((SELECT count(*) FROM sizes) - 1)) / (w / (n - (SELECT count(*) FROM sizes))), 6) AS calinski_harabasz_score
FROM bet, wit""",
)
def _ch(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round("calinski_harabasz_score", 6).alias("calinski_harabasz_score")
    return quality.calinski_harabasz(points(spark, sf)).select(score)


@query(
    "davies_bouldin",
    "WITH "
    + POINTS_SQL
    + """,
between_means AS (
  SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d
  FROM means a JOIN means b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster
),
worst AS (
  SELECT i, max((x.spread + y.spread) / d) AS r FROM between_means
  JOIN spreads x ON x.cluster = i JOIN spreads y ON y.cluster = j GROUP BY i
)
SELECT round(avg(r), 6) AS davies_bouldin_score FROM worst""",
)
def _db(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.davies_bouldin(quality.center_distances(points(spark, sf)))
    return found.select(F.round("davies_bouldin_score", 6).alias("davies_bouldin_score"))


@query("cluster_density", "WITH " + POINTS_SQL + " SELECT round(avg(spread), 6) AS cluster_density FROM spreads")
def _density(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.cluster_density(quality.center_distances(points(spark, sf)))
    return found.select(F.round("cluster_density", 6).alias("cluster_density"))


@query("cluster_volumes", "SELECT label AS cluster, count(*) AS volume FROM embeddings GROUP BY label")
def _volumes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.cluster_volumes(points(spark, sf))


@query(
    "cluster_sizes",
    """
    SELECT string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY c) AS cluster_sizes
    FROM (SELECT unnest(range(12)) AS c) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON label = c""",
)
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.cluster_sizes(points(spark, sf), 12).select(F.array_join("cluster_sizes", ",").alias("cluster_sizes"))


@query(
    "largest_cluster",
    "SELECT label AS cluster, count(*) AS volume FROM embeddings GROUP BY label ORDER BY volume DESC, label LIMIT 1",
)
def _largest(spark: SparkSession, sf: str) -> DataFrame:
    return quality.largest_cluster(points(spark, sf))
