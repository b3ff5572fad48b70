"""Queries over theme rankings, volumes, chart columns, responses and complete theme maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.catalog.base import CLUSTER_THEMES_SQL, MODEL_SQL, TFIDF_SQL, clean_word_sql, documents, query, table
from themeloom.catalog.files import PREPARED_SQL, prepared, theme_tables
from themeloom.catalog.models import POINTS_SQL, points
from themeloom.catalog.model import stand_in
from themeloom.catalog.text import HEADING, verse_text
from themeloom.operators import chart, quality, ranking, responses, sections, stats, themes
from themeloom.plans import theme_maps

# --- rankings ---------------------------------------------------------------------------------------


@query(
    "cluster_themes_topic_mean",
    "WITH "
    + MODEL_SQL
    + """
    SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(importance, 10) DESC, topic, rank) AS INTEGER) AS rank,
      word, round(importance, 6) AS score
    FROM means JOIN (SELECT topic, rank, word FROM ranked_words WHERE rank <= 5) USING (topic)
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(importance, 10) DESC, topic, rank) <= 20""",
)
def _topic_mean(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    return themes.cluster_themes_topic_mean(model.points, model.words(5)).withColumn("score", F.round("score", 6))


@query(
    "cluster_top_topics",
    "WITH "
    + MODEL_SQL
    + """,
names AS (SELECT topic, string_agg(word, ' ' ORDER BY rank) AS theme FROM ranked_words WHERE rank <= 5 GROUP BY topic)
    SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(importance, 10) DESC, topic) AS INTEGER) AS rank,
      topic, theme, round(importance, 6) AS importance
    FROM means JOIN names USING (topic)
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(importance, 10) DESC, topic) <= 3""",
)
def _top_topics(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    ranked = themes.cluster_top_topics(model.points, model.words(5), 3)
    return ranked.withColumns({"theme": F.array_join("theme", " "), "importance": F.round("importance", 6)})


@query(
    "cluster_themes_weighted",
    "WITH " + CLUSTER_THEMES_SQL + " SELECT cluster, rank, word, round(score, 6) AS score FROM themes",
)
def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    return themes.cluster_themes_weighted(model.points, model.words(10)).withColumn("score", F.round("score", 6))


def _tfidf_themes_sql(key: str) -> str:
    keys, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    group = f"GROUP BY {key}" if key else ""
    return f"""
wanted AS (SELECT topic, term_id, word, weight FROM ranked_words WHERE rank <= 50),
groups AS (SELECT {keys}count(*) AS n_docs FROM (SELECT *, source AS category FROM documents) {group}),
term_mass AS (SELECT {keys}term_id, sum(tfidf) AS mass FROM (SELECT *, source AS category FROM tfidf) GROUP BY {keys}term_id),
scored AS (
  SELECT {keys}{clean_word_sql('word')} AS word, coalesce(mass, 0) / n_docs * weight AS score
  FROM groups CROSS JOIN wanted LEFT JOIN term_mass USING ({keys}term_id)
),
best AS (SELECT {keys}word, max(score) AS score FROM scored WHERE word IS NOT NULL GROUP BY {keys}word)
SELECT {keys}CAST(row_number() OVER ({part}ORDER BY round(score, 10) DESC, word) AS INTEGER) AS rank, word, round(score, 8) AS score
FROM best QUALIFY row_number() OVER ({part}ORDER BY round(score, 10) DESC, word) <= 50"""


@query("global_themes_tfidf", "WITH " + MODEL_SQL + "," + _tfidf_themes_sql(""))
def _global_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    n_docs = documents(spark, sf).agg(F.count("*").alias("n_docs"))
    ranked = themes.global_themes_tfidf(model.cells, n_docs, model.words(50))
    return ranked.withColumn("score", F.round("score", 8))


@query("category_themes_tfidf", "WITH " + MODEL_SQL + "," + _tfidf_themes_sql("category"))
def _category_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    sizes = documents(spark, sf).groupBy("category").agg(F.count("*").alias("n_docs"))
    ranked = themes.category_themes_tfidf(model.cells, sizes, model.words(50))
    return ranked.withColumn("score", F.round("score", 8))


@query("theme_map", "WITH " + CLUSTER_THEMES_SQL + " SELECT grp, rank, word, round(score, 6) AS score, volume FROM theme_map")
def _theme_map(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    ranked = themes.cluster_themes_weighted(model.points, model.words(10))
    return themes.theme_map(ranked, quality.cluster_volumes(model.points)).withColumn("score", F.round("score", 6))


@query(
    "top_n_per_group",
    "WITH "
    + TFIDF_SQL
    + """
    SELECT source AS category, CAST(row_number() OVER (PARTITION BY source ORDER BY round(score, 10) DESC, term) AS INTEGER) AS rank,
      term, round(score, 8) AS score
    FROM (SELECT source, term_id, sum(tfidf) / any_value(n) AS score
          FROM tfidf JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) GROUP BY source, term_id)
    JOIN vocab USING (term_id)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 10) DESC, term) <= 20""",
)
def _top_n(spark: SparkSession, sf: str) -> DataFrame:
    model = stand_in(spark, sf)
    sizes = documents(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    sums = model.cells.groupBy("category", "term_id").agg(F.sum("tfidf").alias("s"))
    scored = sums.join(sizes, "category").join(model.vocab, "term_id").withColumn("score", F.col("s") / F.col("n"))
    ranked = ranking.top_n_per_group(scored, ["category"], [ranking.by_score("score"), "term"], 20)
    return ranked.select("category", "rank", "term", F.round("score", 8).alias("score"))


@query(
    "dedup_keep_max",
    "WITH " + TFIDF_SQL + " SELECT source AS category, term_id, round(max(tfidf), 6) AS score FROM tfidf GROUP BY source, term_id",
)
def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    cells = stand_in(spark, sf).cells.select("category", "term_id", F.col("tfidf").alias("score"))
    return ranking.dedup_keep_max(cells, ["category", "term_id"]).withColumn("score", F.round("score", 6))


@query("peripheral_groups", "WITH " + CLUSTER_THEMES_SQL + " SELECT grp, rank, word FROM theme_map WHERE grp <> 'global'")
def _peripheral(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    return themes.peripheral_groups(mapped).select("grp", "rank", "word")


# --- volumes ----------------------------------------------------------------------------------------


@query(
    "volume_records",
    "WITH "
    + POINTS_SQL
    + """,
whole AS (SELECT dim, avg(v) AS m FROM cells GROUP BY dim),
bet AS (SELECT sum(n * (means.m - whole.m) * (means.m - whole.m)) AS b FROM means JOIN whole USING (dim) JOIN sizes USING (cluster)),
wit AS (SELECT sum(sq) AS w, count(*) AS n FROM gaps),
big AS (SELECT cluster AS g FROM sizes ORDER BY n DESC, cluster LIMIT 1)
SELECT CASE WHEN cluster = g THEN 'global' ELSE 'c' || (cluster + 1) END AS grp, sizes.n AS volume,
  round((b / ((SELECT count(*) FROM sizes) - 1)) / (w / (wit.n - (SELECT count(*) FROM sizes))), 6) AS calinski_harabasz_score,
  (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY cluster) FROM sizes) AS cluster_sizes,
  round((SELECT avg(spread) FROM spreads), 6) AS cluster_density
FROM sizes, big, bet, wit""",
)
def _records(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    full = themes.volume_records(themes.named_volumes(pts), quality.quality_record(pts, 10))
    return full.select(
        "grp",
        "volume",
        F.round("calinski_harabasz_score", 6).alias("calinski_harabasz_score"),
        F.array_join("cluster_sizes", ",").alias("cluster_sizes"),
        F.round("cluster_density", 6).alias("cluster_density"),
    )


@query(
    "category_volume_records",
    "WITH "
    + PREPARED_SQL
    + """,
sizes AS (SELECT category, min(doc_id) AS first_doc, CAST(sum(word_count) AS BIGINT) AS volume FROM prepared GROUP BY category),
listed AS (SELECT string_agg(CAST(volume AS VARCHAR), ',' ORDER BY first_doc) AS s FROM sizes)
SELECT grp, volume, CAST(0 AS DOUBLE) AS silhouette_score, s AS cluster_sizes
FROM (SELECT category AS grp, volume FROM sizes UNION ALL SELECT 'global', CAST(sum(volume) AS BIGINT) FROM sizes), listed""",
)
def _category_records(spark: SparkSession, sf: str) -> DataFrame:
    records = stats.category_volume_records(prepared(spark, sf))
    return records.select("grp", "volume", "silhouette_score", F.array_join("cluster_sizes", ",").alias("cluster_sizes"))


# --- chart columns ----------------------------------------------------------------------------------

CLUSTER_VOLUMES_SQL = """
named AS (
  SELECT CASE WHEN cluster = g THEN 'global' ELSE 'c' || (cluster + 1) END AS grp, volume
  FROM (SELECT label AS cluster, count(*) AS volume FROM embeddings GROUP BY label),
    (SELECT label AS g FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
)"""


@query(
    "chart_words",
    "WITH " + CLUSTER_THEMES_SQL + " SELECT grp, rank, word FROM theme_map WHERE rank <= CASE WHEN grp = 'global' THEN 8 ELSE 5 END",
)
def _chart_words(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    return chart.chart_words(mapped, 8, 5).select("grp", "rank", "word")


@query(
    "relative_volume",
    "WITH "
    + CLUSTER_VOLUMES_SQL
    + """
    SELECT grp, volume, round(volume / ((SELECT max(volume) FROM named WHERE grp <> 'global') * CAST(1.2 AS DOUBLE)), 6) AS relative
    FROM named""",
)
def _relative(spark: SparkSession, sf: str) -> DataFrame:
    return chart.relative_volume(themes.named_volumes(points(spark, sf))).withColumn("relative", F.round("relative", 6))


@query(
    "score_scale",
    "WITH "
    + CLUSTER_THEMES_SQL
    + """
    SELECT grp, rank, word, round(CASE WHEN grp = 'global' THEN 12 + 36 * sqrt(score) ELSE 8 + 16 * sqrt(score) END, 5) AS size
    FROM theme_map""",
)
def _scale(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    size = chart.score_scale(F.col("score"), F.col("grp") == themes.GLOBAL)
    return mapped.select("grp", "rank", "word", F.round(size, 5).alias("size"))


@query(
    "theme_share",
    "WITH "
    + CLUSTER_THEMES_SQL
    + """,
floored AS (SELECT grp, rank, word, greatest(score, max(score) OVER (PARTITION BY grp) * CAST(0.01 AS DOUBLE)) AS s FROM theme_map)
SELECT grp, rank, word, round(s / sum(s) OVER (PARTITION BY grp), 6) AS share FROM floored""",
)
def _theme_share(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    return chart.theme_share(mapped).select("grp", "rank", "word", F.round("share", 6).alias("share"))


def _doubtful(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes as text; every third label has something that is not a number."""
    named = themes.named_volumes(points(spark, sf))
    n = F.col("volume") % 3
    return named.select(
        "grp",
        F.when(n == 0, "NaN").when(n == 1, "many").otherwise(F.col("volume").cast("string")).alias("volume"),
    )


DOUBTFUL_SQL = CLUSTER_VOLUMES_SQL + """,
doubtful AS (
  SELECT grp, CASE WHEN volume % 3 = 0 THEN 'NaN' WHEN volume % 3 = 1 THEN 'many' ELSE CAST(volume AS VARCHAR) END AS volume
  FROM named
),
good AS (SELECT grp, volume FROM doubtful WHERE try_cast(volume AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(volume AS DOUBLE)))"""


@query("numeric_volumes", "WITH " + DOUBTFUL_SQL + " SELECT grp, volume FROM good")
def _numeric(spark: SparkSession, sf: str) -> DataFrame:
    return chart.numeric_volumes(_doubtful(spark, sf))


@query(
    "validate_theme_map",
    "WITH "
    + DOUBTFUL_SQL
    + """
    SELECT grp, CASE WHEN grp = 'c4' THEN 'no words' ELSE 'no numeric volume' END AS violation FROM named
    WHERE (grp <> 'global' AND grp NOT IN (SELECT grp FROM good)) AND grp <> 'c4'
    UNION ALL SELECT grp, 'no words' FROM named WHERE grp = 'c4'
    UNION ALL SELECT grp, 'no numeric volume' FROM named WHERE grp = 'c4' AND grp NOT IN (SELECT grp FROM good)
    UNION ALL SELECT 'global', 'no global themes' WHERE NOT EXISTS (SELECT 1 FROM named WHERE grp = 'global')""",
)
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    # One row per embedding stands in for a theme word; group c4 loses its words.
    largest = quality.largest_cluster(points(spark, sf)).select("cluster").scalar()
    words = points(spark, sf).select(
        themes.group_name(F.col("cluster"), largest).alias("grp"), F.col("doc_id").cast("string").alias("word")
    )
    emptied = words.withColumn("word", F.when(F.col("grp") != "c4", F.col("word")))
    return chart.validate_theme_map(emptied, _doubtful(spark, sf))


# --- responses --------------------------------------------------------------------------------------


@query(
    "prompt_table",
    "WITH grouped AS (SELECT source AS grp, doc_id // 64 AS segment, string_agg(text, ' ' ORDER BY doc_id) AS content "
    "FROM documents GROUP BY ALL), asks(perspective, ask) AS (VALUES "
    + ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in responses.PERSPECTIVES.items())
    + ") SELECT grp, segment, perspective, md5(ask || '"
    + responses.RULES.replace("'", "''")
    + "' || content) AS prompt_hash FROM grouped CROSS JOIN asks",
)
def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    texts = sections.concat_group_text(documents(spark, sf).withColumnRenamed("category", "grp"), ["grp"])
    prompts = responses.prompt_table(texts)
    return prompts.select("grp", "segment", "perspective", F.md5(F.col("prompt").cast("binary")).alias("prompt_hash"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Responses made of all words of each conversation text; the turn decides which of them are malformed."""
    talk = table(spark, sf, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    weight = F.concat(F.lit("0."), F.lpad((F.col("conv_id") % 90).cast("string"), 2, "0"))
    pairs = F.transform(words, lambda w: F.concat(F.lit('["'), w, F.lit('", '), weight, F.lit("]")))
    turn = F.col("turn") % 5
    text = (
        F.when(turn == 0, F.concat(F.lit("Here: ["), F.array_join(pairs, ", "), F.lit("] ok")))
        .when(turn == 1, F.concat(F.lit('[["'), F.array_join(words, ""), F.lit('", 1.5]]')))
        .when(turn == 2, F.concat(F.lit('[["'), F.array_join(words, "-"), F.lit('", 0.5]]')))
        .when(turn == 3, F.concat(F.lit("no themes [sorry "), F.array_join(words, " ")))
        .otherwise(F.lit("[]"))
    )
    names = F.array(*[F.lit(p) for p in responses.PERSPECTIVES])
    return talk.select(
        F.when(F.col("role") == "system", "global").otherwise(F.col("role")).alias("grp"),
        F.get(names, (F.col("conv_id") % 4).cast("int")).alias("perspective"),
        F.floor(F.col("conv_id") / 4).alias("segment"),
        (F.col("turn") + 1).cast("int").alias("attempt"),
        text.alias("response"),
    )


ANSWERS_SQL = r"""
talk AS (
  SELECT *, regexp_extract_all(lower(text), '[a-z]{2,}') AS ws,
    '0.' || lpad(CAST(conv_id % 90 AS VARCHAR), 2, '0') AS weight
  FROM conversations
),
answers AS (
  SELECT CASE WHEN role = 'system' THEN 'global' ELSE role END AS grp,
    ['theological', 'narrative', 'emotional', 'literary'][conv_id % 4 + 1] AS perspective,
    conv_id // 4 AS segment, CAST(turn + 1 AS INTEGER) AS attempt,
    CASE turn % 5
      WHEN 0 THEN 'Here: [' || coalesce(array_to_string(['["' || x || '", ' || weight || ']' FOR x IN ws], ', '), '') || '] ok'
      WHEN 1 THEN '[["' || coalesce(array_to_string(ws, ''), '') || '", 1.5]]'
      WHEN 2 THEN '[["' || coalesce(array_to_string(ws, '-'), '') || '", 0.5]]'
      WHEN 3 THEN 'no themes [sorry ' || coalesce(array_to_string(ws, ' '), '')
      ELSE '[]' END AS response
  FROM talk
),
parsed AS (SELECT *, regexp_extract(response, '(?s)(\[.*\])', 1) AS js FROM answers),
items AS (
  SELECT grp, perspective, segment, attempt, item,
    json_type(item) = 'ARRAY' AND json_array_length(item) = 2 AND json_type(item, '$[0]') = 'VARCHAR'
      AND length(json_extract_string(item, '$[0]')) >= 2 AND NOT regexp_matches(json_extract_string(item, '$[0]'), '[ -]')
      AND json_type(item, '$[1]') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      AND CAST(json_extract_string(item, '$[1]') AS DOUBLE) BETWEEN 0 AND 1 AS ok
  FROM (SELECT grp, perspective, segment, attempt, unnest(CAST(js AS JSON[])) AS item FROM parsed
        WHERE js <> '' AND json_valid(js))
),
judged AS (
  SELECT p.grp, p.perspective, p.segment, p.attempt, js <> '' AND json_valid(js) AS is_list,
    (js <> '' AND json_valid(js)) AND coalesce(v.ok, true) AS valid
  FROM parsed p LEFT JOIN (SELECT grp, perspective, segment, attempt, bool_and(ok) AS ok FROM items GROUP BY ALL) v
    USING (grp, perspective, segment, attempt)
),
chosen AS (
  SELECT grp, perspective, segment, min(attempt) FILTER (WHERE valid AND attempt <= 10) AS attempt FROM judged GROUP BY ALL
)"""


@query(
    "parse_responses",
    "WITH "
    + ANSWERS_SQL
    + """
    SELECT grp, perspective, segment, attempt,
      CASE WHEN js <> '' AND json_valid(js) THEN CAST(json_array_length(js) AS INTEGER) END AS items FROM parsed""",
)
def _parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_responses(answers(spark, sf))
    return parsed.select("grp", "perspective", "segment", "attempt", F.size("items").alias("items"))


@query("validate_responses", "WITH " + ANSWERS_SQL + " SELECT grp, perspective, segment, attempt, valid FROM judged")
def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return responses.validate_responses(answers(spark, sf)).select("grp", "perspective", "segment", "attempt", "valid")


ANSWER_KEYS = ("grp", "perspective", "segment")


@query(
    "first_valid_attempt",
    "WITH "
    + ANSWERS_SQL
    + """
    SELECT c.grp, c.perspective, c.segment, c.attempt,
      CAST(coalesce((SELECT count(*) FROM items i WHERE i.grp = c.grp AND i.perspective = c.perspective
        AND i.segment = c.segment AND i.attempt = c.attempt), 0) AS INTEGER) AS themes
    FROM chosen c""",
)
def _first_valid(spark: SparkSession, sf: str) -> DataFrame:
    first = responses.first_valid_attempt(responses.validate_responses(answers(spark, sf)), ANSWER_KEYS)
    return first.withColumn("themes", F.size("themes"))


@query(
    "merge_perspectives",
    "WITH "
    + ANSWERS_SQL
    + """,
best AS (
  SELECT grp, lower(json_extract_string(item, '$[0]')) AS word, max(CAST(json_extract_string(item, '$[1]') AS DOUBLE)) AS score
  FROM items JOIN chosen USING (grp, perspective, segment, attempt) GROUP BY ALL
)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, word) AS INTEGER) AS rank, word, score
FROM best QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, word) <= CASE WHEN grp = 'global' THEN 50 ELSE 30 END""",
)
def _merge(spark: SparkSession, sf: str) -> DataFrame:
    first = responses.first_valid_attempt(responses.validate_responses(answers(spark, sf)), ANSWER_KEYS)
    return responses.merge_perspectives(first)


# --- complete maps ----------------------------------------------------------------------------------


def _with_volume(result: theme_maps.ThemeMap) -> DataFrame:
    return result.themes.join(result.volumes.select("grp", "volume"), "grp")


@query("news_theme_map")
def _news(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "content")
    return _with_volume(theme_maps.news_theme_map(docs))


@query("chunk_theme_map")
def _chunk_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "content")
    return _with_volume(theme_maps.chunk_theme_map(docs))


@query("verse_theme_map")
def _verse_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = verse_text(documents(spark, sf)).select("doc_id", "content")
    return _with_volume(theme_maps.verse_theme_map(docs, HEADING))


@query("verse_hierarchy_map")
def _verse_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = verse_text(documents(spark, sf)).select("doc_id", "content")
    return _with_volume(theme_maps.verse_hierarchy_map(docs, HEADING))


@query(
    "response_theme_map",
    "WITH "
    + ANSWERS_SQL
    + """,
best AS (
  SELECT grp, lower(json_extract_string(item, '$[0]')) AS word, max(CAST(json_extract_string(item, '$[1]') AS DOUBLE)) AS score
  FROM items JOIN chosen USING (grp, perspective, segment, attempt) GROUP BY ALL
),
ranked AS (
  SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, word) AS INTEGER) AS rank, word, score FROM best
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, word) <= CASE WHEN grp = 'global' THEN 50 ELSE 30 END
),
counted AS (
  SELECT role AS grp, CAST(sum(len(regexp_extract_all(text, '[^ ]+'))) AS BIGINT) AS volume FROM conversations WHERE role <> 'system' GROUP BY role
),
volumes AS (SELECT * FROM counted UNION ALL SELECT 'global', CAST(sum(volume) AS BIGINT) FROM counted)
SELECT grp, rank, word, score, volume FROM ranked JOIN volumes USING (grp)""",
)
def _response_map(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").where("role <> 'system'")
    docs = talk.select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("category"), "text", F.regexp_count("text", F.lit("[^ ]+")).alias("word_count")
    )
    return _with_volume(theme_maps.response_theme_map(docs, answers(spark, sf)))


@query("category_theme_map")
def _category_map(spark: SparkSession, sf: str) -> DataFrame:
    return _with_volume(theme_maps.category_theme_map(documents(spark, sf)))
