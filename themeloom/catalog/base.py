"""Registry of named queries over the test tables, each with its SQL for a cross-check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.functions.stopwords import ENGLISH
from themeloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``<doc_id, lang, category, headline, content>``; ``source`` stands in for category and headline."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("source").alias("category"), F.col("source").alias("headline"), F.col("text").alias("content")
    )
    return spread(docs, "doc_id")


# --- SQL fragments ----------------------------------------------------------------------------------

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
# The white-space characters one by one, for a regex engine without the Unicode property.
SPACES_SQL = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_SQL = f"[{SPACES_SQL}]"
WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def split_words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SPACES_SQL}]+')"


# Alphabetic tokens of the documents without stop words.
TOKENS_SQL = rf"""
tok AS (
  SELECT doc_id, lang, source, term
  FROM (SELECT doc_id, lang, source, unnest({WORDS_SQL.format('text')}) AS term FROM documents)
  WHERE regexp_matches(term, '^[a-z]+$') AND term NOT IN ({STOP_SQL})
),
tf AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM tok GROUP BY ALL)"""

MIN_DF, MAX_DF, MAX_FEATURES = 2, 0.95, 20_000

VOCAB_SQL = TOKENS_SQL + f""",
kept AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term
  HAVING count(*) >= {MIN_DF} AND count(*) <= CAST({MAX_DF} AS DOUBLE) * (SELECT count(*) FROM documents)
  ORDER BY sum(tf) DESC, term LIMIT {MAX_FEATURES}
),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, tf,
         ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
  FROM kept
)"""

TFIDF_SQL = VOCAB_SQL + """,
tfidf AS (
  SELECT doc_id, lang, source, term_id, tf, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS tfidf
  FROM (
    SELECT doc_id, lang, source, term_id, term, tf.tf, tf.tf * idf AS v
    FROM tf JOIN vocab USING (term)
  )
)"""

# A topic model that SQL can derive: topics are the languages in alphabetical order, a term's weight
# is its mean TF-IDF in the language, a document's weight the product with its own TF-IDF, and its
# cluster is the number in its source.
MODEL_SQL = TFIDF_SQL + """,
langs AS (
  SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS topic, count(*) AS n
  FROM documents GROUP BY lang
),
h AS (
  SELECT topic, term_id, sum(tfidf) / max(n) AS weight
  FROM tfidf JOIN langs USING (lang) GROUP BY topic, term_id
),
labels AS (SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS cluster FROM documents),
mass AS (
  SELECT doc_id, topic, sum(tfidf * weight) AS weight FROM tfidf JOIN h USING (term_id) GROUP BY doc_id, topic
),
w AS (
  SELECT d.doc_id, l.topic, coalesce(m.weight, 0) AS weight, c.cluster
  FROM documents d CROSS JOIN (SELECT DISTINCT topic FROM langs) l
  JOIN labels c ON c.doc_id = d.doc_id
  LEFT JOIN mass m ON m.doc_id = d.doc_id AND m.topic = l.topic
),
ranked_words AS (
  SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(weight, 10) DESC, term) AS INTEGER) AS rank,
         term_id, term AS word, weight
  FROM h JOIN vocab USING (term_id)
),
means AS (SELECT cluster, topic, avg(weight) AS importance FROM w GROUP BY cluster, topic)"""


def clean_word_sql(word: str) -> str:
    letters = f"regexp_replace(lower({word}), '[^a-zA-Z]', '', 'g')"
    return (
        f"CASE WHEN length({letters}) >= 3 AND {letters} NOT IN "
        f"('one','two','three','four','five','six','seven') THEN {letters} END"
    )


CLUSTER_THEMES_SQL = MODEL_SQL + f""",
themes AS (
  SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(score, 10) DESC, word) AS INTEGER) AS rank,
         word, score
  FROM (
    SELECT cluster, word, max(score) AS score
    FROM (
      SELECT cluster, {clean_word_sql('word')} AS word, importance * weight AS score
      FROM means JOIN ranked_words USING (topic) WHERE rank <= 10
    ) WHERE word IS NOT NULL GROUP BY cluster, word
  )
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(score, 10) DESC, word) <= 50
),
volumes AS (SELECT cluster, count(*) AS volume FROM labels GROUP BY cluster),
biggest AS (SELECT cluster AS g FROM volumes ORDER BY volume DESC, cluster LIMIT 1),
theme_map AS (
  SELECT CASE WHEN cluster = g THEN 'global' ELSE 'c' || (cluster + 1) END AS grp, rank, word, score, volume
  FROM themes JOIN volumes USING (cluster), biggest
)"""
