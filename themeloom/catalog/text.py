"""Queries over the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.catalog.base import SPACES_SQL, STOP_SQL, WORDS_SQL, WS_SQL, documents, query, split_words_sql, table
from themeloom.catalog.base import clean_word_sql
from themeloom.functions import text as tx
from themeloom.operators import sections, sentences

HEADING = "BOOK OF [A-Z0-9]+"


# --- inputs derived from the documents --------------------------------------------------------------


def boxed(docs: DataFrame) -> DataFrame:
    """Even documents get a start and an end marker around their text."""
    framed = F.concat(
        F.lit("*** START OF THE PROJECT GUTENBERG x\n"), F.col("content"), F.lit("\n*** END OF THE PROJECT GUTENBERG x")
    )
    return docs.withColumn("content", F.when(F.col("doc_id") % 2 == 0, framed).otherwise(F.col("content")))


BOXED_SQL = """
boxed AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0
    THEN '*** START OF THE PROJECT GUTENBERG x' || chr(10) || text || chr(10) || '*** END OF THE PROJECT GUTENBERG x'
    ELSE text END AS t
  FROM documents
),
found AS (
  SELECT doc_id, t,
    CASE WHEN strpos(t, '*** START OF THIS PROJECT GUTENBERG') > 0 THEN strpos(t, '*** START OF THIS PROJECT GUTENBERG')
         WHEN strpos(t, '*** START OF THE PROJECT GUTENBERG') > 0 THEN strpos(t, '*** START OF THE PROJECT GUTENBERG')
         WHEN strpos(t, 'The Project Gutenberg EBook of') > 0 THEN strpos(t, 'The Project Gutenberg EBook of') END AS s,
    CASE WHEN strpos(t, '*** END OF THIS PROJECT GUTENBERG') > 0 THEN strpos(t, '*** END OF THIS PROJECT GUTENBERG')
         WHEN strpos(t, '*** END OF THE PROJECT GUTENBERG') > 0 THEN strpos(t, '*** END OF THE PROJECT GUTENBERG')
         WHEN strpos(t, 'End of the Project Gutenberg') > 0 THEN strpos(t, 'End of the Project Gutenberg') END AS e
  FROM boxed
),
spans AS (
  SELECT doc_id, t, coalesce(e - 1, length(t)) AS stop,
    CASE WHEN s IS NULL OR strpos(substr(t, s), chr(10)) = 0 THEN 0 ELSE s - 1 + strpos(substr(t, s), chr(10)) END AS skip
  FROM found
),
trimmed AS (SELECT doc_id, substr(t, skip + 1, greatest(stop - skip, 0)) AS content FROM spans)"""


def verse_text(docs: DataFrame) -> DataFrame:
    """The lines of each document as numbered verses under a heading every 40 lines; every fifth line wraps."""
    name = F.concat(F.lit("BOOK OF "), F.upper("category"), F.lit("\n"))

    def line(text: Column, i: Column) -> Column:
        j = i % 40
        number = F.concat((j / 25).cast("int") + 1, F.lit(":"), j % 25 + 1, F.lit(" "))
        head = F.when(j == 0, name).otherwise(F.lit(""))
        return F.concat(head, F.when(i % 5 == 4, F.lit("   ")).otherwise(number), text)

    lines = F.transform(F.split("content", "\n"), line)
    whole = F.concat(
        F.lit("A preface.\nThe Old Testament\n"), F.array_join(lines, "\n"), F.lit("\n*** END OF THE PROJECT x\nlicence")
    )
    return docs.withColumn("content", whole)


UPPER_SQL = "replace(upper({0}), chr(7838), 'SS')"  # capital sharp s, written SS by Spark

VERSES_SQL = rf"""
verse_text AS (
  SELECT doc_id, 'A preface.' || chr(10) || 'The Old Testament' || chr(10) || array_to_string(
    list_transform(string_split(text, chr(10)), lambda l, i:
      (CASE WHEN (i - 1) % 40 = 0 THEN 'BOOK OF ' || upper(source) || chr(10) ELSE '' END)
      || (CASE WHEN (i - 1) % 5 = 4 THEN '   '
          ELSE (((i - 1) % 40) // 25 + 1) || ':' || (((i - 1) % 40) % 25 + 1) || ' ' END) || l), chr(10))
    || chr(10) || '*** END OF THE PROJECT x' || chr(10) || 'licence' AS t
  FROM documents
),
up AS (SELECT doc_id, {UPPER_SQL.format('t')} AS u FROM verse_text),
cut AS (
  SELECT doc_id, u,
    least(nullif(strpos(u, 'THE FIRST BOOK OF MOSES, CALLED GENESIS'), 0), nullif(strpos(u, 'THE OLD TESTAMENT'), 0),
          nullif(strpos(u, 'GENESIS'), 0)) AS s,
    least(nullif(strpos(u, '*** END OF THE PROJECT'), 0), nullif(strpos(u, '*** END OF THIS PROJECT'), 0),
          nullif(strpos(u, 'END OF THE PROJECT GUTENBERG'), 0), nullif(strpos(u, 'THE END OF THE NEW TESTAMENT'), 0)) AS e
  FROM up
),
span AS (
  SELECT doc_id, regexp_replace(
    substr(u, coalesce(s, length(u) + 1), greatest(coalesce(e, length(u) + 1) - coalesce(s, length(u) + 1), 0)),
    '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS content
  FROM cut
)"""

PARTS_SQL = VERSES_SQL + rf""",
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(content, '(?m)^[ \t]*({HEADING})[ \t]*$',
      chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2))) AS p
    FROM span
  )
),
parts AS (
  SELECT * FROM (
    SELECT doc_id, CAST(i AS INTEGER) AS part,
      regexp_replace(split_part(piece, chr(2), 1), '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS heading,
      regexp_replace(split_part(piece, chr(2), 2), '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS body
    FROM pieces
  ) WHERE body <> ''
)"""

CHAPTERS_SQL = PARTS_SQL + rf""",
raw_verses AS (
  SELECT doc_id, part, heading, unnest(v) AS p, generate_subscripts(v, 1) AS i
  FROM (
    SELECT doc_id, part, heading, list_filter(string_split(regexp_replace(body, '\n([0-9]+:[0-9]+)', chr(3) || '\1', 'g'),
      chr(3)), lambda x: regexp_matches(x, '^[0-9]+:[0-9]+')) AS v
    FROM parts
  )
),
verses AS (
  SELECT doc_id, part, heading, i, CAST(regexp_extract(p, '^([0-9]+):', 1) AS INTEGER) AS chapter,
    CAST(regexp_extract(p, '^[0-9]+:([0-9]+)', 1) AS INTEGER) AS verse,
    trim(regexp_replace(regexp_replace(p, '^[0-9]+:[0-9]+', ''), '{WS_SQL}+', ' ', 'g')) AS content
  FROM raw_verses
)"""


# --- normalising and tokenising ---------------------------------------------------------------------


@query(
    "normalize_text",
    rf"""
    SELECT doc_id, array_to_string(list_filter(
      regexp_extract_all(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{SPACES_SQL}]', '', 'g'), '[^{SPACES_SQL}]+'),
      lambda t: t NOT IN ({STOP_SQL})), ' ') AS content
    FROM documents""",
)
def _normalize(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.normalize_text(F.col("content")).alias("content"))


@query(
    "tokenize_words",
    f"""
    SELECT doc_id, token, count(*) AS n
    FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS token FROM documents)
    WHERE length(token) >= 2 GROUP BY doc_id, token""",
)
def _tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.inline(tx.term_counts(tx.tokenize_words(F.col("content")))).alias("token", "n")
    ).withColumn("n", F.col("n").cast("bigint"))


@query(
    "tokenize_alpha",
    f"""
    SELECT doc_id, token, count(*) AS n
    FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS token FROM documents)
    WHERE regexp_matches(token, '^[a-z]+$') GROUP BY doc_id, token""",
)
def _tokenize_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.inline(tx.term_counts(tx.tokenize_alpha(F.col("content")))).alias("token", "n")
    ).withColumn("n", F.col("n").cast("bigint"))


@query(
    "remove_stopwords",
    f"""
    SELECT doc_id, array_to_string(list_filter({WORDS_SQL.format('text')},
      lambda t: length(t) >= 2 AND t NOT IN ({STOP_SQL})), ' ') AS tokens
    FROM documents""",
)
def _remove_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    kept = tx.remove_stopwords(tx.tokenize_words(F.col("content")))
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(
    "clean_theme_word",
    f"""
    SELECT word, cleaned, count(*) AS n
    FROM (SELECT word, {clean_word_sql('word')} AS cleaned FROM (SELECT unnest({split_words_sql('text')}) AS word FROM documents))
    GROUP BY word, cleaned""",
)
def _clean_theme_word(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select(F.explode(tx.split_words(F.col("content"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", tx.clean_theme_word(F.col("word")).alias("cleaned"), "n")


@query("word_count_plain", f"SELECT doc_id, CAST(len({split_words_sql('text')}) AS INTEGER) AS word_count FROM documents")
def _word_count_plain(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.word_count_plain(F.col("content")).alias("word_count"))


@query(
    "word_count_norefs",
    "WITH "
    + VERSES_SQL
    + f"""
    SELECT doc_id, CAST(len({split_words_sql("regexp_replace(t, '[0-9]+:[0-9]+', '', 'g')")}) AS INTEGER) AS word_count
    FROM verse_text""",
)
def _word_count_norefs(spark: SparkSession, sf: str) -> DataFrame:
    return verse_text(documents(spark, sf)).select("doc_id", tx.word_count_norefs(F.col("content")).alias("word_count"))


@query("trim_boilerplate", "WITH " + BOXED_SQL + " SELECT doc_id, content FROM trimmed")
def _trim(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(documents(spark, sf)).select("doc_id", tx.trim_boilerplate(F.col("content")).alias("content"))


@query(
    "collapse_whitespace",
    f"SELECT doc_id, trim(regexp_replace(text, '{WS_SQL}+', ' ', 'g')) AS content FROM documents",
)
def _collapse(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.collapse_whitespace(F.col("content")).alias("content"))


@query("extract_span", "WITH " + VERSES_SQL + " SELECT doc_id, content FROM span")
def _span(spark: SparkSession, sf: str) -> DataFrame:
    return verse_text(documents(spark, sf)).select("doc_id", tx.extract_span(F.col("content")).alias("content"))


# --- sentences and chunks ---------------------------------------------------------------------------

SENTENCES_SQL = rf"""
sentences AS (
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i
  FROM (
    SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(content, '{WS_SQL}+', ' ', 'g')),
      '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS s
    FROM trimmed
  )
)"""


@query(
    "split_sentences",
    "WITH " + BOXED_SQL + "," + SENTENCES_SQL + " SELECT doc_id, CAST(i AS INTEGER) AS position, sentence FROM sentences",
)
def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    parts = boxed(documents(spark, sf)).select(
        "doc_id", F.posexplode(tx.split_sentences(tx.trim_boilerplate(F.col("content")))).alias("pos", "sentence")
    )
    return parts.select("doc_id", (F.col("pos") + 1).alias("position"), "sentence")


STOPS_SQL = rf"""
collapsed AS (SELECT doc_id, trim(regexp_replace(text, '{WS_SQL}+', ' ', 'g')) AS content FROM documents),
stops AS (
  SELECT lower(regexp_replace(token, '\.$', '')) AS word, token LIKE '%.' AS stop
  FROM (SELECT unnest(string_split(content, ' ')) AS token FROM collapsed)
),
stop_counts AS (
  SELECT word, count(*) FILTER (WHERE stop) AS with_stop, count(*) FILTER (WHERE NOT stop) AS without_stop
  FROM stops WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}.]*$') GROUP BY word
),
share AS (SELECT least(sum(with_stop) / sum(with_stop + without_stop), 0.99) AS p FROM stop_counts),
stop_scores AS (
  SELECT word, with_stop, without_stop,
    2 * (with_stop * (ln(0.99) - ln(p)) + without_stop * (ln(1 - 0.99) - ln(1 - p))) * exp(-length(replace(word, '.', '')))
      * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', '')), -without_stop) AS score
  FROM stop_counts, share WHERE with_stop > 0
)"""


@query(
    "abbreviation_scores",
    "WITH " + STOPS_SQL + " SELECT word, with_stop, without_stop, round(score, 6) + 0.0 AS score FROM stop_scores",
)
def _abbreviation_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.abbreviation_scores(documents(spark, sf)).withColumn("score", F.round("score", 6) + 0.0)


@query(
    "abbreviation_sentences",
    "WITH "
    + STOPS_SQL
    + rf""",
known AS (SELECT coalesce(list(word), []) AS words FROM stop_scores WHERE score >= 0.3),
pieces AS (SELECT doc_id, string_split(regexp_replace(content, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS p FROM collapsed),
closed AS (
  SELECT doc_id, list_transform(p, lambda piece, i: piece || CASE WHEN
      list_contains(words, lower(regexp_extract(piece, '([^ ]+)\.$', 1)))
      OR regexp_matches(lower(regexp_extract(piece, '([^ ]+)\.$', 1)), '^[^\p{{L}}]*\p{{L}}$')
      OR regexp_matches(regexp_extract(piece, '([^ ]+)\.$', 1), '^\p{{Nd}}+$') AND coalesce(regexp_matches(p[i + 1], '^\p{{Ll}}'), false)
    THEN ' ' ELSE chr(10) END) AS p
  FROM pieces, known
),
sentences AS (SELECT doc_id, string_split(regexp_replace(array_to_string(p, ''), '[ \n]$', ''), chr(10)) AS s FROM closed)
SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, md5(array_to_string(s, chr(10))) AS hash FROM sentences""",
)
def _abbreviation_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    cut = docs.select("doc_id", sentences.split_sentences_by(F.col("content"), sentences.abbreviations(docs)).alias("s"))
    # The sentences are made once for both columns.
    return cut.select("doc_id", F.inline(F.array(F.struct(F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n").cast("binary")).alias("hash")))))


# One step of the recursion handles sentence i of every document: it closes the running chunk, or not.
CHUNKS_SQL = "WITH RECURSIVE " + BOXED_SQL + "," + SENTENCES_SQL + """,
lens AS (
  SELECT doc_id, i, length(sentence) AS len,
    sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) - length(sentence) AS before
  FROM sentences
),
reach AS (
  SELECT a.doc_id, a.i, any_value(a.len) AS len, any_value(a.before) AS before, min(b.i) AS back
  FROM lens a JOIN lens b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.before - b.before <= 100
  GROUP BY a.doc_id, a.i
),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS first, CAST(NULL AS BIGINT) AS closed
  FROM (SELECT DISTINCT doc_id FROM lens)
  UNION ALL
  SELECT f.doc_id, r.i,
    CASE WHEN r.before - s.before >= 100 AND r.before - s.before + r.len > 1000 THEN greatest(f.first, r.back) ELSE f.first END,
    CASE WHEN r.before - s.before >= 100 AND r.before - s.before + r.len > 1000 THEN f.first END
  FROM fold f
  JOIN reach r ON r.doc_id = f.doc_id AND r.i = f.i + 1
  JOIN reach s ON s.doc_id = f.doc_id AND s.i = f.first
),
ends AS (
  SELECT f.doc_id, f.first, f.i AS last
  FROM fold f
  JOIN (SELECT doc_id, max(i) AS n, sum(len) AS total FROM lens GROUP BY doc_id) t ON t.doc_id = f.doc_id AND t.n = f.i
  JOIN reach s ON s.doc_id = f.doc_id AND s.i = f.first
  WHERE t.total - s.before >= 100
),
spans_of AS (
  SELECT doc_id, closed AS first, i - 1 AS last FROM fold WHERE closed IS NOT NULL
  UNION ALL SELECT doc_id, first, last FROM ends
),
chunks AS (
  SELECT c.doc_id, c.first, c.last, string_agg(s.sentence, ' ' ORDER BY s.i) AS content
  FROM spans_of c JOIN sentences s ON s.doc_id = c.doc_id AND s.i BETWEEN c.first AND c.last
  GROUP BY c.doc_id, c.first, c.last
),
numbered AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY last) AS INTEGER) AS position, content FROM chunks
)"""


@query("chunk_sentences", CHUNKS_SQL + " SELECT doc_id, position, content FROM numbered")
def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    trimmed = boxed(documents(spark, sf)).select("doc_id", tx.trim_boilerplate(F.col("content")).alias("content"))
    return sections.chunk_sentences(trimmed)


@query(
    "number_sections",
    CHUNKS_SQL + " SELECT doc_id, 'Section ' || position AS title, content, position FROM numbered WHERE length(content) >= 100",
)
def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return sections.text_sections(boxed(documents(spark, sf)))


# --- headings, verses, lines ------------------------------------------------------------------------


def parts_of(spark: SparkSession, sf: str) -> DataFrame:
    span = verse_text(documents(spark, sf)).select("doc_id", tx.extract_span(F.col("content")).alias("content"))
    return sections.split_headings(span, HEADING)


@query("split_headings", "WITH " + PARTS_SQL + " SELECT doc_id, part, heading, body FROM parts")
def _headings(spark: SparkSession, sf: str) -> DataFrame:
    return parts_of(spark, sf)


@query(
    "split_chapters",
    "WITH " + CHAPTERS_SQL + " SELECT doc_id, part, heading, chapter, verse, content FROM verses",
)
def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    return sections.split_chapters(parts_of(spark, sf))


@query(
    "verse_sections",
    "WITH "
    + CHAPTERS_SQL
    + """,
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, part, chapter ORDER BY i) - 1 AS k FROM verses
),
grouped AS (
  SELECT doc_id, part, heading, chapter, k // 10 AS win, min(i) AS started, min(k) + 1 AS first, max(k) + 1 AS last,
    coalesce(string_agg(content, ' ' ORDER BY i) FILTER (WHERE content <> ''), '') AS content
  FROM placed GROUP BY doc_id, part, heading, chapter, k // 10
),
ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, part ORDER BY started) AS INTEGER) AS position FROM grouped
)
SELECT doc_id, part, position, heading || ' ' || chapter || ':' || first || '-' || last AS title,
  array_to_string(list_transform(string_split(content, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS content,
  CASE WHEN heading IN ('GENESIS', 'EXODUS') THEN 'OLD_TESTAMENT' ELSE 'NEW_TESTAMENT' END AS category
FROM ordered WHERE content <> ''""",
)
def _verses(spark: SparkSession, sf: str) -> DataFrame:
    return sections.verse_sections(parts_of(spark, sf))


@query(
    "line_windows",
    """
    SELECT doc_id, CAST((i - 1) // 10 AS INTEGER) AS window, CAST(min(i) AS INTEGER) AS first_line,
      CAST(max(i) AS INTEGER) AS last_line, string_agg(line, ' ' ORDER BY i) AS content
    FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
    GROUP BY doc_id, (i - 1) // 10""",
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return sections.line_windows(documents(spark, sf))


@query(
    "categorize_by_lookup",
    """
    SELECT doc_id, source AS heading,
      CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) < 7 THEN 'early' ELSE 'late' END AS category
    FROM documents""",
)
def _categorize(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.col("category").alias("heading"))
    early = (
        table(spark, sf, "documents")
        .select(F.col("source").alias("heading"))
        .where(F.regexp_extract("heading", "[0-9]+", 0).cast("int") < 7)
        .distinct()
        .withColumn("category", F.lit("early"))
    )
    return sections.categorize_by_lookup(docs, early, outside="late").select("doc_id", "heading", "category")


@query(
    "concat_group_text",
    """
    SELECT category, segment, piece, string_agg(text, ' ' ORDER BY doc_id) AS content
    FROM (
      SELECT source AS category, doc_id // 64 AS segment, doc_id, text, CAST(floor(coalesce(sum(length(text)) OVER (
        PARTITION BY source, doc_id // 64 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS INTEGER) AS piece
      FROM documents
    ) GROUP BY category, segment, piece""",
)
def _concat(spark: SparkSession, sf: str) -> DataFrame:
    return sections.concat_group_text(documents(spark, sf), ["category"], most_chars=20_000)
