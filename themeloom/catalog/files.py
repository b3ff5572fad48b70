"""Queries over sources, sinks, checks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom import schemas
from themeloom.catalog.base import CLUSTER_THEMES_SQL, TOKENS_SQL, WS_SQL, documents, query, split_words_sql, table
from themeloom.catalog.model import stand_in, tokenized
from themeloom.functions import text as tx
from themeloom.catalog.text import HEADING
from themeloom.operators import chart, features, lines, quality, stats, themes
from themeloom.session import staging_path
from themeloom.sources import checks, manifest, readers, theme_files

# --- files: the tables are written by Spark first, then scanned -------------------------------------


@query(
    "scan_tsv",
    f"""
    SELECT doc_id, source AS category, source AS headline, trim(regexp_replace(text, '{WS_SQL}+', ' ', 'g')) AS content
    FROM documents""",
)
def _tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "tsv")
    flat = documents(spark, sf).select("doc_id", "category", "headline", tx.collapse_whitespace(F.col("content")).alias("content"))
    flat.write.option("sep", "\t").option("header", True).option("escape", '"').csv(path)
    return readers.scan_tsv(spark, path)


@query("scan_csv", "SELECT doc_id, source AS category, source AS headline, text AS content FROM documents")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "csv")
    rows = documents(spark, sf).select("doc_id", "category", "headline", "content")
    (
        rows.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return readers.scan_csv(spark, path)


@query(
    "scan_wholetext",
    """
    SELECT source, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""",
)
def _wholetext(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "texts")
    # Folders with a space and a plus sign in their names, and files of equal names in them.
    documents(spark, sf).select("content", F.concat(F.lit("a + b "), "category").alias("folder")).write.partitionBy("folder").text(path)
    files = readers.scan_wholetext(spark, path)
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    return files.groupBy(F.regexp_extract("source", r"^folder=a \+ b ([^/]+)/part-", 1).alias("source")).agg(
        F.sum(F.size(lines)).cast("bigint").alias("lines"),
        F.sum(F.aggregate(lines, F.lit(0), lambda a, s: a + F.length(s))).cast("bigint").alias("chars"),
    )


def _books(spark: SparkSession, sf: str, content: Column) -> str:
    """One file per source with the lines of its documents in the order of their ids."""
    path = staging_path(spark, "books")
    rows = documents(spark, sf).select("doc_id", "category", content.alias("value"))
    dealt = rows.repartition("category").sortWithinPartitions("category", "doc_id")
    dealt.select("category", "value").write.partitionBy("category").text(path)
    return path


def _without_file(lines: DataFrame) -> DataFrame:
    return lines.withColumn("source", F.regexp_extract("source", "^category=([^/]+)/part-", 1))


@query(
    "scan_lines",
    """
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line, text
    FROM (
      SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents
    )""",
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _without_file(readers.scan_lines(spark, _books(spark, sf, F.col("content"))))


@query(
    "headed_lines",
    """
    SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS part, 'BOOK OF ' || doc_id AS heading,
      CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, length(text) AS chars
    FROM documents""",
)
def _headed_lines(spark: SparkSession, sf: str) -> DataFrame:
    headed = F.concat(F.lit("BOOK OF "), F.col("doc_id"), F.lit("\n"), F.col("content"))
    found = _without_file(readers.scan_lines(spark, _books(spark, sf, headed)))
    return lines.part_sizes(lines.headed_lines(lines.trim_lines(found), HEADING))


@query(
    "line_sentences",
    f"""
    WITH books AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY source),
    cut AS (
      SELECT source, unnest(s) AS text, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sentence
      FROM (SELECT source, string_split(regexp_replace(trim(regexp_replace(content, '{WS_SQL}+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS s FROM books)
    )
    SELECT source, sentence, md5(text) AS hash FROM cut WHERE text <> ''""",
)
def _line_sentences(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.line_sentences(_without_file(readers.scan_lines(spark, _books(spark, sf, F.col("content")))))
    return found.select("source", "sentence", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("chunk_lines")
def _chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.chunk_lines(lines.line_sentences(_without_file(readers.scan_lines(spark, _books(spark, sf, F.col("content"))))))


SUMMARY_SQL = "WITH " + TOKENS_SQL + """,
counted AS (SELECT term AS word, CAST(sum(tf) AS BIGINT) AS frequency FROM tf GROUP BY term)
"""
CLUSTER_SUMMARY_SQL = "WITH " + TOKENS_SQL + """,
counted AS (
  SELECT CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS cluster, term AS word, CAST(sum(tf) AS BIGINT) AS frequency
  FROM tf GROUP BY ALL
),
ranked AS (
  SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, word) AS INTEGER) AS rank, word, frequency
  FROM counted QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, word) <= 50
)"""


@query("scan_summary", CLUSTER_SUMMARY_SQL + " SELECT CAST(cluster AS VARCHAR) AS cluster, word, frequency FROM ranked")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "summary")
    summary = _cluster_summary(spark, sf).select(F.col("cluster").cast("string").alias("cluster"), "word", "frequency")
    summary.write.option("header", True).csv(path)
    return readers.scan_summary(spark, path, by_cluster=True)


@query(
    "global_word_summary",
    SUMMARY_SQL
    + """
    SELECT CAST(row_number() OVER (ORDER BY frequency DESC, word) AS INTEGER) AS rank, word, frequency
    FROM counted ORDER BY frequency DESC, word LIMIT 50""",
)
def _global_summary(spark: SparkSession, sf: str) -> DataFrame:
    return themes.word_summary(tokenized(documents(spark, sf)))


@query("cluster_word_summary", CLUSTER_SUMMARY_SQL + " SELECT cluster, rank, word, frequency FROM ranked")
def _cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokenized(documents(spark, sf)).withColumn("cluster", F.regexp_extract("category", "[0-9]+", 0).cast("int"))
    return themes.word_summary(docs, by="cluster")


@query(
    "log_frequency",
    SUMMARY_SQL
    + """
    SELECT word, frequency, round(ln(frequency) * 10, 6) AS size FROM counted ORDER BY frequency DESC, word LIMIT 50""",
)
def _log_frequency(spark: SparkSession, sf: str) -> DataFrame:
    sized = chart.log_frequency(_global_summary(spark, sf))
    return sized.select("word", "frequency", F.round("size", 6).alias("size"))


# --- broken lines -----------------------------------------------------------------------------------

# Every seventh document has a field too many, every eleventh an id that is no number.
PLAIN_SQL = f"trim(regexp_replace(regexp_replace(text, '[\"\\\\]', '', 'g'), '{WS_SQL}+', ' ', 'g'))"


def _broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "broken")
    docs = documents(spark, sf)
    plain = tx.collapse_whitespace(F.regexp_replace("content", r'["\\]', ""))
    lines = docs.select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        "category",
        "headline",
        F.when(F.col("doc_id") % 7 == 0, F.concat(plain, F.lit("\tmore"))).otherwise(plain).alias("content"),
    )
    lines.write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    return readers.scan_checked(spark, path, schemas.DOCUMENTS, "\t")


@query("scan_accepted", f"SELECT doc_id, source AS category, md5({PLAIN_SQL}) AS content FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    good = readers.accepted(_broken_lines(spark, sf))
    return good.select("doc_id", "category", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("content"))


@query(
    "scan_rejected",
    """
    SELECT CASE WHEN doc_id % 7 = 0 THEN 'too many fields' ELSE 'value of another type' END AS reject_reason, count(*) AS records
    FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 GROUP BY ALL""",
)
def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _broken_lines(spark, sf).where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("records"))


# --- manifests --------------------------------------------------------------------------------------

MANIFEST_SQL = """
old AS (
  SELECT url AS source, CASE WHEN page_id % 5 = 0 THEN md5('stale' || html) ELSE md5(html) END AS content_hash,
         TIMESTAMP '2020-01-01 00:00:00' AS last_updated
  FROM pages WHERE page_id % 7 <> 0
),
changed AS (
  SELECT url AS source, md5(html) AS content_hash FROM pages p
  WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source = p.url AND o.content_hash = md5(p.html))
)"""


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf, "pages")
    texts = pages.select(F.col("url").alias("source"), F.col("html").alias("text"))
    stale = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("stale"), "html")).otherwise(F.col("html"))
    old = pages.where("page_id % 7 <> 0").select(
        F.col("url").alias("source"),
        F.md5(stale.cast("binary")).alias("content_hash"),
        F.lit("2020-01-01 00:00:00").cast("timestamp").alias("last_updated"),
    )
    return texts, old


@query("refresh_changed", "WITH " + MANIFEST_SQL + " SELECT source, content_hash FROM changed")
def _refresh(spark: SparkSession, sf: str) -> DataFrame:
    texts, old = _manifest(spark, sf)
    return manifest.refresh_changed(texts, old).select("source", "content_hash")


@query(
    "current_texts",
    "WITH "
    + MANIFEST_SQL
    + """
    SELECT source, md5(CASE WHEN source IN (SELECT source FROM changed) THEN html ELSE 'cached ' || html END) AS content
    FROM (SELECT url AS source, html FROM pages)""",
)
def _current(spark: SparkSession, sf: str) -> DataFrame:
    texts, old = _manifest(spark, sf)
    cached = texts.withColumn("text", F.concat(F.lit("cached "), "text"))
    now = manifest.current_texts(cached, manifest.refresh_changed(texts, old))
    return now.select("source", F.md5(F.col("text").cast("binary")).alias("content"))


@query(
    "manifest_upsert",
    "WITH "
    + MANIFEST_SQL
    + """
    SELECT source, content_hash, strftime(last_updated, '%Y-%m-%d') AS updated FROM old
    WHERE source NOT IN (SELECT source FROM changed)
    UNION ALL SELECT source, content_hash, '2024-05-06' FROM changed""",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    texts, old = _manifest(spark, sf)
    merged = manifest.manifest_upsert(old, manifest.refresh_changed(texts, old), F.lit("2024-05-06 00:00:00"))
    return merged.select("source", "content_hash", F.date_format("last_updated", "yyyy-MM-dd").alias("updated"))


@query(
    "source_id",
    r"""
    SELECT page_id, coalesce(
      CASE WHEN page_id % 2 = 0 THEN nullif(regexp_extract('/data/' || page_id || '_page.final.html', '([^/]+?)(\.[^./]*)?$', 1), '') END,
      substr(md5(url), 1, 10)) AS source_id
    FROM pages""",
)
def _source_id(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(
        F.col("page_id") % 2 == 0, F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("_page.final.html"))
    )
    return table(spark, sf, "pages").select("page_id", tx.source_id(path, F.col("url")).alias("source_id"))


# --- theme files ------------------------------------------------------------------------------------


def theme_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    model = stand_in(spark, sf)
    ranked = themes.cluster_themes_weighted(model.points, model.words(10))
    mapped = themes.theme_map(ranked, quality.cluster_volumes(model.points))
    return mapped.select("grp", "rank", "word", "score"), themes.named_volumes(model.points), model.points


@query(
    "themes_export_json",
    "WITH "
    + CLUSTER_THEMES_SQL
    + """
    SELECT grp, '"' || grp || '": [' || string_agg('["' || word || '", ' || CAST(CAST(round(score, 6) AS DECIMAL(38, 6)) AS VARCHAR) || ']',
      ', ' ORDER BY rank) || ']' AS line
    FROM theme_map GROUP BY grp""",
)
def _themes_export(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    path = staging_path(spark, "themes-json")
    theme_files.themes_export_json(mapped, path, digits=6)
    # Read the written object back line by line: one line per group, in file order.
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\{|,$|\}$", "").alias("line"))
    return lines.select(F.regexp_extract("line", r'^"([^"]+)"', 1).alias("grp"), "line")


@query(
    "volumes_export_json",
    "WITH "
    + CLUSTER_THEMES_SQL
    + """
    SELECT CASE WHEN cluster = g THEN 'global' ELSE 'c' || (cluster + 1) END AS grp, volume FROM volumes, biggest""",
)
def _volumes_export(spark: SparkSession, sf: str) -> DataFrame:
    _, volumes, _ = theme_tables(spark, sf)
    path = staging_path(spark, "volumes-json")
    theme_files.volumes_export_json(volumes, path, scalar=True)
    return theme_files.volumes_import_json(spark, path).select("grp", "volume")


@query(
    "themes_import_json",
    "WITH " + CLUSTER_THEMES_SQL + " SELECT grp, rank, word, round(score, 6) AS score FROM theme_map",
)
def _themes_import(spark: SparkSession, sf: str) -> DataFrame:
    mapped, _, _ = theme_tables(spark, sf)
    path = staging_path(spark, "themes-json")
    theme_files.themes_export_json(mapped, path)
    back = theme_files.themes_import_json(spark, path)
    return back.select("grp", "rank", "word", F.round("score", 6).alias("score"))


@query(
    "labelled_sections",
    """
    SELECT doc_id, 'Section ' || (doc_id + 1) AS title, text AS content, CAST(doc_id + 1 AS INTEGER) AS position,
      CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS cluster
    FROM documents""",
)
def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    parts = docs.select(
        "doc_id",
        F.concat(F.lit("Section "), (F.col("doc_id") + 1).cast("string")).alias("title"),
        "content",
        (F.col("doc_id") + 1).cast("int").alias("position"),
    )
    labels = docs.select("doc_id", F.regexp_extract("category", "[0-9]+", 0).cast("int").alias("cluster"))
    return theme_files.labelled_sections(parts, labels)


# --- checks -----------------------------------------------------------------------------------------


def gappy(docs: DataFrame) -> DataFrame:
    """Null content in every eleventh document, blank in every thirteenth."""
    return docs.withColumn(
        "content",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("content")),
    )


GAPPY_SQL = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' ' ELSE text END"
PREPARED_SQL = f"""
prepared AS (
  SELECT * FROM (
    SELECT doc_id, source AS category, coalesce({GAPPY_SQL}, '') AS content,
      CAST(len({split_words_sql(f"regexp_replace(coalesce({GAPPY_SQL}, ''), '[0-9]+:[0-9]+', '', 'g')")}) AS INTEGER) AS word_count
    FROM documents
  ) WHERE word_count > 0
)"""


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return checks.prepare_documents(gappy(documents(spark, sf)))


@query("require_columns", "SELECT doc_id, source AS category, source AS headline FROM documents")
def _require_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = checks.require_columns(documents(spark, sf), ["category", "headline", "content"])
    return docs.select("doc_id", "category", "headline")


@query("require_nonempty", "SELECT count(*) AS documents FROM documents")
def _require_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return checks.require_nonempty(documents(spark, sf)).agg(F.count("*").alias("documents"))


@query("prepare_documents", "WITH " + PREPARED_SQL + " SELECT doc_id, category, content, word_count FROM prepared")
def _prepare(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).select("doc_id", "category", "content", "word_count")


@query(
    "split_rejects",
    f"""
    SELECT doc_id, CASE WHEN c IS NULL THEN 'null content' WHEN trim(c) = '' THEN 'blank content' END AS reject_reason
    FROM (SELECT doc_id, {GAPPY_SQL} AS c FROM documents)""",
)
def _rejects(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"null content": F.col("content").isNull(), "blank content": F.trim("content") == ""}
    return checks.split_rejects(gappy(documents(spark, sf)), rules).select("doc_id", "reject_reason")


@query("group_slice", "SELECT doc_id, lang, text AS content FROM documents WHERE lang = 'fr'")
def _slice(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    return themes.group_slice(docs, "lang", "fr")


@query("distinct_categories", "SELECT source AS category, min(doc_id) AS first_doc FROM documents GROUP BY source")
def _categories(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"))
    return themes.distinct_categories(docs)


# --- statistics -------------------------------------------------------------------------------------


@query(
    "corpus_stats",
    "WITH "
    + PREPARED_SQL
    + """
    SELECT count(*) AS documents, CAST(sum(word_count) AS BIGINT) AS total_words, count(DISTINCT category) AS categories,
      round(avg(word_count), 6) AS avg_words
    FROM prepared""",
)
def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return features.corpus_stats(prepared(spark, sf)).withColumn("avg_words", F.round("avg_words", 6))


@query(
    "words_by_category",
    "WITH " + PREPARED_SQL + " SELECT category, CAST(sum(word_count) AS BIGINT) AS total_words FROM prepared GROUP BY category",
)
def _words_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return stats.words_by_category(prepared(spark, sf))


@query(
    "category_report",
    "WITH "
    + PREPARED_SQL
    + f""",
tokens AS (SELECT category, unnest({split_words_sql('content')}) AS token FROM prepared),
counted AS (SELECT category, token, count(*) AS n FROM tokens GROUP BY ALL),
common AS (
  SELECT category, string_agg(token || '=' || n, ' ' ORDER BY token) AS most_common FROM (
    SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, token) <= 10
  ) GROUP BY category
)
SELECT category, CAST(sum(word_count) AS BIGINT) AS word_count, count(*) AS verse_count, round(avg(word_count), 6) AS avg_words_per_verse,
  any_value(u.unique_words) AS unique_words, any_value(common.most_common) AS most_common
FROM prepared JOIN (SELECT category, count(*) AS unique_words FROM counted GROUP BY category) u USING (category) JOIN common USING (category)
GROUP BY category""",
)
def _report(spark: SparkSession, sf: str) -> DataFrame:
    report = stats.category_report(prepared(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("most_common_words")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return report.select(
        "category", "word_count", "verse_count", F.round("avg_words_per_verse", 6).alias("avg_words_per_verse"), "unique_words", F.array_join(entries, " ").alias("most_common")
    )


@query(
    "category_share",
    "WITH "
    + PREPARED_SQL
    + """
    SELECT category, CAST(sum(word_count) AS BIGINT) AS total_words,
      round(CAST(sum(word_count) AS DOUBLE) / (SELECT sum(word_count) FROM prepared) * 100, 6) AS share
    FROM prepared GROUP BY category""",
)
def _share(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_share(prepared(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "category_metrics",
    "WITH "
    + PREPARED_SQL
    + """
    SELECT category, CAST(sum(word_count) AS BIGINT) AS word_count, count(*) AS verse_count,
      round(avg(word_count), 6) AS avg_words_per_verse
    FROM prepared GROUP BY category""",
)
def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_metrics(prepared(spark, sf)).withColumn("avg_words_per_verse", F.round("avg_words_per_verse", 6))


CATEGORY_TOKENS_SQL = PREPARED_SQL + f""",
counted AS (
  SELECT category, token, count(*) AS n
  FROM (SELECT category, unnest({split_words_sql('content')}) AS token FROM prepared) GROUP BY category, token
)"""


@query(
    "category_unique_words",
    "WITH " + CATEGORY_TOKENS_SQL + " SELECT category, count(*) AS unique_words FROM counted GROUP BY category",
)
def _unique(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_unique_words(prepared(spark, sf))


@query(
    "category_common_words",
    "WITH "
    + CATEGORY_TOKENS_SQL
    + """
    SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS INTEGER) AS rank, token, n
    FROM counted QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, token) <= 10""",
)
def _common(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_common_words(prepared(spark, sf))


@query(
    "volumes_grouping_sets",
    "WITH "
    + PREPARED_SQL
    + """
    SELECT CASE WHEN grouping(category) = 1 THEN 'global' ELSE category END AS grp,
      CAST(sum(word_count) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS documents
    FROM prepared GROUP BY GROUPING SETS ((), (category))""",
)
def _grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.volumes_grouping_sets(prepared(spark, sf))
