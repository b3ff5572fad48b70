"""DuckDB SQL for the rows of the queries whose results SQL can say in full."""

from __future__ import annotations

EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
),
reach(i, j) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i
),
smallest AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
counted AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest ON smallest.i = vec_id LEFT JOIN counted ON counted.i = vec_id
"""


def _folded(text: str) -> str:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {_folded('text')} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_folded('text')} AS ws FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM items WHERE len(ws) > 0)
),
windows AS (
  SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM phrases))
),
found AS (SELECT doc_id, i, w.size, item FROM windows w JOIN phrases p ON p.size = w.size AND p.phrase = w.phrase),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS span
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)
),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY span) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS rest, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

# The crc32 of the id, bit by bit; 3988292384 is its polynomial.
PERIODIC_RUNS = r"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(
    [CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  )) AS h
  FROM documents
),
sized AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM given),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws
  FROM sized
),
words AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM docs),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
numbered AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM numbered GROUP BY doc_id, q, island HAVING count(*) >= 3 * q
),
runs AS (
  SELECT doc_id, q, s, e FROM stretches r WHERE e - s >= 6 AND NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.e >= r.e
  )
),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
    min([s - e, s, q]) AS best
  FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, (1000 * -best[1]) // best[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _terms(table: str, key: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM {table}"


RANKED_SEARCH = f"""
WITH docs AS ({_terms('documents', 'doc_id')}),
items AS (SELECT DISTINCT item_id, unnest(ws) AS term FROM ({_terms('benchmark', 'item_id')})),
totals AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM docs WHERE len(ws) > 0),
counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term
),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

# The forests hold all rows of a table of up to some thousands below the prefixes that are reached, so that the result is exact there.
PREFIX_FOREST = """
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i]), lambda total, p: total + p) AS score
  FROM vectors q JOIN vectors v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
