"""Documents to sections: chunks of sentences, headed parts, verses and line windows.

Every splitter works inside its row and then explodes, so none of them shuffles. Only
:func:`concat_group_text` groups rows, and its groups are bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.functions.text import SPACES, let, positions, split_sentences, trim_boilerplate
from themeloom.operators.sentences import split_sentences_by

# Headings that count as the first of two categories; all others are the second.
OLD_TESTAMENT = (
    "GENESIS", "EXODUS", "LEVITICUS", "NUMBERS", "DEUTERONOMY", "JOSHUA", "JUDGES", "RUTH", "1 SAMUEL",
    "2 SAMUEL", "1 KINGS", "2 KINGS", "1 CHRONICLES", "2 CHRONICLES", "EZRA", "NEHEMIAH", "ESTHER", "JOB",
    "PSALMS", "PROVERBS", "ECCLESIASTES", "SONG OF SOLOMON", "ISAIAH", "JEREMIAH", "LAMENTATIONS", "EZEKIEL",
    "DANIEL", "HOSEA", "JOEL", "AMOS", "OBADIAH", "JONAH", "MICAH", "NAHUM", "HABAKKUK", "ZEPHANIAH", "HAGGAI",
    "ZECHARIAH", "MALACHI",
)

SPANS = "array<struct<first:int,n:int>>"


def _chunk_cuts(lens: np.ndarray, ends: np.ndarray, chunk_size: int, overlap: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and document of every chunk, for documents laid one after the other.

    A chunk that closes before sentence c is followed by one that starts where the overlap reaches back to, so the next cut is a function of c
    alone. The cuts of all documents are the places that the function reaches from their first ones; they are found by squaring the
    function, in as many rounds as the logarithm of the most cuts, not chunk by chunk.
    """
    n = np.diff(ends)
    docs = len(n)
    # Each document has a place before every sentence and one behind the last.
    first, last = ends[:-1] + np.arange(docs), ends[1:] + np.arange(docs)
    own = np.repeat(np.arange(docs), n + 1)
    total = np.concatenate([[0], np.cumsum(lens)])[np.arange(len(own)) - own] - np.concatenate([[0], np.cumsum(lens)])[ends[:-1]][own]
    # Documents are kept apart in one sorted array by a distance that no search crosses.
    apart = int(total.max(initial=0)) + chunk_size + overlap + least + 1
    keys = total + 2 * apart * own
    reach = np.searchsorted(keys, keys - overlap, side="left")
    enough = np.searchsorted(keys, keys + least, side="left")
    over = np.searchsorted(keys, keys + chunk_size, side="right") - 1
    begin = np.minimum(np.maximum(enough, over), last[own])
    follow = np.minimum(np.maximum(begin[reach], np.arange(len(own)) + 1), last[own])
    cut = np.zeros(len(own), bool)
    cut[begin[first]] = True
    steps, hops = [follow], 1
    while hops < int(n.max(initial=0)) + 1:
        steps.append(steps[-1][steps[-1]])
        hops *= 2
    for hop in reversed(steps):
        cut[hop[np.flatnonzero(cut)]] = True
    cut[last] = False
    cuts = np.flatnonzero(cut)
    # The end of each document closes what is left over, if that is long enough.
    closes = np.sort(np.concatenate([cuts, last]))
    doc = own[closes]
    before = np.concatenate([[-1], closes[:-1]])
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    start = np.where(fresh, first[doc], reach[before])
    kept = (closes != last[doc]) | ((n[doc] > 0) & (total[closes] - total[start] >= least))
    return (start - first[doc])[kept], (closes - start)[kept], doc[kept]


def chunk_spans(lengths: Column, chunk_size: int, overlap: int, min_chunk_size: int) -> Column:
    """Sentence ranges of the overlapping chunks of one document.

    Every cut depends on the one before, which no built-in expression does well. The search needs only the sentence lengths, a batch
    of documents at a time, so the text itself stays in the JVM.
    """

    @F.arrow_udf(SPANS)
    def spans(batch: pa.Array) -> pa.Array:
        ends = batch.offsets.to_numpy().astype(np.int64)
        lens = batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first, size, doc = _chunk_cuts(lens, ends - ends[0], chunk_size, overlap, min_chunk_size)
        fields = [pa.array(first, pa.int32()), pa.array(size, pa.int32())]
        counts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(batch)))])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "n"]))

    return spans(lengths)


def chunk_sentences(
    docs: DataFrame, chunk_size: int = 1000, overlap: int = 100, min_chunk_size: int = 100, abbreviations: Sequence[str] | None = None
) -> DataFrame:
    """``<doc_id, position, content>``: overlapping chunks of whole sentences.

    A chunk closes when the next sentence would pass ``chunk_size`` and it already holds
    ``min_chunk_size`` characters; the next one starts with the trailing sentences that fit in
    ``overlap``. Lengths leave out the joining spaces. With ``abbreviations``, full stops that belong to a word end no
    sentence (:func:`operators.sentences.split_sentences_by`). A document is worked on in its row; books larger than that go through
    :func:`operators.lines.chunk_lines`.
    """
    text = F.col("content")
    cut = split_sentences(text) if abbreviations is None else split_sentences_by(text, abbreviations)
    sentences = docs.select("doc_id", cut.alias("sentences"))
    lengths = F.transform("sentences", lambda s: F.length(s))
    cut = sentences.withColumn("spans", chunk_spans(lengths, chunk_size, overlap, min_chunk_size))
    # Chunks are joined before the explode: exploding the spans would copy the whole document to each of them.
    chunks = F.transform(
        "spans", lambda s: F.array_join(F.slice("sentences", s["first"] + 1, s["n"]), " ")
    )
    return cut.select("doc_id", F.posexplode(chunks).alias("pos", "content")).select(
        "doc_id", (F.col("pos") + 1).alias("position"), "content"
    )


def number_sections(chunks: DataFrame, min_size: int = 100) -> DataFrame:
    """``<doc_id, title, content, position>`` with titles "Section 1", "Section 2", ..."""
    return chunks.where(F.length("content") >= min_size).select(
        "doc_id",
        F.concat(F.lit("Section "), F.col("position").cast("string")).alias("title"),
        "content",
        "position",
    )


def text_sections(
    docs: DataFrame, chunk_size: int = 1000, overlap: int = 100, min_chunk_size: int = 100
) -> DataFrame:
    """Boilerplate trim, sentence split, overlapping chunks and numbering in one narrow plan."""
    trimmed = docs.select("doc_id", trim_boilerplate(F.col("content")).alias("content"))
    return number_sections(chunk_sentences(trimmed, chunk_size, overlap, min_chunk_size), min_chunk_size)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def split_headings(docs: DataFrame, heading: str) -> DataFrame:
    """``<doc_id, part, heading, body>``: one row per headed part; parts without a body are dropped.

    ``heading`` is a pattern without capturing groups that must fill a whole line.
    """
    marked = F.regexp_replace("content", rf"(?m)^[ \t]*({heading})[ \t]*$", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    return (
        docs.select("doc_id", F.posexplode(parts).alias("pos", "piece"))
        .select(
            "doc_id",
            (F.col("pos") + 1).alias("part"),
            _trimmed(F.substring_index("piece", "\u0002", 1)).alias("heading"),
            _trimmed(F.substring_index("piece", "\u0002", -1)).alias("body"),
        )
        .where("body <> ''")
    )


def verses_of(body: Column) -> Column:
    """``array<struct<chapter, verse, content>>`` in text order.

    A verse starts at a line that begins with ``chapter:verse``; the lines it wraps onto are joined to it
    and the reference is removed. Text before the first reference belongs to no verse.
    """
    pieces = F.filter(
        F.split(body, r"\n(?=\p{Nd}+:\p{Nd}+)"), lambda p: F.rlike(p, F.lit(r"^\p{Nd}+:\p{Nd}+"))
    )
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\p{Nd}+):", 1).cast("int").alias("chapter"),
            F.regexp_extract(p, r"^\p{Nd}+:(\p{Nd}+)", 1).cast("int").alias("verse"),
            F.trim(
                F.regexp_replace(F.regexp_replace(p, r"^\p{Nd}+:\p{Nd}+", ""), f"[{SPACES}]+", " ")
            ).alias("content"),
        ),
    )


def split_chapters(parts: DataFrame) -> DataFrame:
    """``<doc_id, part, heading, chapter, verse, content>``: one row per verse of each headed part."""
    return parts.select("doc_id", "part", "heading", F.inline(verses_of(F.col("body"))))


def line_windows(docs: DataFrame, size: int = 10) -> DataFrame:
    """``<doc_id, window, first_line, last_line, content>``: consecutive lines in groups of ``size``."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        return F.transform(
            positions(F.ceil(n / F.lit(size)).cast("int")),
            lambda w: F.struct(
                w.alias("window"),
                (w * size + 1).alias("first_line"),
                F.least(w * size + size, n).alias("last_line"),
                F.array_join(F.slice(lines, w * size + 1, F.lit(size)), " ").alias("content"),
            ),
        )

    return docs.select("doc_id", F.inline(let(F.split("content", "\n"), cut)))


def verse_sections(parts: DataFrame, size: int = 10, lookup: DataFrame | None = None) -> DataFrame:
    """``<doc_id, part, position, title, content, category>``: ``size`` verses of one chapter per section.

    The title is ``heading chapter:first-last`` with verse positions counted inside the chapter.
    """

    def windows(verses: Column) -> Column:
        starts = F.filter(
            positions(F.size(verses)),
            lambda i: (i == 0) | (F.get(verses, i)["chapter"] != F.get(verses, i - 1)["chapter"]),
        )
        return let(
            starts,
            lambda st: F.flatten(
                F.transform(
                    st,
                    lambda p, j: let(
                        F.coalesce(F.get(st, j + 1), F.size(verses)) - p,
                        lambda n: F.transform(
                            positions(F.ceil(n / F.lit(size)).cast("int")),
                            lambda w: F.struct(
                                F.get(verses, p)["chapter"].alias("chapter"),
                                (w * size + 1).alias("first"),
                                F.least(w * size + size, n).alias("last"),
                                F.array_join(
                                    F.filter(
                                        F.transform(
                                            F.slice(verses, p + w * size + 1, F.least(F.lit(size), n - w * size)),
                                            lambda v: v["content"],
                                        ),
                                        lambda c: c != "",
                                    ),
                                    " ",
                                ).alias("content"),
                            ),
                        ),
                    ),
                )
            ),
        )

    sections = (
        parts.select(
            "doc_id", "part", "heading", F.posexplode(let(verses_of(F.col("body")), windows)).alias("pos", "s")
        )
        .where("s.content <> ''")
        .select(
            "doc_id",
            "part",
            (F.col("pos") + 1).alias("position"),
            "heading",
            F.format_string("%s %d:%d-%d", "heading", "s.chapter", "s.first", "s.last").alias("title"),
            F.initcap("s.content").alias("content"),
        )
    )
    return categorize_by_lookup(sections, lookup).drop("heading")


def categorize_by_lookup(
    df: DataFrame,
    lookup: DataFrame | None = None,
    members: Iterable[str] = OLD_TESTAMENT,
    inside: str = "OLD_TESTAMENT",
    outside: str = "NEW_TESTAMENT",
) -> DataFrame:
    """Add ``category`` from ``lookup <heading, category>``, or from membership in a fixed list.

    The join carries no hint: Spark broadcasts the lookup table when its size allows it and shuffles
    otherwise.
    """
    if lookup is None:
        return df.withColumn("category", F.when(F.col("heading").isin(*members), inside).otherwise(outside))
    named = lookup.select("heading", F.col("category").alias("_category"))
    return df.join(named, "heading", "left").select(
        *df.columns, F.coalesce("_category", F.lit(outside)).alias("category")
    )


def concat_group_text(docs: DataFrame, keys: Iterable[str] = (), span: int = 64, most_chars: int = 4_000_000) -> DataFrame:
    """``<keys..., segment, piece, content>``: the joined text of each group, in pieces that follow each other.

    One segment covers ``span`` consecutive ids and is cut into pieces of about ``most_chars`` characters, or one longer text, so a task
    never holds more than ``span`` documents at once, nor a row more than a piece, however large the group is. Texts without an id come in
    segments below 0, ``span`` texts or fewer each, in no order. Joining a group's pieces in order with a space gives its whole text.
    """
    keys = list(keys)
    # Rows without an id are dealt by their place in the input, which does not put equal texts together.
    nameless = -1 - F.floor(F.monotonically_increasing_id() / span)
    placed = docs.withColumn("segment", F.coalesce(F.floor(F.col("doc_id") / span), nameless).cast("bigint"))
    order = Window.partitionBy(*keys, "segment").orderBy("doc_id", F.length("content"), "content")
    before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = placed.withColumn("piece", F.floor(before / most_chars).cast("int"))
    joined = F.expr("listagg(content, ' ') within group (order by doc_id, length(content), content)")
    return cut.groupBy(*keys, "segment", "piece").agg(joined.alias("content"))
