"""Books as tables of numbered lines ``<source, line, text>``, for texts larger than a row can be.

Markers and headings are found on lines. What depends on the lines before, like the number of a part, is a prefix sum over runs of
lines of a bounded length, so a book that holds most of a corpus is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeloom.functions.text import BOOK_ENDS, BOOK_STARTS, collapse_whitespace
from themeloom.session import drop_staged, stage

RUN = 50_000  # lines that are numbered in one task


def _running_count(lines: DataFrame, flag: Column, name: str, run: int) -> DataFrame:
    """Adds how many lines up to and with each one have the flag."""
    dealt = lines.withColumn("_flag", flag.cast("bigint")).withColumn("_run", F.floor((F.col("line") - 1) / run))
    runs = dealt.groupBy("source", "_run").agg(F.sum("_flag").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("source", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_flag").over(Window.partitionBy("source", "_run").orderBy("line"))
    counted = dealt.withColumn("_inside", inside).join(before, ["source", "_run"])
    return counted.withColumn(name, F.col("_before") + F.col("_inside")).drop("_flag", "_run", "_before", "_inside")


def _first(markers: Sequence[str]) -> Column:
    """``struct<line, at>`` of the first occurrence of the first marker, in list order, that occurs in a source."""
    found = [F.min(F.when(F.contains("text", F.lit(m)), F.struct("line", F.locate(m, F.col("text")).alias("at")))) for m in markers]
    return F.coalesce(*found)


def trim_lines(lines: DataFrame, starts: Sequence[str] = BOOK_STARTS, ends: Sequence[str] = BOOK_ENDS) -> DataFrame:
    """``<source, line, text>`` of each body: from the line after a start marker up to the first end marker in list order.

    The same rule as :func:`functions.text.trim_boilerplate` on whole texts: without a start marker, or with one on the last line, the body
    begins with the text, without an end marker it runs to its end; an end marker before the start leaves nothing. What stands before the end
    marker on its line belongs to the body. Line numbers stay those of the source. Markers do not reach over lines.
    """
    bounds = lines.groupBy("source").agg(_first(starts).alias("start"), _first(ends).alias("end"), F.max("line").alias("last"))
    after = F.when(F.col("start.line") < F.col("last"), F.col("start.line")).otherwise(0)
    bounds = bounds.select("source", after.alias("_after"), F.col("end.line").alias("_end"), F.col("end.at").alias("_at"))
    inside = (F.col("line") > F.col("_after")) & (F.col("_end").isNull() | (F.col("line") <= F.col("_end")))
    text = F.when(F.col("line") == F.col("_end"), F.substring("text", F.lit(1), F.col("_at") - 1)).otherwise(F.col("text"))
    return lines.join(bounds, "source").where(inside).select("source", "line", text.alias("text"))


def headed_lines(lines: DataFrame, heading: str, run: int = RUN) -> DataFrame:
    """``<source, part, heading, line, text>``: the lines under each heading, parts numbered from 1 in every source.

    ``heading`` is a pattern that must fill a whole line, but for blanks. Lines before the first heading belong to no part. Joined by line feeds,
    the lines of a part are the body that :func:`operators.sections.split_headings` cuts out of a whole text, before it is trimmed.
    """
    marked = lines.withColumn("_mark", F.rlike("text", F.lit(rf"^[ \t]*(?:{heading})[ \t]*$")))
    parts = _running_count(marked, F.col("_mark"), "part", run).where("part > 0").withColumn("part", F.col("part").cast("int"))
    heads = parts.where("_mark").select("source", "part", F.trim(F.col("text"), F.lit(" \t")).alias("heading"))
    return parts.where("NOT _mark").join(heads, ["source", "part"]).select("source", "part", "heading", "line", "text")


def part_sizes(parts: DataFrame) -> DataFrame:
    """``<source, part, heading, lines, chars>`` of headed lines; chars count the line feeds between them."""
    sizes = parts.groupBy("source", "part", "heading").agg(F.count("*").alias("lines"), F.sum(F.length("text") + 1).alias("chars"))
    return sizes.withColumn("chars", F.col("chars") - 1)


# --- sentences and chunks of books ------------------------------------------------------------------


def line_sentences(lines: DataFrame, run: int = RUN) -> DataFrame:
    """``<source, sentence, text>``: the sentences of each source, numbered from 0.

    They are those of :func:`functions.text.split_sentences` on the whole text. Pieces of a line end at full stops and the like; the last piece of
    a line goes on with the next line unless it ends so too. Sentences are numbered by prefix sums of the pieces that end one.
    """
    pieces = F.split(collapse_whitespace(F.col("text")), r"(?<=[.!?]) ")
    cut = lines.select("source", "line", F.posexplode(F.filter(pieces, lambda p: p != "")).alias("i", "piece"))
    dealt = cut.withColumn("_run", F.floor((F.col("line") - 1) / run)).withColumn("_ends", F.rlike("piece", F.lit(r"[.!?]$")).cast("bigint"))
    runs = dealt.groupBy("source", "_run").agg(F.sum("_ends").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("source", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("source", "_run").orderBy("line", "i")
    inside = F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("_inside", inside).join(before, ["source", "_run"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "i", "piece"))), lambda p: p["piece"]), " ")
    return numbered.groupBy("source", (F.col("_before") + F.col("_inside")).alias("sentence")).agg(joined.alias("text"))


class Cuts:
    """The chunking rule at the sentence boundaries of one block and its neighbours.

    A chunk that closes at boundary c is followed by one that starts at ``reach(c)`` and closes at ``follow(c)``, so the cuts of a book are
    what ``follow`` reaches from its first cut. ``totals`` has the characters before each boundary; a boundary behind the last known one
    has the next number.
    """

    def __init__(self, table: pa.Table, size: int, overlap: int, least: int):
        numbers, totals, homes = (np.asarray(table.column(c)) for c in ("sentence", "total", "home"))
        by = np.argsort(numbers)
        self.numbers, self.totals = numbers[by], totals[by]
        self.size, self.overlap, self.least = size, overlap, least
        self.source, self.block, self.last = (table.column(c)[0].as_py() for c in ("source", "block", "last"))
        # Places of the block's own boundaries; the last one of the book closes it and is no cut.
        self.own = np.flatnonzero((homes[by] == self.block) & (self.numbers < self.last))
        self.holds_start = self.numbers[0] == 0 and self.block == int(homes[by][0])

    def closes(self, totals: np.ndarray) -> np.ndarray:
        """Where a chunk that starts after so many characters closes at the earliest."""
        enough = np.searchsorted(self.totals, totals + self.least, side="left")
        over = np.searchsorted(self.totals, totals + self.size, side="right") - 1
        place = np.maximum(enough, over)
        known = place < len(self.numbers)
        return np.minimum(np.where(known, self.numbers[np.where(known, place, 0)], self.numbers[-1] + 1), self.last)

    def reach(self) -> np.ndarray:
        """Places of the boundaries from which the chunks after the block's own start."""
        return np.searchsorted(self.totals, self.totals[self.own] - self.overlap, side="left")

    def follow(self) -> np.ndarray:
        return np.minimum(np.maximum(self.closes(self.totals[self.reach()]), self.numbers[self.own] + 1), self.last)

    def entries(self, width: int) -> np.ndarray:
        """Which of the own boundaries a cut of an earlier block can lead to."""
        near = np.searchsorted(self.totals[self.own], self.block * width + max(self.size, self.least), side="right")
        return np.arange(len(self.own)) <= near

    def hops(self) -> np.ndarray:
        """For each own boundary the place of the next cut among the own ones, or their number where that is outside."""
        hop = np.searchsorted(self.numbers[self.own], self.follow())
        return np.append(hop, len(self.own))


def _exits(hops: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """For every boundary of a block the first one outside that its cuts lead to, by squaring the step."""
    end = len(follow)
    last = np.arange(end + 1)
    ahead = hops
    while (ahead < end).any():
        last = np.where(ahead < end, last[np.minimum(ahead, end)], last)
        ahead = np.append(ahead[:-1], end)[np.minimum(ahead, end)]
    return follow[last[:-1]]


def _reached(hops: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places that the step leads to from the start, themselves included."""
    steps = [hops]
    for _ in range(len(hops).bit_length()):
        steps.append(steps[-1][steps[-1]])
    marked = np.zeros(len(hops), bool)
    marked[start] = True
    for step in reversed(steps):
        marked[step[np.flatnonzero(marked)]] = True
    marked[-1] = False
    return np.flatnonzero(marked)


def _sentence_totals(sentences: DataFrame, run: int) -> DataFrame:
    """``<source, sentence, total, last>``: the characters before every sentence, and the boundary behind the last one, numbered ``last``."""
    dealt = sentences.select("source", "sentence", F.length("text").cast("bigint").alias("len"), F.floor(F.col("sentence") / run).alias("_run"))
    runs = dealt.groupBy("source", "_run").agg(F.sum("len").alias("_n"), F.count("*").alias("_count"))
    earlier = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    runs = runs.select("source", "_run", before, F.sum("_count").over(whole).alias("last"), F.sum("_n").over(whole).alias("_all"))
    inside = F.sum("len").over(Window.partitionBy("source", "_run").orderBy("sentence")) - F.col("len")
    placed = dealt.withColumn("_inside", inside).join(runs, ["source", "_run"])
    rows = placed.select("source", "sentence", (F.col("_before") + F.col("_inside")).alias("total"), "last")
    ends = runs.groupBy("source").agg(F.max("last").alias("sentence"), F.max("_all").alias("total"))
    return rows.unionByName(ends.withColumn("last", F.col("sentence")))


def chunk_lines(
    sentences: DataFrame, chunk_size: int = 1000, overlap: int = 100, min_chunk_size: int = 100, block_chars: int = 1 << 20, run: int = RUN
) -> DataFrame:
    """``<source, first, end, content>``: the chunks of :func:`operators.sections.chunk_sentences`, of books larger than a row.

    Input ``<source, sentence, text>``; a chunk has the sentences from ``first`` up to ``end``. A book is dealt in blocks of ``block_chars``
    characters, each with the boundaries of its neighbours. A block tells for the boundaries at its beginning by which one the cuts that enter
    there leave it; these small tables are composed per book, and then every block makes its own cuts from where it is
    entered. No task holds more than the numbers of three blocks, or the text of one chunk.
    """
    if min_chunk_size < 1:
        raise ValueError("a chunk has a character at least")
    width = max(block_chars, chunk_size, min_chunk_size, overlap) + 1
    sentences = stage(sentences.select("source", "sentence", "text"), "sentences")  # read twice: cut out of the books once
    bounds = stage(_sentence_totals(sentences, run), "bounds")
    home = F.floor(F.col("total") / width)
    around = F.explode(F.array(home - 1, home, home + 1)).alias("block")
    near = bounds.select("source", around, home.alias("home"), "sentence", "total", "last").groupBy("source", "block")
    limits = (chunk_size, overlap, min_chunk_size)

    def leave(table: pa.Table) -> pa.Table:
        cuts = Cuts(table, *limits)
        chosen = np.flatnonzero(cuts.entries(width))
        entry, exit_ = cuts.numbers[cuts.own][chosen], (_exits(cuts.hops(), cuts.follow())[chosen] if len(chosen) else chosen)
        if cuts.holds_start:
            entry, exit_ = np.append(entry, -1), np.append(exit_, cuts.closes(np.zeros(1, np.int64)))
        n = len(entry)
        return pa.table({"source": pa.array([cuts.source] * n, pa.string()), "block": np.full(n, cuts.block), "entry": entry, "exit": exit_})

    def walk(table: pa.Table) -> pa.Table:
        """The boundaries by which a book's cuts enter its blocks, one step a block; the way in is the entry -1."""
        table = table.sort_by("entry")
        entry, exit_ = (np.asarray(table.column(c)) for c in ("entry", "exit"))
        place, kept = np.searchsorted(entry, exit_[0]), []
        while place < len(entry):
            kept.append(place)
            place = np.searchsorted(entry, exit_[place])
        return table.take(pa.array(kept, pa.int64()))

    rows = "source string, block bigint, entry bigint, exit bigint"
    entries = stage(near.applyInArrow(leave, rows).groupBy("source").applyInArrow(walk, rows), "entries")

    def spans(table: pa.Table, entered: pa.Table) -> pa.Table:
        none = pa.schema([("source", pa.string()), ("first", pa.int64()), ("end", pa.int64())]).empty_table()
        if not table.num_rows:
            return none
        cuts = Cuts(table, *limits)
        start, close = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if entered.num_rows and len(cuts.own):
            at = _reached(cuts.hops(), np.searchsorted(cuts.numbers[cuts.own], np.asarray(entered.column(2))))
            start, close = cuts.reach()[at], cuts.follow()[at]
        if cuts.holds_start:
            start, close = np.append(0, start), np.append(cuts.closes(np.zeros(1, np.int64)), close)
        # What is left over at the end of the book has to be long enough; its end lies behind the neighbours only if it is.
        end = cuts.totals[-1] if cuts.numbers[-1] == cuts.last else np.iinfo(np.int64).max
        kept = (close < cuts.last) | (end - cuts.totals[start] >= cuts.least)
        return pa.table({"source": pa.array([cuts.source] * int(kept.sum()), pa.string()), "first": cuts.numbers[start[kept]], "end": close[kept]})

    sides = near.cogroup(entries.toDF("s", "b", "entry", "exit").groupBy("s", "b"))
    found = stage(sides.applyInArrow(spans, "source string, first bigint, end bigint"), "spans")
    drop_staged(bounds, entries)
    inside = found.select("source", "first", "end", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("sentence"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda s: s["text"]), " ")
    return inside.join(sentences, ["source", "sentence"]).groupBy("source", "first", "end").agg(content.alias("content"))
