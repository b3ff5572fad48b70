"""Repeated spans of words: a sparse de Bruijn graph of the corpus finds them, source coordinates verify them.

1. Anchors. Of the word k-mers in every window the one with the smallest hash is an anchor, so that two equal windows have the
   same anchor at the same place. Only anchors that occur again can lie in a repeated window.
2. Graph. An anchor and the next one of its document, if close enough to share a window, make an edge. Edges are named by a hash of
   all words they cover. Repeated edges are compacted: they are joined at nodes with one way in and one way out. Pointer
   jumping gives every edge its path and its place on it.
3. Spans. A document's walk along one path is a span. Spans with the same words at two coordinates are verified: all windows
   inside are repeated. What is left are windows that hold a repeated anchor, but not only inner ones of a span; they are
   compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from themeloom.llm.common import WordHashes, covered, flat_structs, mixed, offsets, row_keys, slices, table, text_bytes, words_of
from themeloom.session import drop_staged, stage

WINDOW = 35
ANCHOR = 8
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MAX_JUMPS = 40


class Rolling:
    """Hashes of any run of words in constant time, from sums of word hashes times powers of an odd base."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        back = pow(base, -1, 1 << 64)
        self.inverse = _powers(back, n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n)[:-1], dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _anchors(kmers: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Places of the anchors among concatenated documents of ``counts`` words: the leftmost smallest k-mer of a window.

    ``kmers[i]`` is the hash of the ``anchor`` words from ``i`` on. The place takes the hash's low bits, so one sliding minimum
    finds both; k-mers that differ only there count as equal, wherever the window stands.
    """
    width = window - anchor + 1
    starts = offsets(counts)
    if len(kmers) < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << max(20, len(kmers).bit_length())) - 1)
    least = _window_minimum((kmers & ~low) | np.arange(len(kmers), dtype=np.uint64), width)
    has = counts >= window
    valid = covered(len(least), starts[:-1][has], starts[1:][has] - window + 1)
    return np.unique((least[valid] & low).astype(np.int64))


def _columns(batch: pa.RecordBatch, memo: WordHashes):
    words, counts = words_of(batch.column("text").to_pylist())
    with np.errstate(over="ignore"):
        first = mixed(memo.all(words))
        second = mixed(first ^ np.uint64(BASES[1]))
    return words, counts, Rolling(first, BASES[0]), Rolling(second, BASES[1])


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches, "text"):
            _, counts, roll, other = _columns(batch, memo)
            n = int(counts.sum())
            if n < window:
                continue
            at = np.arange(n - anchor + 1)
            places = _anchors(roll(at, at + anchor), counts, window, anchor)
            if not len(places):
                continue
            starts = offsets(counts)
            doc = np.searchsorted(starts, places, "right") - 1
            nodes = roll(places, places + anchor).view(np.int64)
            # An edge covers this anchor and the next one; -1: no next anchor within a window.
            follows = np.zeros(len(places), bool)
            follows[:-1] = (doc[1:] == doc[:-1]) & (places[1:] + anchor - places[:-1] <= window)
            ends = np.where(follows, np.append(places[1:], 0) + anchor, places + anchor)
            edge = other(places, ends).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(doc)),
                    batch.column("k2").take(pa.array(doc)),
                    pa.array((places - starts[doc]).astype(np.int32)),
                    pa.array(nodes),
                    pa.array(edge, mask=~follows),
                ],
                ["k1", "k2", "pos", "node", "edge"],
            )

    return run


ANCHOR_ROWS = "k1 bigint, k2 bigint, pos int, node bigint, edge bigint"


def repeated_anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``<k1, k2, pos, node, edge>``: the anchors of ``docs`` ``<k1, k2, text>`` that occur more than once, staged."""
    found = stage(docs.mapInArrow(_anchor_rows(window, anchor), ANCHOR_ROWS), "anchors")
    again = stage(found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    repeated = stage(found.join(again, "node").select("k1", "k2", "pos", "node", "edge"), "repeated")
    drop_staged(found, again)
    return repeated


def compact_paths(anchors: DataFrame) -> DataFrame:
    """``<edge, path, step>`` of the repeated edges in ``anchors``: ``path`` is the first edge of the nonbranching path.

    A node is passed through if all its occurrences come in by one edge and leave by one edge. Where a walk begins or ends, or
    where another text shares no more than the node, it branches, so every walk takes whole paths. A cycle has a way in,
    as every text has a beginning, and is cut there.
    """
    by_doc = Window.partitionBy("k1", "k2").orderBy("pos")
    steps = anchors.select("node", F.lag("edge").over(by_doc).alias("before"), F.col("edge").alias("after"))
    through = (
        steps.groupBy("node")
        .agg(
            F.count("*").alias("n"),
            *[F.count(c).alias(f"n_{c}") for c in ("before", "after")],
            *[f(c).alias(f"{name}_{c}") for c in ("before", "after") for name, f in (("min", F.min), ("max", F.max))],
        )
        .where("n_before = n AND n_after = n AND min_before = max_before AND min_after = max_after")
        .select(F.col("min_after").alias("edge"), F.col("min_before").alias("to"))
    )
    edges = anchors.where("edge IS NOT NULL").groupBy("edge").agg(F.count("*").alias("n")).where("n > 1").select("edge")
    step = F.col("to").isNotNull().cast("bigint").alias("step")
    jumps = stage(edges.join(through, "edge", "left").select("edge", F.coalesce("to", "edge").alias("to"), step), "jumps")
    for _ in range(MAX_JUMPS):
        last = jumps
        ahead = jumps.where("step > 0").select(F.col("edge").alias("to"), F.col("to").alias("further"), F.col("step").alias("more"))
        doubled = jumps.join(ahead, "to", "left")
        if doubled.where("more IS NOT NULL").isEmpty():
            return jumps.select("edge", F.col("to").alias("path"), "step")
        new_step = (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")
        jumps = stage(doubled.select("edge", F.coalesce("further", "to").alias("to"), new_step), "jumps")
        drop_staged(last)
    raise RuntimeError(f"paths did not end in {MAX_JUMPS} doublings")


def candidate_spans(anchors: DataFrame, paths: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """``<k1, k2, spans>``: for each document its walks ``array<struct<path, first, last>>`` in order.

    ``first`` and ``last`` are the places of the first and the last anchor. An anchor without a repeated edge is a
    walk of its own, with a null path.
    """
    by_doc = Window.partitionBy("k1", "k2").orderBy("pos")
    walked = anchors.join(paths, "edge", "left").select("k1", "k2", "pos", "path", "step")
    follows = F.lag("path").over(by_doc).eqNullSafe(F.col("path")) & (F.lag("step").over(by_doc) + 1 == F.col("step"))
    marked = walked.withColumn("next", F.lead("pos").over(by_doc)).withColumn(
        "run", F.sum(F.when(F.col("path").isNotNull() & follows, 0).otherwise(1)).over(by_doc)
    )
    last = F.when(F.col("path").isNotNull(), F.col("next")).otherwise(F.col("pos"))
    runs = marked.groupBy("k1", "k2", "run").agg(F.first("path").alias("path"), F.min("pos").alias("first"), F.max(F.coalesce(last, "pos")).alias("last"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "last", "path"))).alias("spans"))


def _claims(window: int, anchor: int):
    """Spans and single windows of ``<row, text, spans>`` with the hashes by which they are compared; ``len`` counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches, "text"):
            _, counts, *rolls = _columns(batch, memo)
            starts, n = offsets(counts), int(counts.sum())
            doc, (first, last, path) = flat_structs(batch, "spans", ("first", "last", "path"))
            if not len(doc):
                continue
            begin = starts[doc] + np.asarray(first)
            end = starts[doc] + np.asarray(last) + anchor
            long = np.asarray(path.is_valid()) & (end - begin >= window)
            # Windows that hold an anchor of a walk, without those that hold inner ones of a long span only: whoever
            # shares one of these has the whole span.
            low = np.maximum(begin - (window - anchor), starts[doc])
            high = np.minimum(end - anchor + 1, starts[doc + 1] - window + 1)
            loose = covered(n, low, high) & ~covered(n, begin[long] + 1, end[long] - window)
            at = np.flatnonzero(loose)
            all_start = np.concatenate([begin[long], at])
            all_end = np.concatenate([end[long], at + window])
            all_doc = np.concatenate([doc[long], np.searchsorted(starts, at, "right") - 1])
            columns = {
                "row": batch.column("row").take(pa.array(all_doc)),
                "pos": pa.array((all_start - starts[all_doc]).astype(np.int32)),
                "len": pa.array((all_end - all_start).astype(np.int32)),
                "h1": pa.array(rolls[0](all_start, all_end).view(np.int64)),
                "h2": pa.array(rolls[1](all_start, all_end).view(np.int64)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


CLAIM_ROWS = "row bigint, pos int, len int, h1 bigint, h2 bigint"


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``<k1, k2, ranges>``: the places of ``docs`` ``<k1, k2, text>`` covered by repeated windows, as ``array<struct<pos, len>>``.

    Edges have names of 64 bits. Two that share one by chance make a span that no other equals; it is then left in place.
    Tables are deleted once the next one is written.
    """
    anchors = repeated_anchors(docs, window, anchor)
    spans = candidate_spans(anchors, compact_paths(anchors), anchor).withColumn("row", F.monotonically_increasing_id())
    spans = stage(spans, "spans")  # from here on a row has a number of its own
    drop_staged(anchors)
    keyed = docs.join(spans, ["k1", "k2"]).select("row", "text", "spans")
    claims = stage(keyed.mapInArrow(_claims(window, anchor), CLAIM_ROWS), "claims")
    # The hashes include the length.
    again = stage(claims.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "again")
    found = claims.join(again, ["h1", "h2"]).groupBy("row").agg(F.collect_list(F.struct("pos", "len")).alias("ranges"))
    found = stage(found.join(spans.select("k1", "k2", "row"), "row").select("k1", "k2", "ranges"), "ranges")
    drop_staged(claims, again, spans)
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, counts = words_of(batch.column("text").to_pylist())
        starts = offsets(counts)
        doc, (pos, size) = flat_structs(batch, "ranges", ("pos", "len"))
        begin = starts[doc] + np.asarray(pos)
        gone = covered(len(words), begin, begin + np.asarray(size)) if len(doc) else np.zeros(len(words), bool)
        kept_text, kept = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            cut = gone[a:b]
            own = words[a:b]
            if cut.any():
                own = [w for w, g in zip(own, cut.tolist()) if not g]
            kept.append(len(own))
            kept_text.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts), pa.array(counts - np.array(kept, np.int64)), pa.array(kept_text, pa.binary())],
            ["id", "n_words", "n_removed", "kept"],
        )


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``<id, n_words, n_removed, kept>``: every row's words without those in windows that occur again anywhere.

    A window is ``window`` consecutive words of one row; every occurrence goes, the first one included. ``kept`` is the rest of the words,
    joined by one space (binary UTF-8). Null and empty texts have no words; rows with null or repeated ids stay and are treated
    by their texts, equal rows as copies of each other. An empty table gives an empty result, other columns are ignored.

    Word hashes have 64 bits, window hashes 128. Only anchors, ends of spans and the texts themselves are shuffled.
    """
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text"))
    ranges = repeated_ranges(keyed.select("k1", "k2", "text"), window, anchor)
    joined = keyed.join(ranges, ["k1", "k2"], "left")
    empty = F.array().cast("array<struct<pos: int, len: int>>")
    ready = joined.select("id", "text", F.coalesce("ranges", empty).alias("ranges"))
    return ready.mapInArrow(_removed, "id bigint, n_words bigint, n_removed bigint, kept binary")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
