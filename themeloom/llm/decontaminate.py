"""Benchmark decontamination: an FM-index per shard of training texts, searched for the benchmark's phrases.

A task's slice of texts is a shard. Its words become symbols (the benchmark's words by number, all others one separator symbol), and an
FM-index is built over them: the suffix order, the Burrows-Wheeler transform in a wavelet tree, and every few
suffix positions as samples. All phrases are searched backwards at once through wavelet-tree ranks, hits are located by walking to
a sampled position, and their spans are merged per document. No text leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import covered, expanded, flat_structs, offsets, slices, table, text_bytes, words_of
from themeloom.session import stage

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 6 << 20
MAX_WORDS = 2_000_000

# A-Z to lower case, other ASCII but digits and letters to a space; bytes of longer UTF-8 sequences stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per binary digit, highest first, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.digits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for digit in range(self.digits - 1, -1, -1):
            bits = (symbols >> digit) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _down(self, code_bits: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        ones = self.ones[level][at]
        return np.where(code_bits == 1, self.zeros[level] + ones, at - ones)

    def rank(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``codes[i]`` stands before place ``at[i]``."""
        start = np.zeros_like(at)
        for level in range(self.digits):
            bits = (codes >> (self.digits - 1 - level)) & 1
            at = self._down(bits, at, level)
            start = self._down(bits, start, level)
        return at - start


class FMIndex:
    """A searchable sequence of symbols 1..n_symbols-1; 0 ends it."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        sequence = np.append(sequence, 0).astype(np.int32)
        order = suffix_order(sequence)
        self.bwt = sequence[order - 1]
        sizes = np.bincount(sequence, minlength=n_symbols)
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.tree = WaveletTree(self.bwt, n_symbols)
        rows = np.flatnonzero(order % sample == 0)
        self.sampled = np.zeros(len(order), bool)
        self.sampled[rows] = True
        self.sample_rank = np.cumsum(self.sampled, dtype=np.int32) - 1
        self.sample_place = order[rows]

    def step(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[codes] + self.tree.rank(codes, at)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of every phrase; ``phrases`` holds a phrase per row, its ``sizes[i]`` symbols first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            alive = np.flatnonzero((sizes >= back) & (low < high))
            if not len(alive):
                continue
            codes = phrases[alive, sizes[alive] - back]
            low[alive] = self.step(codes, low[alive])
            high[alive] = self.step(codes, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of suffix rows."""
        rows, places, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows[open_]]
            done = open_[known]
            places[done] = self.sample_place[self.sample_rank[rows[done]]] + steps
            open_ = open_[~known]
            if len(open_):
                rows[open_] = self.step(self.bwt[rows[open_]], rows[open_])
                steps += 1
        return places


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling the compared length for those still equal.

    ``sequence`` ends with its only, smallest 0.
    """
    n = len(sequence)
    small = sequence.max() < 1 << 16
    order = np.argsort(sequence.astype(np.uint16), kind="stable") if small else np.argsort(sequence)
    ranked = sequence[order]
    heads = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    length = 1
    # Places in ``order`` whose group has more than one suffix.
    open_ = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    while len(open_):
        suffixes = order[open_]
        follow = rank[np.minimum(suffixes + length, n - 1)]
        groups = rank[suffixes]
        key = groups * n + follow
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        order[open_] = suffixes
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = open_[np.maximum.accumulate(np.where(heads, np.arange(len(open_)), 0))]
        open_ = open_[~(heads & np.append(heads[1:], True))]
        length *= 2
    return order


class Phrases:
    """The benchmark's windows as symbol rows. An item shorter than a window is one phrase; one without words has none."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.items: list[str] = []
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            words = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in folded(text).split()]
            if not words:
                continue
            number = len(self.items)
            self.items.append(item)
            for i in range(max(1, len(words) - window + 1)):
                phrase = tuple(words[i : i + window])
                pairs.add((seen.setdefault(phrase, len(seen)), number))
        self.n_symbols = len(self.symbol) + 2
        self.sizes = np.array([len(p) for p in seen], np.int64)
        self.rows = np.zeros((len(seen), window), np.int64)
        for i, phrase in enumerate(seen):
            self.rows[i, : len(phrase)] = phrase
        ordered = sorted(pairs)
        self.pair_item = np.array([n for _, n in ordered], np.int64)
        self.pair_start = offsets(np.bincount([p for p, _ in ordered], minlength=len(seen))) if ordered else np.zeros(1, np.int64)

    def shard_symbols(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.symbol.get, words, repeat(1)), np.int32, len(words))


def _search_shards(phrases: Phrases, last: bool, carried: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            words, counts = words_of(map(folded, batch.column("text").to_pylist()))
            hit, found = _search(phrases, words, counts)
            items = [set(known) for known in batch.column("items").to_pylist()]
            for doc, item in found:
                items[doc].add(phrases.items[item])
            doc, (begin, end) = flat_structs(batch, "spans", ("start", "end"))
            start = offsets(counts)[doc]
            hit |= covered(len(words), start + np.asarray(begin), start + np.asarray(end))
            out = {
                carried: batch.column(carried),
                "n_words": pa.array(counts),
                "spans": _merged_spans(hit, counts),
                "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(out if last else out | {"text": batch.column("text")})

    return run


SPAN_ROWS = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"


def _search(phrases: Phrases, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a shard are hit, and the pairs (document, item) found."""
    n, starts = len(words), offsets(counts)
    if not n or not len(phrases.sizes):
        return np.zeros(n, bool), np.zeros((0, 2), np.int64)
    # A separator stands between documents, and a run of separators says no more than one.
    place = np.arange(n) + np.repeat(np.arange(len(counts)), counts)
    spaced = np.ones(n + len(counts), np.int32)
    spaced[place] = phrases.shard_symbols(words)
    origin = np.zeros(len(spaced), np.int64)
    origin[place] = np.arange(n)
    keep = np.concatenate([[True], (spaced[1:] != 1) | (spaced[:-1] != 1)])
    index = FMIndex(spaced[keep], phrases.n_symbols)
    low, high = index.search(phrases.rows, phrases.sizes)
    phrase, rows = expanded(low, high)
    begin = origin[keep][index.locate(rows)]
    doc = np.searchsorted(starts, begin, "right") - 1
    hit = covered(n, begin, begin + phrases.sizes[phrase])
    of, pair = expanded(phrases.pair_start[phrase], phrases.pair_start[phrase + 1])
    return hit, np.unique(np.stack([doc[of], phrases.pair_item[pair]], axis=1), axis=0)


def _merged_spans(hit: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The runs of hit words of each document, as places within it."""
    starts = offsets(counts)
    fresh = np.zeros(len(hit) + 1, bool)
    fresh[starts] = True
    before = np.concatenate([[False], hit])[: len(hit)]
    after = np.append(hit, False)[1:]
    opens = np.flatnonzero(hit & (~before | fresh[:-1]))
    closes = np.flatnonzero(hit & (~after | fresh[1:])) + 1
    doc = np.searchsorted(starts, opens, "right") - 1
    fields = [pa.array((at - starts[doc]).astype(np.int32)) for at in (opens, closes)]
    per_doc = offsets(np.bincount(doc, minlength=len(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per_doc), pa.StructArray.from_arrays(fields, ["start", "end"]))


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> list[DataFrame]:
    """The benchmark's ``<item, text>`` in parts of about ``max_words`` words at most, dealt by a hash of the item."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text.alias("text"))
    words_at_most = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    n = 1 + int(words_at_most // max_words)
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``<id, n_words, spans, items>`` of every row: merged removal spans in words and the sorted ids of the items found.

    An item of fewer than ``window`` words is one phrase, one without words is none; null texts have no words, null item ids are the
    empty string. Rows with null or repeated ids stay. Without any item, or with an empty table, the spans are empty. A
    benchmark of more than ``max_words`` words is searched for in blocks, with a pass over the documents for each; only one block
    is on the driver and in the tasks at a time.
    """
    id_ = F.col(id_col).cast("bigint").alias("id")
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, max_words)
    return _search_blocks(docs, id_, text_col, blocks, window)


def _search_blocks(docs: DataFrame, carried: Column, text_col: str, blocks: list[DataFrame], window: int) -> DataFrame:
    """``<carried, n_words, spans, items>``, one pass over ``docs`` for each block of the benchmark."""
    found = docs.select(
        carried,
        text_bytes(text_col).alias("text"),
        F.array().cast("array<struct<start: int, end: int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    name = found.columns[0]
    rows = f"{name} {found.schema[name].dataType.simpleString()}, {SPAN_ROWS}"
    for n, block in enumerate(blocks, 1):
        phrases = Phrases([(r["item"], r["text"].encode()) for r in block.collect()], window)
        last = n == len(blocks)
        found = found.mapInArrow(_search_shards(phrases, last, name), rows if last else rows + ", text binary")
        if not last:
            found = stage(found, "contamination")
    return found


def with_rule(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: hit words are a twentieth of all or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    hit = found.withColumn("n_hit", n_hit)
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that the rule does not call contaminated, with their columns."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, max_words)
    found = _search_blocks(docs, F.struct("*").alias("row"), text_col, blocks, window)
    return with_rule(found).where("NOT contaminated").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_rule(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
