"""Periodic runs: stretches of words that repeat with a short period, found through string synchronising sets.

At the scale t = 4, 8, 16 ... a position is chosen if the smallest hash of the t + 1 word windows of length t that begin at it or up to
t words later is that of the first or the last one. Windows that lie in a run of a period of at most t / 4 do not take part. The
choice depends on the 2t words behind a position only, and every stretch of t positions has a chosen one unless its words repeat
with such a small period. In a run of a period q from t to 2t - 1 that is at least 4q long, the next chosen position with the
same 2t words behind it is therefore q words later: neighbours with equal contexts propose the period. The proposals are then
extended word by word. Periods below 4 are compared directly, and the runs of the smaller scales are the highly periodic
regions that the next ones leave out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.common import covered, expanded, mixed, offsets, slices, table, text_bytes, words_of

EXPONENT = 4
LEAST = 6
# Periods below it are compared directly.
SMALL = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _islands(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every window of ``width``, from the running minima of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    filled = np.full(-(-n // width) * width, _NONE)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def synchronising_set(ids: np.ndarray, scale: int, left_out: np.ndarray) -> np.ndarray:
    """Chosen positions; ``ids`` has a hash of every window of ``scale`` words, ``left_out`` tells which windows do not take part."""
    taking_part = np.where(left_out, _NONE, ids)
    least = _window_least(taking_part, scale + 1)
    first, last = taking_part[: len(least)], taking_part[scale : scale + len(least)]
    return np.flatnonzero(((least == first) | (least == last)) & (least != _NONE))


def _proposals(places: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen places whose next one with the same context is from ``scale`` to ``2 * scale - 1`` words later, and that distance."""
    by = np.lexsort((places, contexts))
    places, contexts = places[by], contexts[by]
    gap = np.diff(places)
    near = (contexts[1:] == contexts[:-1]) & (gap >= scale) & (gap < 2 * scale)
    return places[:-1][near], gap[near]


def _extended(words: np.ndarray, places: np.ndarray, periods: np.ndarray, scale: int) -> np.ndarray:
    """Runs ``(start, end, period)`` around proposals of a scale, with at least ``EXPONENT`` periods."""
    by = np.lexsort((places, periods))
    places, periods = places[by], periods[by]
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(periods) != 0) | (np.diff(places) > 2 * scale)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(places)) - 1
    period = periods[first]
    # A chosen place lies less than ``scale`` words from either end of the run, so it ends inside these bounds.
    low = np.maximum(places[first] - scale, 0)
    high = np.minimum(places[last] + 3 * scale, len(words) - period)
    of, at = expanded(low, high)
    same = words[at] == words[at + period[of]]
    # A gap after each proposal keeps its stretch from running into the next one's.
    spread = np.zeros(len(at) + len(first), bool)
    spread[np.arange(len(at)) + of] = same
    begin, end = _islands(spread)
    own = np.searchsorted(offsets(high - low + 1), begin, "right") - 1
    shift = low[own] - offsets(high - low + 1)[own]
    begin, end, period = begin + shift, end + shift, period[own]
    long = end - begin >= (EXPONENT - 1) * period
    return np.stack([begin[long], end[long] + period[long], period[long]], axis=1)


def _small_runs(words: np.ndarray) -> np.ndarray:
    """Runs of the periods below ``SMALL`` by direct comparison."""
    found = []
    for period in range(1, min(SMALL, len(words))):
        begin, end = _islands(words[:-period] == words[period:])
        long = end - begin >= (EXPONENT - 1) * period
        begin, end = begin[long], end[long] + period
        for smaller in range(1, period):
            if period % smaller == 0:  # at this length a smaller period divides the period
                own = np.all([words[begin + k] == words[begin + k + smaller] for k in range(period - smaller)], axis=0)
                begin, end = begin[~own], end[~own]
        found.append(np.stack([begin, end, np.full(len(begin), period)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs ``(start, end, period)`` of at least ``EXPONENT`` periods in texts laid one after the other, sorted.

    ``words`` are numbers of 0 and above, equal for equal words; ``sizes`` has the words of each text. Starts and ends are places in ``words``.
    """
    starts = offsets(sizes)[:-1]
    # A number of its own stands behind every text, so that nothing reaches over its end.
    text = np.repeat(np.arange(len(sizes)), sizes)
    spaced = np.empty(len(words) + len(sizes), np.int64)
    spaced[np.arange(len(words)) + text] = words
    spaced[starts + sizes + np.arange(len(sizes))] = -1 - np.arange(len(sizes))
    origin = np.repeat(starts, sizes + 1) + np.arange(len(spaced)) - np.repeat(starts + np.arange(len(sizes)), sizes + 1)
    found = [_small_runs(spaced)]
    found[0][:, :2] = origin[found[0][:, :2] - [0, 1]] + [0, 1]
    hashes, scale, longest = mixed(spaced.view(np.uint64)), 1, sizes.max(initial=0)
    alive, lengths = np.arange(len(spaced)), sizes + 1
    while EXPONENT * scale <= longest:
        if scale >= SMALL:
            # Texts too short for this scale leave.
            keep = np.repeat(lengths > EXPONENT * scale, lengths)
            if not keep.all():
                spaced, hashes, origin, alive = spaced[keep], hashes[keep], origin[keep], alive[keep]
                lengths = lengths[lengths > EXPONENT * scale]
            ids = hashes[: len(spaced) - scale + 1]
            runs = np.concatenate(found)
            dense = runs[(EXPONENT * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
            highly = covered(len(words), dense[:, 0], dense[:, 1] - scale + 1)
            inner = np.zeros(len(ids), bool)
            real = spaced[: len(ids)] >= 0
            inner[real] = highly[origin[: len(ids)][real]]
            places = synchronising_set(ids, scale, inner)
            places = places[places + 2 * scale <= len(spaced)]
            contexts = _doubled(hashes, scale)[places]
            at, period = _proposals(places, contexts, scale)
            if len(at):
                new = _extended(spaced, at, period, scale)
                new[:, :2] = origin[new[:, :2] - [0, 1]] + [0, 1]
                found.append(np.unique(new, axis=0))
        hashes = _doubled(hashes, scale)
        scale *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _doubled(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Hashes of windows of twice the length, in the same number of places; those that reach over the end mean nothing."""
    after = np.concatenate([hashes[scale:], np.zeros(min(scale, len(hashes)), np.uint64)])
    return mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + after)


def _numbered(words: list[bytes]) -> np.ndarray:
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def looped(n: int, start: int, period: int) -> np.ndarray:
    """The word numbers of a text of ``n`` words whose words from ``start`` on repeat those of one ``period``."""
    places = np.arange(n)
    return np.where(places < start, places, start + (places - start) % period)


_RUN_ROWS = "id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, sizes = words_of(batch.column("text").to_pylist())
        starts = offsets(sizes)[:-1]
        for row, (a, p) in enumerate(zip(batch.column("loop_at").to_pylist(), batch.column("loop_period").to_pylist())):
            n = int(sizes[row])
            if n and p is not None:
                at, own = int(a) % n, int(starts[row])
                own_words = words[own : own + n]
                words[own : own + n] = [own_words[i] for i in looped(n, at, 1 + (n - at) // int(p)).tolist()]
        runs = runs_of(_numbered(words), sizes)
        runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
        doc = np.searchsorted(starts + sizes, runs[:, 0], "right")
        gone = covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])
        changed = np.zeros(len(sizes), bool)
        changed[doc] = True
        kept = []
        for start, n, some in zip(starts.tolist(), sizes.tolist(), changed.tolist()):
            own = words[start : start + n]
            kept.append(b" ".join([w for w, g in zip(own, gone[start : start + n].tolist()) if not g] if some else own))
        fields = [runs[:, 0] - starts[doc], runs[:, 1] - runs[:, 0], runs[:, 2]]
        structs = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(offsets(np.bincount(doc, minlength=len(sizes))).astype(np.int32)), structs)
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(kept, pa.binary())], ["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = False) -> DataFrame:
    """``<id, runs, collapsed>`` of every row: the runs by start, then period, and the text without the repeats of runs.

    A run is a stretch of consecutive words with smallest period ``period`` and a length of at least ``LEAST`` words and ``EXPONENT``
    periods that no neighbouring word extends. ``collapsed`` has the words that no run contains after its first period, joined by a space.
    With ``loop``, a tenth of the texts, chosen by the crc32 of the id, first gets a tail that repeats a part of it, so that runs of
    many periods occur. Null texts have no words; rows with null ids (crc32 as of an empty text) or repeated ids stay; an empty table gives an
    empty result; other columns are ignored. A text is worked on whole in the task that holds its row, short texts many at a time.
    """
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(crc / 10)
    chosen = F.lit(loop) & (crc % 10 == 0)
    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        text_bytes(text_col).alias("text"),
        F.when(chosen, g).alias("loop_at"),
        F.when(chosen, 3 + g % 8).alias("loop_period"),
    )
    return narrow.mapInArrow(_find, _RUN_ROWS)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), loop=True)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    keyed = F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(keyed)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        (-best["k"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-1000 * best["k"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
