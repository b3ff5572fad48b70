"""Helpers the operators share: slices of Arrow batches, words and their hashes, row keys."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.session import drop_staged, stage

SLICE_BYTES = 4 << 20
HASH_MEMO = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` has at most ``limit`` bytes together, or a single longer row.

    This bounds a task's memory whatever the lengths of the texts are.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def words_of(texts: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words (runs without ASCII white space) of some texts, one after the other, and how many each text has."""
    parts = [text.split() for text in texts]
    return list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))


def worker_state(name: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for later tasks of this Python worker with the same ``key``; one value per name.

    Spark reuses its Python workers. Task functions are shipped by value, so the state hangs on a module of its own. It must only
    save work: a new worker starts without it.
    """
    home = sys.modules.setdefault("_themeloom_worker_state", ModuleType("_themeloom_worker_state"))
    if getattr(home, name, (None,))[0] != key:
        setattr(home, name, (key, make()))
    return getattr(home, name)[1]


@contextmanager
def no_collection() -> Iterator[None]:
    """Python's search for cycles is off inside: for code that makes millions of objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WordHashes(dict):
    """XXH64 of byte strings; a bounded memo answers the frequent ones."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < HASH_MEMO:
            self[word] = value
        return value

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def row_keys(*columns: str) -> list[Column]:
    """Two hashes that stand for a row's content where ids may be null or repeated.

    Rows that agree in all ``columns`` share a key, which the callers allow for.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7), *reversed(cols)).alias("k2")]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, key: str, most: int, parts: int = 8) -> DataFrame:
    """About ``most`` of the rows at most, chosen by a hash of ``key`` so that the choice does not depend on how they lie.

    The result is staged in a few parts, for learners that go over it again and again.
    """
    bound = 1 << 30
    rows = stage(rows, "labelled")
    share = min(1.0, most / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(bound)) < int(share * bound))
    sample = stage(chosen.coalesce(parts), "sample")
    drop_staged(rows)
    return sample


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end), and the range that each is of."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(offsets(sizes)[:-1], sizes) + starts[of]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end); ranges that end before they start are empty."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.maximum(ends, starts), -1)
    return np.cumsum(marks)[:n] > 0


def flat_structs(batch: pa.RecordBatch, column: str, fields: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """The row number and the fields of all structs in a list column without nulls."""
    lists = batch.column(column)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    flat = lists.flatten()
    return row, [flat.field(f) for f in fields]
