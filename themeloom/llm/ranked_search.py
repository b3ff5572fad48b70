"""Ranked lexical search by norm buckets: the largest inner products of sparse integer vectors.

A document is the vector of its impacts, an item the vector of its term weights; a score is their inner product. The documents' vectors are
ordered by length and cut into buckets. A bucket is skipped for an item once the product of the item's length and the bucket's
greatest length (Cauchy-Schwarz) is below the item's last place so far. Inside a bucket the items' heaviest coordinates are summed first; what
the others can add is at most the product of the lengths of what is left of both vectors, and documents that cannot reach the last place
are dropped. The survivors are scored anew in integers. The longest vectors are searched first to have a last place to begin with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from themeloom.llm.common import expanded, no_collection, offsets, slices, table, text_bytes, words_of
from themeloom.llm.decontaminate import folded
from themeloom.session import drop_staged, stage

TOP = 50
BUCKET = 4096
SEEDS = 1 << 14
# Coordinates that are summed before documents are dropped again.
STEPS = (4, 8, 16, 32)
# Items are searched for in blocks of about so many words, which bounds what is broadcast.
BLOCK_WORDS = 1_000_000


class Items:
    """The items of one block as sets of numbered terms."""

    def __init__(self, texts: list[bytes]):
        sets = [sorted(set(folded(t).split())) for t in texts]
        self.number = {term: i for i, term in enumerate(sorted(set().union(*sets)))}
        self.terms = [np.array([self.number[t] for t in own], np.int64) for own in sets]

    def weighted(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Terms of each item by falling weight, their weights, and the length of what follows each place."""
        out = []
        for terms in self.terms:
            terms = terms[np.lexsort((terms, -weights[terms]))]
            own = weights[terms]
            rest = np.sqrt(np.append(np.cumsum((own.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
            out.append((terms, own, rest))
        return out


def _counted(number):
    """Length of every text and counts of the items' terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = number.value, max(1, len(number.value))
        for batch in slices(batches, "text"):
            with no_collection():
                words, n = words_of(map(folded, batch.column("text").to_pylist()))
                codes = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            doc = np.repeat(np.arange(len(n)), n)
            hit = codes >= 0
            keys, tf = np.unique(doc[hit] * size + codes[hit], return_counts=True)
            ends = pa.array(offsets(np.bincount(keys // size, minlength=len(n))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat)) for flat in ((keys % size).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), *lists], ["id", "n", "terms", "tf"])

    return run


class Best:
    """The ``top`` best scores of one item so far, ties by smaller id, rows without an id last."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, least
        self.scores, self.ids, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        scores, ids, named = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.named, named)
        by = np.lexsort((ids, ~named, -scores))[: self.top]
        self.scores, self.ids, self.named = scores[by], ids[by], named[by]
        if len(by) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Vectors of like length: rows by falling length, and the postings of every term."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.named = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        self.lengths, self.starts, self.terms, self.impacts = lengths, offsets(sizes), terms, impacts
        by = np.argsort(terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(sizes)), sizes)[by], impacts[by].astype(np.float64)
        self.first = offsets(np.bincount(terms, minlength=vocabulary))

    def survivors(self, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray, least: int) -> np.ndarray:
        """Rows whose bound reaches ``least``: sums over the heaviest coordinates and the lengths of the rest, in steps."""
        n = len(self.ids)
        total, squares, done = np.zeros(n), np.zeros(n), 0
        alive = np.arange(n)
        for step in [s for s in STEPS if s < len(terms)] + [len(terms)]:
            own = terms[done:step]
            of, at = expanded(self.first[own], self.first[own + 1])
            values = self.values[at]
            total += np.bincount(self.rows[at], values * weights[done:step][of], n)
            squares += np.bincount(self.rows[at], values * values, n)
            done = step
            left = np.sqrt(np.maximum(self.lengths[alive] ** 2 - squares[alive], 0.0))
            # A sliver more than the bound, for rounding.
            bound = total[alive] + rest[done] * left * (1 + 1e-9) + 1e-3 * (rest[done] > 0)
            alive = alive[bound >= least]
            if 16 * len(alive) < n:
                break
        return alive

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``dense`` has the item's weight of every term."""
        of, at = expanded(self.starts[rows], self.starts[rows + 1])
        sums = np.append(0, np.cumsum(self.impacts[at] * dense[self.terms[at]]))
        ends = offsets(self.starts[rows + 1] - self.starts[rows])
        return sums[ends[1:]] - sums[ends[:-1]]


def _buckets(batches: Iterator[pa.RecordBatch], vocabulary: int, size: int) -> Iterator[Bucket]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            sizes = np.asarray(part.column("terms").value_lengths(), np.int64)
            terms, impacts = (np.asarray(part.column(c).flatten(), np.int64) for c in ("terms", "impacts"))
            yield Bucket(part.column("id"), np.asarray(part.column("length")), sizes, terms, impacts, vocabulary)


def _search(shared, top: int, size: int = BUCKET):
    """The best rows of a task for every item, ``<item, score, id>``; the task's rows come by falling length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least, vocabulary = shared.value
        best = [Best(top, bound) for bound in least]
        open_ = [i for i, (terms, _, _) in enumerate(items) if len(terms)]
        dense = np.zeros(vocabulary, np.int64)
        for bucket in _buckets(batches, vocabulary, size):
            longest = float(bucket.lengths.max()) * (1 + 1e-9)
            open_ = [i for i in open_ if items[i][2][0] * longest >= best[i].least]
            for i in open_:
                terms, weights, rest = items[i]
                rows = bucket.survivors(terms, weights, rest, best[i].least)
                if len(rows):
                    dense[terms] = weights
                    scores = bucket.scores(rows, dense)
                    dense[terms] = 0
                    good = scores >= best[i].least
                    rows = rows[good]
                    best[i].add(scores[good], bucket.ids[rows], bucket.named[rows])
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        scores, ids, named = (np.concatenate([getattr(b, k) for b in best] or [np.zeros(0, np.int64)]) for k in ("scores", "ids", "named"))
        if len(item):
            columns = [pa.array(item.astype(np.int32)), pa.array(scores), pa.array(ids, mask=~named.astype(bool))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "score", "id"])

    return run


_FOUND = "item int, score bigint, id bigint"


def _first(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _vectors(counted: DataFrame, documents: int, words: int) -> DataFrame:
    """``<id, terms, impacts, length>`` of the rows that hold a term of the items."""
    m = F.expr(f"50 + (50 * n * {documents}L) div {words}L")
    impacts = F.transform("tf", lambda tf: F.call_function("div", 1_000_000_000 * tf, 1000 * tf + 20 * F.col("m")))
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda total, x: total + x * x))
    rows = counted.where(F.size("terms") > 0).withColumn("m", m).withColumn("impacts", impacts)
    return rows.select("id", "terms", "impacts", length.alias("length"))


def _seeds(vectors: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the longest vectors. Any choice gives a valid last place, so hot lengths are thinned by a hash."""
    level = F.floor(8 * F.log2("length"))
    left, cut, share = most, None, 1.0
    for row in sorted(vectors.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        cut, share = row["level"], min(1.0, left / row["count"])
        left -= row["count"]
        if left <= 0:
            break
    if cut is None:
        return vectors
    thinned = F.pmod(F.xxhash64("id", "length"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return vectors.where((level > cut) | ((level == cut) & thinned))


def _rank_block(docs: DataFrame, texts: list[bytes], top: int, bucket: int) -> DataFrame:
    """``<item, rank, id, score>`` for the items of one block, numbered from 0."""
    spark = docs.sparkSession
    context = spark.sparkContext
    items = Items(texts)
    counted = docs.mapInArrow(_counted(context.broadcast(items.number)), "id bigint, n bigint, terms array<int>, tf array<bigint>")
    counted = stage(counted.where("n > 0"), "counted")
    documents, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.number), np.int64)
    for row in counted.select(F.explode(F.col("terms")).alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    weighted = items.weighted(weights)
    vectors = _vectors(counted, documents, max(words, 1))

    seeds = _seeds(vectors, SEEDS).repartition(2 * context.defaultParallelism).sortWithinPartitions(F.desc("length"))
    start = context.broadcast((weighted, [1] * len(texts), len(df)))
    last = _first(seeds.mapInArrow(_search(start, top, bucket), _FOUND), top).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    least = [1] * len(texts)
    for row in last.where(F.col("n") == top).collect():
        least[row["item"]] = row["score"]
    shared = context.broadcast((weighted, least, len(df)))
    # Vectors of one length can be many, so ids share them out.
    by_length = vectors.repartitionByRange(F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"))
    found = stage(_first(by_length.mapInArrow(_search(shared, top, bucket), _FOUND), top), "ranked")
    drop_staged(counted)
    return found


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_words: int = BLOCK_WORDS,
    bucket: int = BUCKET,
) -> DataFrame:
    """``<item_id, rank, doc_id, score>``: the ``top`` best documents of every row of ``items``, best first, ties by smaller id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A null text has no terms and counts
    as no document; a document without an id comes last among equal scores; rows of repeated ids are ranked each on its own, and so is every
    row of ``items``. Documents with score 0 are not returned. Empty tables give an empty result; other columns are ignored. Items of more
    than ``block_words`` words together are searched for in blocks, each with a pass over the documents.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    out = spark.createDataFrame([], T.StructType([*schema.fields[1:], *(T.StructField(n, t) for n, t in _RANKED)]))
    for block in _blocks(items, item_col, item_text_col, block_words):
        rows = block.collect()
        if rows:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], schema)
            found = _rank_block(narrow, [bytes(r["text"]) for r in rows], top, bucket)
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out


_RANKED = (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> list[DataFrame]:
    """``<item_id, text>`` in parts of about ``most`` words at most, dealt by a hash."""
    rows = items.select(F.col(item_col).alias("item_id"), text_bytes(text_col).alias("text"))
    at_most = rows.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    n = 1 + int(at_most // most)
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
