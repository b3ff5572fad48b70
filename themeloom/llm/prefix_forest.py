"""Approximate nearest neighbours by inner product: forests of sorted hash strings, searched by prefix.

Rows are dealt to shards of bounded size, and a task builds a forest over its shard. In every tree a row gets a hash string: the vector is
turned by a random rotation of the tree's own, and the digits name its largest coordinates with their signs, largest first. A tree is the
sorted array of these strings, so the rows that share a prefix with a query lie side by side. A query descends in all trees to its
longest matches and then ascends in all of them together, one digit at a time, until the prefixes cover enough rows; their union is
rescored by the exact product. Strings are of the vectors less the shard's mean, which sets crowded directions apart. A longer vector has
larger products, so vectors get one more coordinate that makes all of a shard equally long (queries have 0 there).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from themeloom.llm.common import table, worker_state
from themeloom.llm.embedding_dedup import _matrix, usable
from themeloom.session import drop_staged, stage

TOP = 20
EVERY = 20
SHARD = 1 << 14
QUERIES = 1 << 13
TREES = 48
TURNED = 64
DIGITS = 6
# The ascent ends once the prefixes cover so many rows, or this share of the shard; a row counts once for every tree.
LEAST_COVERED, COVERED = 4000, 0.3
SEED = 12


def rotations(width: int, trees: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns for each tree, at most ``TURNED`` of them."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((width, min(width, TURNED))))[0] for _ in range(trees)]).astype(np.float32)


class Strings:
    """Hash strings of vectors as numbers; the first digit is the highest."""

    def __init__(self, width: int, trees: int = TREES):
        self.turns = rotations(width, trees)
        columns = self.turns.shape[2]
        self.bits = int(2 * columns - 1).bit_length()
        self.digits = min(DIGITS, columns, 62 // self.bits)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """One line per tree, one string per row."""
        out = np.zeros((len(self.turns), len(rows)), np.int64)
        place = np.arange(len(rows))
        for tree, turn in enumerate(self.turns):
            turned = rows @ turn
            size = np.abs(turned)
            for _ in range(self.digits):
                axis = size.argmax(axis=1)
                out[tree] = (out[tree] << self.bits) | (2 * axis + (turned[place, axis] > 0))
                size[place, axis] = -1.0
        return out

    def prefix(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest string with the same first ``length`` digits."""
        shift = self.bits * (self.digits - length)
        low = (codes >> shift) << shift
        return low, low + (1 << shift) - 1


class Forest:
    """The trees over one shard."""

    def __init__(self, strings: Strings, rows: np.ndarray):
        codes = strings.of(rows)
        self.strings, self.size = strings, len(rows)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def _ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the prefixes of some queries begin and end in every tree."""
        low, high = self.strings.prefix(codes, length)
        first = [np.searchsorted(own, a, "left") for own, a in zip(self.sorted, low)]
        last = [np.searchsorted(own, b, "right") for own, b in zip(self.sorted, high)]
        return np.array(first), np.array(last)

    def longest_match(self, codes: np.ndarray) -> np.ndarray:
        """Digits that each query shares with its longest match in any tree: that is beside its place in the sorted array."""
        best = np.zeros(codes.shape[1], np.int64)
        for own, query in zip(self.sorted, codes):
            at = np.searchsorted(own, query)
            for beside in (np.maximum(at - 1, 0), np.minimum(at, self.size - 1)):
                differ = own[beside] ^ query
                digits = np.zeros(len(query), np.int64)
                for length in range(1, self.strings.digits + 1):
                    digits += differ >> (self.strings.bits * (self.strings.digits - length)) == 0
                best = np.maximum(best, digits)
        return best

    def candidates(self, rows: np.ndarray, enough: int):
        """For every query its row numbers: descent to the longest match, then ascent in all trees at once."""
        codes = self.strings.of(rows)
        found: list[np.ndarray | None] = [None] * len(rows)
        level = self.longest_match(codes)
        waiting = np.arange(len(rows))
        for length in range(self.strings.digits, 0, -1):
            now = waiting[level[waiting] >= length]
            if not len(now):
                continue
            first, last = self._ranges(codes[:, now], length)
            done = (last - first).sum(axis=0) >= enough
            for k in np.flatnonzero(done):
                marked = np.zeros(self.size, bool)
                marked[np.concatenate([own[a:b] for own, a, b in zip(self.order, first[:, k], last[:, k])])] = True
                found[now[k]] = np.flatnonzero(marked)
            waiting = np.setdiff1d(waiting, now[done], assume_unique=True)
        # What is left has reached the roots, below which all rows lie.
        return [np.arange(self.size) if f is None else f for f in found]


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last, so that equal vectors get equal numbers."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def _hashed(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is hashed: both sides less the rows' mean, rows with the coordinate that makes them equally long, queries by direction."""
    scale = np.abs(rows).max()
    middle = (rows / scale).mean(axis=0)
    spread = rows / scale - middle
    longest = max(np.sqrt((spread**2).sum(axis=1)).max(), np.finfo(float).tiny)
    spread /= longest
    rest = np.sqrt(np.maximum(1 - (spread**2).sum(axis=1), 0))
    asked = _unit(queries / scale - middle)
    return (
        np.concatenate([spread, rest[:, None]], axis=1).astype(np.float32),
        np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32),
    )


def _search(width: int, top: int, trees: int, least: int, share: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = (t.rename_columns(["shard", "block", "id", "key", "v"]) for t in (left, right))
        out: dict[str, list[np.ndarray]] = {"query": [], "id": [], "score": []}
        key, null_id = [], []
        if rows.num_rows and queries.num_rows:
            x, q = (_matrix(t.column("v").combine_chunks(), width) for t in (rows, queries))
            ids, named = (np.asarray(rows.column("id").fill_null(0)), np.asarray(rows.column("id").is_valid()))
            own, keys = np.asarray(queries.column("id")), np.asarray(queries.column("key"))
            strings = worker_state("forest", (width, trees), lambda: Strings(width + 1, trees))
            placed, asked = _hashed(x, q)
            for k, near in enumerate(Forest(strings, placed).candidates(asked, max(least, int(share * len(x))))):
                near = near[(ids[near] != own[k]) | ~named[near]]
                scores = np.einsum("ij,j->i", x[near], q[k])
                if len(near) > top:
                    last = np.partition(scores, len(scores) - top)[len(scores) - top]
                    near = near[scores >= last - 1e-9 * max(1.0, abs(last))]
                scores = products(x[near], q[k])
                by = np.lexsort((ids[near], ~named[near], -scores))[:top]
                out["query"].append(np.full(len(by), own[k]))
                out["id"].append(ids[near][by])
                out["score"].append(scores[by])
                key.append(np.full(len(by), keys[k]))
                null_id.append(~named[near][by])
        flat = {c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in out.items()}
        mask = np.concatenate(null_id) if null_id else np.zeros(0, bool)
        keys = np.concatenate(key) if key else np.zeros(0, np.int64)
        return pa.table({"query": flat["query"], "key": keys, "id": pa.array(flat["id"], mask=mask), "score": flat["score"]})

    return run


def nearest(
    embeddings: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = TOP,
    trees: int = TREES,
    shard: int = SHARD,
    block: int = QUERIES,
    least: int = LEAST_COVERED,
    share: float = COVERED,
) -> DataFrame:
    """``<query_id, rank, id, score>``: for every row of ``queries`` the ``top`` rows of the largest inner product that the forest finds.

    Every row is in the forest of one shard, and every query asks all shards, a block of queries at a time. Rows with the query's id are its
    own and left out; ties go to the smaller id, a null id comes last. Null, empty and zero vectors and such with null or non-finite
    components take no part on either side, nor do queries without an id; of vectors of different lengths the shorter counts as filled up with
    zeros. Equal query rows are one query; different vectors under one id are queries of their own. Of equal vectors only the
    ``top + 1`` smallest ids can be among the nearest, so a group of copies costs no more than these. Empty tables give an empty
    result; other columns are ignored.
    """
    spark = embeddings.sparkSession

    def vectors(df: DataFrame) -> DataFrame:
        narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
        return narrow.where(usable("v")).withColumn("key", F.xxhash64("v"))

    same = Window.partitionBy("key", F.xxhash64(F.lit(5), "v")).orderBy(F.asc_nulls_last("id"))
    rows = vectors(embeddings).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= top + 1).drop("copy")
    rows = stage(rows, "vectors")
    asked = stage(vectors(queries).where("id IS NOT NULL").dropDuplicates(["id", "key"]), "queries")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, asked_width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // shard))
    blocks = max(1, -(-m // block), -(-2 * spark.sparkContext.defaultParallelism // shards))
    dealt = F.pmod(F.xxhash64(F.lit(3), "id", "key"), F.lit(shards)).alias("shard")
    asking = F.pmod(F.xxhash64(F.lit(4), "id", "key"), F.lit(blocks)).alias("block")
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard")
    left = rows.select(dealt, every_block, "id", "key", "v")
    right = asked.select(every_shard, asking, "id", "key", "v").select("shard", "block", "id", "key", "v").toDF("s", "b", "i", "k", "w")
    run = _search(max(width, asked_width), top, trees, least, share)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("s", "b"))
    found = stage(found.applyInArrow(run, "query bigint, key bigint, id bigint, score double"), "near")
    order = Window.partitionBy("query", "key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    drop_staged(rows, asked)
    return ranked.select(F.col("query").alias("query_id"), "rank", "id", "score")


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0)).withColumnRenamed("id", "vec_id")
