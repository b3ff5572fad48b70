"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import row_keys, slices, table, text_bytes
from themeloom.llm.components import connected_components
from themeloom.session import stage

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
BLOCKS = 5
MAX_BUCKET = 48
LONGEST_RUN = 1 << 20


def _bit_counts(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each of the 64 bits, and how many hashes there are."""
    if not words:
        return np.zeros(64, np.int64), 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    totals, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for first in range(0, n, LONGEST_RUN):
        part = words[first : min(first + LONGEST_RUN, n) + shingle - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(part) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return totals, n


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as a signed integer; 0 for a text without words."""
    totals, n = _bit_counts(text.lower().split(), shingle)
    return int(np.packbits(2 * totals > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``<id, k1, k2, fp>`` of every row. ``fp`` is a signed bigint; a null text counts as empty and gets 0. ``k1, k2`` name the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "k1", "k2"]).columns, pa.array(found, pa.int64())], ["id", "k1", "k2", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text"))
    return narrow.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, fp bigint")


def _block_keys(fp: str, blocks: int, distance: int) -> Column:
    """One key for each choice of ``blocks - distance`` blocks: fingerprints that close agree in one of them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[c] for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed).cast("bigint")).alias("bits")))
    return F.array(*keys)


def hamming_links(fps: DataFrame, distance: int = MAX_DISTANCE, blocks: int = BLOCKS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges ``<a, b>`` between the distinct values of ``fps`` ``<fp>`` that join all within ``distance`` bits.

    The 64 bits are cut into ``blocks``; two fingerprints that differ in at most ``distance`` bits agree in all but
    ``distance`` blocks, so they share a bucket for one choice of blocks. Buckets of up to ``max_bucket`` values are joined with
    themselves and verified. The values of larger buckets, however large, go another exact way: each is filed
    under all values at ``distance // 2`` bits from it. Two values within ``distance`` meet in one such place, all that
    meet are within ``distance``, and a place holds a bounded number of values, so a chain of edges per place links them.
    For an odd distance the remaining bit is allowed for by one more layer of places on one side.
    """
    keyed = fps.select("fp", F.explode(_block_keys("fp", blocks, distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stage(sizes, "blocks")
    small, hot = sizes.where(F.col("n") <= max_bucket), sizes.where(F.col("n") > max_bucket)
    members = stage(keyed.join(small.select("key"), "key"), "members")
    pairs = members.select("key", F.col("fp").alias("a")).join(members.select("key", F.col("fp").alias("b")), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    links = pairs.where((F.col("a") < F.col("b")) & near).select("a", "b")
    if hot.isEmpty():
        return links
    crowded = keyed.join(hot.select("key"), "key").select("fp").distinct()
    return links.union(_neighbour_links(crowded, distance))


def _neighbour_links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges among values at most ``distance`` bits apart, through shared places instead of pairs."""
    near, far = distance // 2, distance - distance // 2
    flips = [0] + [sum(1 << b for b in bits) for k in range(1, far + 1) for bits in combinations(range(64), k)]
    if far > 2:
        raise ValueError("distances above 4 need more blocks, not neighbour places")
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    wide = F.transform(F.array(*[F.lit(s).cast("bigint") for s in signed]), lambda f: F.col("fp").bitwiseXOR(f))
    places = fps.select("fp", F.explode(wide).alias("place"))
    if near == far:
        met = places.groupBy("place").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        return met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    within = [s for s, f in zip(signed, flips) if f.bit_count() <= near]
    closer = F.transform(F.array(*[F.lit(s).cast("bigint") for s in within]), lambda f: F.col("fp").bitwiseXOR(f))
    home = fps.select(F.col("fp").alias("b"), F.explode(closer).alias("place"))
    return home.join(places, "place").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``<id, k1, k2, fp, group, component_id>``: groups of rows whose fingerprints are linked by at most ``distance`` bits.

    ``group`` is a fingerprint of the group, ``component_id`` its smallest id, ``k1, k2`` name a row's content. Null texts and texts without words have fingerprint 0 and are linked
    like others. Rows with a null id stay and get the group's smallest id, null if it has none. Repeated rows share
    a group. An empty table gives an empty result, other columns are ignored.

    Only distinct fingerprints are linked, so any number of copies costs one row; links and groups stay in Spark.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    groups = connected_components(hamming_links(distinct.select("fp"), distance))
    named = distinct.join(groups.withColumnRenamed("v", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    leaders = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = named.where(F.col("component").isNotNull()).join(leaders, "group").select("fp", "group", "component_id")
    alone = named.where(F.col("component").isNull()).select("fp", "group", F.col("least").alias("component_id"))
    return fps.join(of_fp.union(alone), "fp").select("id", "k1", "k2", "fp", "group", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = MAX_DISTANCE
) -> DataFrame:
    """``docs`` with one row of each SimHash group: the one with the smallest id, any other before one without an id.

    Of rows that agree in id and text one stays.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, distance)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("first"))
    k1, k2 = row_keys(id_col, text_col)
    inside = docs.select(F.struct("*").alias("row"), k1, k2)
    kept = inside.join(first.select("first.k1", "first.k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return kept.select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
