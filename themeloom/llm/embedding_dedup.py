"""Near-duplicate embeddings: an exact cosine join by tiles of principal coordinates.

Distinct vectors are scaled to length 1 and turned so that the leading coordinates carry most of the spread (principal components of
all vectors). Vectors with like leading coordinates share a tile of bounded size. Two tiles are compared only if their boxes of
leading coordinates are near enough for a pair to reach the cosine. Inside a comparison, products are summed over the leading
coordinates first; what the rest can add is at most the product of the suffix norms, and pairs that cannot reach the
cosine are dropped before the rest is multiplied. What comes out of a comparison are sums and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import table
from themeloom.llm.components import connected_components
from themeloom.session import drop_staged, stage

COSINE = 0.9
TILE = 4096
BOXED = 6
CELL = 0.25
STEPS = (8, 16, 32)
SLACK = 1e-9
SALTS = 64


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter lists are filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes (as columns) of the unit vectors, by falling spread. The sums behind them have a fixed size per task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width + 1, width + 1)), 0
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([_unit(_matrix(batch.column("v"), width)), np.ones((batch.num_rows, 1))], axis=1)
                total += rows.T @ rows
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    sums = vectors.select("v").mapInArrow(moments, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros((width + 1) ** 2)
    for row in sums.collect():
        total[row["cell"]] = row["value"]
    total = total.reshape(width + 1, width + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1]


def _place(width: int, axes: np.ndarray):
    """Leading coordinates of each vector and the cell that the first two lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = _unit(_matrix(batch.column("v"), width)) @ axes[:, : min(BOXED, width)]
            cells = np.floor(lead[:, :2] / CELL).astype(np.int64)
            code = cells[:, 0] * 1000 + (cells[:, 1] if width > 1 else 0)
            lists = pa.ListArray.from_arrays(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), lists], [*batch.schema.names, "cell", "lead"])

    return run


def _near_tiles(tiles: DataFrame, most: float) -> DataFrame:
    """Pairs ``<pair, a, b>`` of tiles (a <= b) whose boxes are at most ``most`` apart.

    Tiles meet in slabs of the first coordinate: a tile is filed under its slab and looked for in those next to it.
    """
    slab = F.floor(F.col("low")[0] / most)
    last = F.floor(F.col("high")[0] / most)
    filed = tiles.select("tile", "low", "high", F.explode(F.sequence(slab, last)).alias("slab"))
    wanted = tiles.select(
        F.col("tile").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.explode(F.sequence(slab - 1, last + 1)).alias("slab")
    )
    gaps = F.zip_with(
        F.zip_with("low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    near = filed.join(wanted, "slab").where((F.col("tile") <= F.col("b")) & (apart <= most * most))
    return near.select(F.col("tile").alias("a"), "b").distinct().withColumn("pair", F.concat_ws("|", "a", "b"))


def _hits(x: np.ndarray, y: np.ndarray, rotated: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of unit matrices with at least the cosine; ``rotated`` are the same rows on the principal axes."""
    u, v = rotated
    width, at = u.shape[1], 0
    total, open_ = np.zeros((len(u), len(v))), None
    for cut in [c for c in STEPS if c < width] + [width]:
        rest = [np.sqrt(np.maximum((m[:, cut:] ** 2).sum(axis=1), 0)) for m in (u, v)]
        if open_ is None:
            total += u[:, at:cut] @ v[:, at:cut].T
            possible = total + rest[0][:, None] * rest[1][None, :] >= cosine - SLACK
            if possible.mean() < 0.02:
                i, j = np.nonzero(possible)
                open_ = (i, j, total[i, j])
        else:
            i, j, sums = open_
            sums = sums + np.einsum("ij,ij->i", u[i, at:cut], v[j, at:cut])
            keep = sums + rest[0][i] * rest[1][j] >= cosine - SLACK
            open_ = (i[keep], j[keep], sums[keep])
        if open_ is not None and not len(open_[0]):
            return open_[0], open_[1]
        at = cut
    if open_ is None:
        i, j = np.nonzero(total >= cosine - SLACK)
    else:
        i, j, _ = open_
    # The decision is on the given vectors, in blocks.
    sure = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        sure[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= cosine
    return i[sure], j[sure]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each of n places, by label passing and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(width: int, axes: np.ndarray, cosine: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.rename_columns(["pair", "rep", "n", "v", "tile"]) for t in (left, right))
        xs, ys = (_unit(_matrix(t.column("v").combine_chunks(), width)) if t.num_rows else np.zeros((0, width)) for t in (left, right))
        ids = [np.asarray(t.column("rep"), np.int64) for t in (left, right)]
        weights = [np.asarray(t.column("n"), np.int64) for t in (left, right)]
        same = bool(left.num_rows) and left.column("tile")[0] == right.column("tile")[0]
        u, v = xs @ axes, ys @ axes
        found = [_hits(xs[a : a + 1024], ys, (u[a : a + 1024], v), cosine) for a in range(0, len(xs), 1024)]
        i = np.concatenate([np.zeros(0, np.int64), *[a * 1024 + hit[0] for a, hit in enumerate(found)]])
        j = np.concatenate([np.zeros(0, np.int64), *[hit[1] for hit in found]])
        if same:
            # Every pair was met from both sides, and every vector met itself.
            off = i != j
            i, j = i[off], j[off]
            own = np.bincount(i, weights[1][j], len(xs))
            links, place = own, ids[0]
            a, b = i, j
        else:
            links = np.concatenate([np.bincount(i, weights[1][j], len(xs)), np.bincount(j, weights[0][i], len(ys))])
            place = np.concatenate(ids)
            a, b = i, len(xs) + j
        order = np.argsort(place)
        rank = np.empty(len(place), np.int64)
        rank[order] = np.arange(len(place))
        root = place[order][_roots(len(place), rank[a], rank[b])[rank]] if len(place) else place
        hit = links > 0
        return pa.table({"rep": place[hit], "links": links[hit].astype(np.int64), "root": root[hit]})

    return run


def cosine_groups(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """``<id, n_links, component_id>`` of every row: how many other vectors have at least ``cosine``, and the smallest id reachable.

    All pairs are considered, whatever their labels, in double precision. Null, empty and zero vectors and such with null or non-finite
    components link with nothing and are components of their own; of vectors of different lengths the shorter counts as filled up with
    zeros. Equal vectors are one vector with a count. Rows with a null id stay and count as links; their component has the smallest
    id that is not null, or none. An empty table gives an empty result; other columns are ignored.
    """
    base = embeddings.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.withColumn("ok", usable("v"))
    groups = base.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    distinct = stage(groups.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    width = distinct.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return base.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    axes = principal_axes(distinct, width)
    fields = "rep bigint, n bigint, v array<double>, cell bigint, lead array<double>"
    placed = distinct.select("rep", "n", "v").mapInArrow(_place(width, axes), fields)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    # Cells are a grid over two coordinates between -1 and 1, so this table has at most a hundred rows.
    tiled = placed.join(F.broadcast(sizes), "cell")
    name = F.concat_ws(".", "cell", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tiled = stage(tiled.select("rep", "n", "v", "lead", name.alias("tile")), "tiles")
    lead = range(min(BOXED, width))
    boxes = tiled.groupBy("tile").agg(
        F.array(*[F.min(F.col("lead")[k]) for k in lead]).alias("low"), F.array(*[F.max(F.col("lead")[k]) for k in lead]).alias("high")
    )
    pairs = stage(_near_tiles(boxes, float(np.sqrt(2 - 2 * cosine)) + 1e-6), "tile_pairs")
    sides = []
    for side in ("a", "b"):
        sent = tiled.select("rep", "n", "v", "tile").join(pairs.select(F.col(side).alias("tile"), "pair"), "tile")
        # New names, as both sides are grouped in one plan.
        sides.append(sent.select(*[F.col(c).alias(f"{side}_{c}") for c in ("pair", "rep", "n", "v", "tile")]).groupBy(f"{side}_pair"))
    found = sides[0].cogroup(sides[1]).applyInArrow(_compare(width, axes, cosine), "rep bigint, links bigint, root bigint")
    found = stage(found, "links")
    drop_staged(tiled, pairs)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = distinct.select("v", "n", "least", "rep").join(links, "rep", "left").join(components.withColumnRenamed("v", "rep"), "rep", "left")
    named = stage(named.select("v", "n", "least", "links", "component", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")), "named")
    # A component can hold a third of all vectors: what it gets back stands once for each salt.
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    salted = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    alone = named.where("component IS NULL").select("v", n_links, F.col("least").alias("component_id"))
    named = named.where("component IS NOT NULL").join(salted, ["component", "salt"]).select("v", n_links, "component_id").unionByName(alone)
    linked = base.where("ok").join(named, "v").select("id", "n_links", "component_id")
    return linked.unionByName(base.where("NOT ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cosine_groups(table(spark, sf_dir, "embeddings"))
    return groups.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
