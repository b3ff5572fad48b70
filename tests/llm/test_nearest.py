"""The prefix forest against brute force: exact on small shards, recall on large ones, odd rows."""

import math
from functools import reduce
from operator import add, mul

import numpy as np
import pytest

from themeloom.llm import prefix_forest


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_nearest(rows, every, top):
    """Sorted (query, rank, id, score) by plain sums, component by component."""
    rows = [(i, v) for i, v in rows if usable(v)]
    out = []
    for qi, q in {(i, tuple(v)) for i, v in rows if i is not None and i % every == 0}:
        found = [(reduce(add, map(mul, q, v)), i) for i, v in rows if i is None or i != qi]
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(qi, k, i, s) for k, (s, i) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def found(spark, rows, kind="array<double>", **options):
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], f"vec_id bigint, embedding {kind}, key int, shard int, block int")
    got = prefix_forest.nearest(df, df.where("vec_id % 20 = 0"), **options)
    return [(r.query_id, r["rank"], r.id, r.score) for r in got.collect()]


@pytest.mark.parametrize("shard, block", [(1 << 14, 1 << 13), (37, 5)])
def test_small_tables_are_exact(spark, shard, block):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((240, 7)).round(2) * rng.integers(1, 4, (240, 1)))]
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # a group of copies, of a query too
    rows += [(None, rows[40][1]), (None, [1.0] * 7), (None, rows[40][1]), (40, rows[40][1]), (60, [2.0, 1.0])]
    rows += [(400, None), (401, []), (420, [0.0] * 7), (403, [None] * 7), (440, [float("nan")] * 7), (405, [float("inf")] + [0.0] * 6)]
    rows += [(500, [1e-300] * 7), (501, [3.0])]
    got = found(spark, rows, shard=shard, block=block)
    assert sorted(got, key=repr) == plain_nearest(rows, 20, 20)


def test_float_columns_and_empty_tables(spark):
    rows = [(i, [0.1 * i, 1.0]) for i in range(5)]
    wide = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(found(spark, rows, "array<float>", top=3), key=repr) == plain_nearest(wide, 20, 3)
    assert found(spark, rows[:1]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


def crowd(rng, shape):
    vectors = rng.standard_normal(shape)
    vectors[: len(vectors) // 3] = vectors[0] + 0.1 * vectors[: len(vectors) // 3]  # a third are near copies
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = crowd(rng, (30_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    got: dict[int, set[int]] = {}
    for r in prefix_forest.nearest(df, asked).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = []
    for q in range(0, len(vectors), 100):
        scores = vectors @ vectors[q]
        scores[q] = -2
        hits.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
        assert len(got[q]) == 20
    assert np.mean(hits) >= 0.9 and np.mean(hits[:100]) >= 0.9 and np.mean(hits[100:]) >= 0.9


@pytest.mark.parametrize("lengths", [False, True])
def test_a_shard_is_not_read_whole(lengths):
    """Below the reached prefixes lies a part of the shard, and the nearest rows are in it."""
    rng = np.random.default_rng(5)
    rows, queries = crowd(rng, (14_000, 64)), crowd(rng, (300, 64))
    if lengths:
        rows *= rng.uniform(0.9, 1.1, (len(rows), 1))
    placed, asked = prefix_forest._hashed(rows, queries)
    near = prefix_forest.Forest(prefix_forest.Strings(65), placed).candidates(asked, 4200)
    scores = queries @ rows.T
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([np.isin(b, own).mean() for b, own in zip(best, near)]) >= 0.9
    if not lengths:
        assert np.mean([len(own) for own in near]) < 0.5 * len(rows)


def test_longest_match_is_that_of_a_plain_search():
    rng = np.random.default_rng(6)
    strings = prefix_forest.Strings(6, trees=3)
    rows, queries = rng.standard_normal((400, 6)).astype(np.float32), rng.standard_normal((30, 6)).astype(np.float32)
    forest, codes, asked = prefix_forest.Forest(strings, rows), strings.of(rows), strings.of(queries)

    def shared(a, b):
        for length in range(strings.digits, 0, -1):
            if (a ^ b) >> strings.bits * (strings.digits - length) == 0:
                return length
        return 0

    want = [max(shared(int(codes[t, i]), int(asked[t, k])) for t in range(3) for i in range(400)) for k in range(30)]
    assert forest.longest_match(asked).tolist() == want
