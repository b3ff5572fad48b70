"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from themeloom.llm import periodic_runs


def plain_runs(words):
    """All runs (start, end, smallest period) of four periods or more, period by period."""
    n, stretches = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= 3 * q:
                stretches.setdefault(q, []).append((i, j + q))
            i = j
    inside = lambda s, e, q: any(q % p == 0 and any(a <= s and b >= e for a, b in stretches.get(p, ())) for p in range(1, q))
    return sorted(((s, e, q) for q, own in stretches.items() for s, e in own if not inside(s, e, q)), key=lambda r: (r[0], r[2]))


def periodic_text(rng, symbols):
    words = []
    for _ in range(rng.randrange(6)):
        block = [rng.randrange(symbols) for _ in range(rng.randrange(1, rng.choice([3, 9, 40])))]
        if rng.random() < 0.3:
            block = block[:2] * rng.randrange(1, 9) + block  # a small period inside a large one
        words += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randrange(len(block) + 1)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [periodic_text(rng, rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randrange(1, 5))]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), sizes)
        want = [(s + o, e + o, q) for t, o in zip(texts, starts.tolist()) for s, e, q in plain_runs(t)]
        assert [tuple(r) for r in got.tolist()] == want


def test_a_long_period_and_an_all_equal_text():
    words = np.array(list(range(3000)) * 5 + [7] * 50_000)
    got = periodic_runs.runs_of(words, np.array([len(words)]))
    assert got.tolist() == [[0, 15000, 3000], [15000, 65000, 1]]


def plain_result(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, q) for s, e, q in plain_runs(words) if e - s >= 6]
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        len(runs),
        *best,
        best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_on_odd_rows(spark, texts, save_tables):
    odd = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "ab cd " * 4, "A a " * 9, "    " * 5, "b c d " * 3000, "b c d " * 3000]
    docs = texts(*odd, *["w v u t s " * k for k in range(1, 40)])
    docs = docs.unionByName(docs.where("doc_id IN (5, 9)")).unionByName(docs.limit(8).withColumn("doc_id", docs.doc_id * 0 + None))
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, save_tables(documents=docs)).collect()]
    want = [(r.doc_id, *plain_result(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_an_empty_table(spark, texts):
    assert periodic_runs.periodic_runs(texts("a").limit(0)).collect() == []
