"""Ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import ranked_search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranking(docs, items, top=50):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(plain_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // words
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k, i, s) for k, (s, i) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture
def corpus(texts):
    words = [f"W{i * i % 97}-x{i % 7}" for i in range(400)]
    own = [" ".join(words[i : i + 3 + i % 40]) for i in range(0, 390, 3)]
    return texts(None, "", "?! ...", "Ünï w4 W4 w4", "w4 x4", "w4 x4", "x1 " * 5000, *own, *own[:30], "x2 " * 9)


ITEMS = [(7, "w4 X4 x1"), (7, "w4 X4 x1"), (8, None), (None, "x2 x3 nothing"), (9, "ünï W16 w25 w36 x6 w4 x4 x5 x1 x2 w1 w9"), (10, "absent")]


@pytest.mark.parametrize("bucket, block_words", [(4096, 1_000_000), (16, 1_000_000), (16, 3)])
def test_ranking_equals_brute_force(spark, corpus, monkeypatch, bucket, block_words):
    monkeypatch.setattr(ranked_search, "SEEDS", 20)
    docs = corpus.unionByName(corpus.limit(20)).unionByName(corpus.limit(9).withColumn("doc_id", corpus.doc_id * 0 + None))
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id int, text string, doc_id string")
    for top in (5, 50):
        found = ranked_search.rank_documents(docs, items, top=top, block_words=block_words, bucket=bucket)
        assert dict(found.dtypes)["item_id"] == "int"
        got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)
        assert got == plain_ranking([(r.doc_id, r.text) for r in docs.collect()], ITEMS, top)


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in ranked_search.table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in ranked_search.table(spark, sf_dir, "benchmark").collect()]
    got = [tuple(r) for r in ranked_search.op11_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain_ranking(docs, items)


def test_empty_tables(spark, corpus):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert ranked_search.rank_documents(corpus.limit(0), items).collect() == []
    assert ranked_search.rank_documents(corpus, items.limit(0)).collect() == []
    assert ranked_search.rank_documents(corpus, items.where("text IS NULL")).collect() == []


def test_bounds_leave_rows_and_buckets_out():
    """Rows with the heavy coordinates stay, rows that cannot reach the last place go before all terms are summed."""
    heavy, light = [(0, 900), (1, 900)], [(2, 500)]
    rows = [heavy] * 10 + [light] * 90
    sizes = np.array([len(r) for r in rows])
    flat = np.array([x for r in rows for x in r])
    lengths = np.array([math.sqrt(sum(v * v for _, v in r)) for r in rows])
    bucket = ranked_search.Bucket(pa.array(range(100)), lengths, sizes, flat[:, 0], flat[:, 1], 12)
    items = ranked_search.Items([b"a b c d e f g h i j k l"])
    (terms, weights, rest), = items.weighted(np.array([100, 90, 80, 7, 6, 5, 4, 3, 3, 3, 3, 3]))
    least = 900 * 190
    assert bucket.survivors(terms, weights, rest, least).tolist() == list(range(10))
    assert bucket.survivors(terms, weights, rest, least + 1).tolist() == []
    dense = np.zeros(12, np.int64)
    dense[terms] = weights
    assert bucket.scores(np.array([0, 99]), dense).tolist() == [900 * 190, 500 * 80]
    assert rest[0] * 500 < least  # a bucket of light rows alone is skipped whole
