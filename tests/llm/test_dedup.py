"""SimHash, embedding and substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from themeloom.llm import embedding_dedup, simhash, substring_dedup
from themeloom.llm.common import table
from themeloom.llm.components import connected_components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7000, 7000)]
    edges += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(150)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for edge in edges for x in edge}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- simhash ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in table(spark, sf_dir, "documents").collect()}
    ids = sorted(docs)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (docs[a] ^ docs[b]).bit_count() <= 2]
    group = roots(ids, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{docs[i]:016x}", group[i]) for i in ids}


def test_hot_buckets_lose_no_link(spark):
    random.seed(2)
    values = set()
    for base in [random.getrandbits(64) for _ in range(6)]:
        for _ in range(40):
            x = base
            for _ in range(random.randrange(5)):
                x ^= 1 << random.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    mask = (1 << 64) - 1
    near = {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 2}
    for most in (48, 3):
        found = simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"), max_bucket=most).collect()
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in found}
        assert got <= near
        assert roots(values, got) == roots(values, near)


def test_odd_distances_in_hot_buckets(spark):
    random.seed(3)
    values = {5 ^ sum(1 << b for b in random.sample(range(62), random.randrange(4))) for _ in range(60)}
    near = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 1}
    found = simhash._neighbour_links(spark.createDataFrame([(v,) for v in values], "fp long"), 1).collect()
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in found}
    assert got <= near and roots(values, got) == roots(values, near)


def test_simhash_edge_cases(spark, texts):
    docs = texts(None, "", " \t", "one", "One", "a b", "a b c d", "a b c d", "x " * 200)
    got = {r.id: (r.fp, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert len(got) == 9
    assert [got[i] for i in (0, 1, 2)] == [(0, 0)] * 3
    assert got[3] == got[4] and got[6] == got[7]
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, "p q r s"), (None, "p q r s"), (4, "p q r s"), (4, "p q r s")], "doc_id bigint, text string")
    assert {r.component_id for r in simhash.simhash_groups(nameless).collect()} == {4}
    kept = simhash.drop_near_duplicates(nameless.unionByName(nameless.limit(0)))
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(4, "p q r s")]
    assert sorted(simhash.drop_near_duplicates(docs).columns) == sorted(docs.columns)


# --- embeddings -------------------------------------------------------------------------------------


def plain_groups(vectors, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    width = max((len(v) for v, o in zip(vectors, ok) if o), default=0)
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if ok[i]:
            scaled = np.array(v) / np.abs(v).max()
            rows[i, : len(v)] = scaled / np.linalg.norm(scaled)
    near = (rows @ rows.T >= cosine) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    group = roots(range(len(vectors)), zip(*np.nonzero(near)))
    return {i: (int(near[i].sum()), group[i]) for i in range(len(vectors))}


def test_cosine_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 6))
    vectors = [list(map(float, base[rng.integers(30)] + rng.standard_normal(6) * rng.choice([0, 0.1, 0.3]))) for _ in range(500)]
    vectors += [None, [], [0.0] * 6, [1.0, None], [float("nan")] * 6, [float("inf"), 1.0], [1e300] * 6, [1e-300] * 6, [2.0], [3.0, 0.0]]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, v string, tile int")
    for tile in (4096, 60):
        got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.cosine_groups(df, tile=tile).collect()}
        assert got == plain_groups(vectors)
    assert embedding_dedup.cosine_groups(df.limit(0)).collect() == []
    only_bad = embedding_dedup.cosine_groups(df.where("vec_id BETWEEN 500 AND 505")).collect()
    assert {(r.id, r.n_links, r.component_id) for r in only_bad} == {(i, 0, i) for i in range(500, 506)}


def test_pruned_products_find_the_same_pairs():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 48)) * np.linspace(3, 0.1, 48)
    x = np.concatenate([x, x[:40] + 0.02 * rng.standard_normal((40, 48))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(x.T))
    i, j = embedding_dedup._hits(x, x, (x @ axes[:, ::-1],) * 2, 0.9)
    assert set(zip(i, j)) == set(zip(*np.nonzero(x @ x.T >= 0.9)))


def test_embedding_query_counts_equal_vectors(spark, save_tables):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)]
    folder = save_tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op4_embedding_dedup(spark, folder).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), None: (3, 1, None), 5: (0, 5, True)}


# --- substrings -------------------------------------------------------------------------------------


def plain_removal(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_query_equals_brute_force(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op9_substring_dedup(spark, sf_dir).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain_removal([r.text for r in rows], 35)))


def test_substring_adversaries(spark, texts):
    """Shared passages of all lengths at all places, periodic texts, copies with edits, repeated and empty rows."""
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    shared = [random.choice(words) for _ in range(60)]
    made = [None, "", " \n", "a " * 90, "a " * 34, "a b " * 40, "a b c " * 30]
    for _ in range(60):
        own = [random.choice(words) for _ in range(random.randrange(5, 90))]
        a = random.randrange(60)
        part = shared[a : a + random.randrange(5, 60)]
        at = random.randrange(len(own))
        made.append(" ".join(own[:at] + part + own[at:]))
    base = [random.choice(words) for _ in range(120)]
    for _ in range(20):
        copy = list(base)
        for _ in range(random.randrange(3)):
            copy[random.randrange(120)] = random.choice(words)
        made.append(" ".join(copy))
    made += made[10:14]
    for window, anchor in ((35, 8), (12, 4), (12, 12)):
        found = substring_dedup.remove_repeated(texts(*made), window=window, anchor=anchor).collect()
        got = {r.id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found}
        assert got == dict(enumerate(plain_removal(made, window)))
    same = spark.createDataFrame([(1, "x y z " * 20), (1, "x y z " * 20), (None, "q r s t u v w")], "doc_id bigint, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(same).collect()) == [(7, 0), (60, 60), (60, 60)]
    assert substring_dedup.remove_repeated(texts("a").limit(0)).collect() == []


def test_pairs_at_the_cosine_link(spark):
    """Products that are the threshold to the last bit, and one unit below it."""
    rows = [(1, [1.0, 0.0]), (2, [0.9, np.sqrt(1 - 0.81)]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    unit = embedding_dedup._unit(np.array([v for _, v in rows], float))
    exact = float(unit[0] @ unit[1])
    for cosine, links in ((exact, 1), (np.nextafter(exact, 2), 0)):
        got = {r.id: r.n_links for r in embedding_dedup.cosine_groups(df, cosine=cosine).collect()}
        assert got == {1: links, 2: links, 3: 0}


def test_a_component_of_most_vectors(spark):
    rng = np.random.default_rng(5)
    near = np.array([1.0] + [0.0] * 7) + 0.02 * rng.standard_normal((300, 8))
    rows = [*enumerate(near.tolist()), *((1000 + i, v) for i, v in enumerate(rng.standard_normal((40, 8)).tolist()))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.cosine_groups(df).collect()}
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.9
    root = roots(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(links)) if i != j])
    assert got == {k: (int(links[i].sum()) - 1, root[k]) for i, k in enumerate(ids)}
    assert sum(c == 0 for _, c in got.values()) >= 300
