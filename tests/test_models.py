import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions.text import tokenize_alpha
from themeloom.operators import clusters, features, quality, ranking, topics
from themeloom.session import stage


def packed(spark, x, parts=3):
    rows = []
    for i, row in enumerate(x):
        js = np.flatnonzero(row)
        rows.append((i, js.tolist(), row[js].tolist()))
    return spark.createDataFrame(rows, "doc_id bigint, indices array<int>, values array<double>").repartition(parts)


@pytest.fixture(scope="module")
def mixture():
    """Rows that mix three sparse topics, one empty row included."""
    rng = np.random.default_rng(5)
    h = rng.random((3, 40)) * (rng.random((3, 40)) < 0.4)
    w = rng.random((60, 3)) * (rng.random((60, 3)) < 0.6)
    return np.vstack([w @ h, np.zeros(40)])


@pytest.mark.parametrize("start", ["spectral", "random"])
def test_topics_factorise(spark, mixture, start):
    x = packed(spark, mixture)
    model = topics.fit_topics(x, 40, 3, 42, 150, tol=1e-7, start=start)
    assert (model.components >= 0).all()
    losses = np.array(model.losses)
    rises = np.flatnonzero(np.diff(losses) > 1e-6 * losses[0]) + 1
    assert all(losses[r + 1] < losses[r] for r in rises if r + 1 < len(losses))  # a step too far is taken back
    assert losses[-1] <= losses.min() + 1e-6 * losses[0]
    assert losses[-1] < 0.02 * (mixture**2).sum()
    w = np.array([r.w for r in model.transform(x).orderBy("doc_id").collect()])
    assert w.shape == (61, 3) and (w >= 0).all() and not w[-1].any()
    assert ((mixture - w @ model.components) ** 2).sum() == pytest.approx(losses[-1], rel=0.05, abs=1e-3)


def test_topics_do_not_depend_on_partitions(spark, mixture):
    one = topics.fit_topics(packed(spark, mixture, 1), 40, 3, 7, 20)
    many = topics.fit_topics(packed(spark, mixture, 6), 40, 3, 7, 20)
    np.testing.assert_allclose(one.components, many.components, atol=1e-6)


@pytest.mark.parametrize("k", range(1, 8))
def test_matching_equals_brute_force(k):
    rng = np.random.default_rng(k)
    for gain in (rng.random((k, k)), rng.integers(0, 3, (k, k)).astype(float), np.zeros((k, k))):
        match = topics.best_matching(gain)
        assert sorted(match.tolist()) == list(range(k))
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(k)))
        assert gain[np.arange(k), match].sum() == pytest.approx(best)


def test_stability_matches_topics_one_to_one(spark):
    """Both topics of one seed are nearest to the same topic of the other; only one of them gets it."""
    terms = list("abcdef")
    made = lambda rows: topics.TopicModel(np.array(rows, float))
    first, second = made([[9, 8, 7, 0, 0, 0], [9, 8, 0, 6, 0, 0]]), made([[9, 8, 7, 6, 0, 0], [0, 0, 0, 0, 5, 4]])
    table = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    holder = type("Words", (), {"table": lambda self, _: table})()
    got = topics.topic_stability({1: (first, holder), 2: (second, holder)}, spark, 4).collect()
    assert {(r.seed, r.topic): r.other_topic for r in got} in ({(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 1}, {(1, 0): 1, (1, 1): 0, (2, 0): 1, (2, 1): 0})
    assert sorted(r.overlap for r in got) == [0.0, 0.0, 0.75, 0.75]


def test_topics_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.random((30, 700)) * (rng.random((30, 700)) < 0.1)
    model = topics.fit_topics(packed(spark, x), 700, 4, 1, 3)
    wx, ww = topics._sum_over_rows(
        packed(spark, x), 700, 4, lambda n, r, c, v: topics._project(n, r, c, v, model.components.T)
    )
    w = x @ model.components.T
    np.testing.assert_allclose(wx, w.T @ x, atol=1e-9)
    np.testing.assert_allclose(ww, w.T @ w, atol=1e-9)


def test_topics_refuse_an_empty_matrix(spark):
    with pytest.raises(ValueError):
        topics.fit_topics(packed(spark, np.zeros((3, 5))), 5, 2)


def test_least_squares_meets_its_optimality_conditions(monkeypatch):
    rng = np.random.default_rng(2)
    h = rng.random((6, 30))
    x = rng.random((20, 30))
    h[4] = h[3]  # two equal topics, and one that no row can use
    h[5] = 0
    x[0] = -x[0]
    for many in (1 << 21, 40):
        monkeypatch.setattr(topics, "PIVOT_CELLS", many)
        w = topics.nonnegative_least_squares(x @ h.T, h @ h.T)
        slope = w @ h @ h.T - x @ h.T
        assert (w >= 0).all() and not w[0].any() and not w[:, 5].any()
        assert (slope >= -1e-8).all() and np.abs(slope * w).max() < 1e-8


def test_pivoting_agrees_with_long_sweeps():
    rng = np.random.default_rng(3)
    h, x = rng.standard_normal((12, 15)), rng.standard_normal((300, 15))
    w = topics.nonnegative_least_squares(x @ h.T, h @ h.T)
    np.testing.assert_allclose(w, topics.coordinate_sweeps(x @ h.T, h @ h.T, 100_000), atol=1e-5)


@pytest.mark.parametrize("start", ["spectral", "random"])
def test_fit_ends_by_the_gradient_and_near_a_long_run(spark, start):
    """Sparse noisy rows: the default stop and a far stricter one give the same heavy words, and extrapolation saves rounds."""
    rng = np.random.default_rng(11)
    h = rng.random((5, 120)) * (rng.random((5, 120)) < 0.25)
    x = (rng.random((200, 5)) ** 3) @ h + 0.3 * rng.random((200, 120)) * (rng.random((200, 120)) < 0.1)
    rows = stage(packed(spark, x), "packed")
    model = topics.fit_topics(rows, 120, 5, 42, 300, start=start)
    strict = topics.fit_topics(rows, 120, 5, 42, 2000, tol=1e-6, start=start)
    assert len(model.losses) < 300 and model.losses[-1] <= strict.losses[-1] * (1 + 1e-4)
    heavy = [[set(np.argsort(-row)[:8]) for row in m.components] for m in (model, strict)]
    assert np.mean([len(a & b) / 8 for a, b in zip(*heavy)]) >= 0.95
    plain = plain_rounds(x, topics.fit_topics(rows, 120, 5, 42, 0, start=start).components, model.losses[-1])
    assert len(model.losses) < plain


def plain_rounds(x, h, loss, most=2000):
    """Rounds of alternating least squares without extrapolation until the loss is as low."""
    for n in range(1, most):
        w = topics.nonnegative_least_squares(x @ h.T, h @ h.T)
        if ((x - w @ h) ** 2).sum() <= loss * (1 + 1e-9):
            return n
        h = topics.nonnegative_least_squares(x.T @ w, w.T @ w).T
    return most


def test_slices_cover_a_batch(spark, mixture, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topics, "SLICE", 25)
    table = packed(spark, mixture, 1).orderBy("doc_id").select("indices", "values").toArrow().combine_chunks()
    batch = table.to_batches()[0]
    assert isinstance(batch, pa.RecordBatch)
    rebuilt = np.zeros(mixture.shape)
    for lo, n, r, c, v in topics._cells(batch.column(0), batch.column(1)):
        rebuilt[lo + r, c] = v
        assert n >= 1
    np.testing.assert_allclose(rebuilt, mixture)


def test_top_words_with_ties(spark):
    model = topics.TopicModel(np.array([[0.5, 0.5, 0.9, 0.1, 0.5], [0.0, 0.0, 0.2, 0.0, 0.0]]))
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate("e d c b a".split())], "term_id int, term string")
    for table in (model.topic_terms(spark), model.topic_terms(spark, 3)):
        rows = topics.topic_top_words(table, vocab, 3).orderBy("topic", "rank").collect()
        assert [(r.topic, r.word) for r in rows] == [(0, "c"), (0, "a"), (0, "d"), (1, "c")]


def test_coherence_against_counts(spark):
    texts = ["apple pear", "apple pear plum", "apple", "plum kiwi", "kiwi"]
    tokens = [t.split() for t in texts]
    docs = spark.createDataFrame([(t,) for t in tokens], "tokens array<string>")
    words = spark.createDataFrame(
        [(0, 1, "apple"), (0, 2, "pear"), (0, 3, "plum"), (1, 1, "kiwi"), (1, 2, "plum"), (1, 3, "apple")],
        "topic int, rank int, word string",
    )
    got = {r.topic: r.coherence for r in topics.topic_coherence(docs, words).collect()}
    for topic, ranked in {0: ["apple", "pear", "plum"], 1: ["kiwi", "plum", "apple"]}.items():
        want = 0.0
        for i in range(3):
            for j in range(i + 1, 3):
                alone = sum(ranked[i] in t for t in tokens)
                both = sum(ranked[i] in t and ranked[j] in t for t in tokens)
                want += np.log((both + 1) / alone)
        assert got[topic] == pytest.approx(want)


def test_vocabulary_ties_and_bounds(spark, docs):
    df = docs("b a a x", "b a y", "b c c z", "b c").select("doc_id", tokenize_alpha(F.col("content")).alias("tokens"))
    rows = features.vocabulary(df, 2, 0.75, 1).collect()
    assert [(r.term_id, r.term, r.df, r.tf) for r in rows] == [(0, "a", 2, 3)]
    with pytest.raises(ValueError):
        features.Vocabulary.fit(df, 5, 1.0)


def test_tfidf_keeps_documents_without_terms(spark, docs):
    df = docs("a b", "b b c", "zzz", "").select("doc_id", tokenize_alpha(F.col("content")).alias("tokens"))
    vocab = features.Vocabulary.fit(df, 2)
    assert vocab.terms == ("b",)
    rows = {r.doc_id: r for r in features.tfidf_vectors(df, vocab).collect()}
    assert rows[1].counts == [2.0] and rows[1]["values"] == [1.0]
    assert rows[2].indices == [] and rows[3].indices == []


def test_embeddings(spark, docs):
    df = docs("one two three", "one two three", "other words", "")
    got = [r.embedding for r in features.embed_documents(df).orderBy("doc_id").collect()]
    assert len(got[0]) == 64 and got[0] == got[1] != got[2] and not any(got[3])

    def make():
        return lambda texts: np.array([[len(t)] for t in texts], dtype=np.float32)

    assert [r.embedding for r in features.embed_texts(df, make).orderBy("doc_id").collect()] == [[13], [13], [11], [0]]


@pytest.mark.parametrize("max_tokens, truncate", [(512, False), (4, False), (4, True)])
def test_embeddings_are_masked_means_for_any_batch(spark, docs, max_tokens, truncate):
    texts = ["", "one", *[" ".join(f"w{(i * j) % 17}x" for j in range(i)) for i in range(2, 40)]]
    df = docs(*texts).union(spark.createDataFrame([(99, None)], "doc_id bigint, content string"))
    want = None
    for batch_size in (1, 7, 64):
        options = {"batch_size": batch_size, "max_tokens": max_tokens, "truncate": truncate}
        rows = {r.doc_id: r.embedding for r in features.embed_documents(df, **options).collect()}
        tokens = features.token_vectors(df, **options)
        pooled = {r.doc_id: r.embedding for r in features.masked_mean_pool(tokens).collect()}
        assert set(rows) - set(pooled) == {0, 99} and not any(rows[0]) and not any(rows[99])
        for k, mean in pooled.items():
            np.testing.assert_allclose(rows[k], mean, atol=1e-6)
        want = want or rows
        assert all(np.allclose(rows[k], want[k], atol=1e-6) for k in rows)
        if batch_size == 64 and max_tokens == 4:
            assert tokens.where("mask = 0").count() > 0
    if truncate:
        assert rows[20] == pytest.approx(rows_of_first(spark, texts[20], 4), abs=1e-6)


def rows_of_first(spark, text, n):
    df = spark.createDataFrame([(0, " ".join(text.split()[:n]))], "doc_id bigint, content string")
    return features.embed_documents(df).first().embedding


def test_token_model_vectors_look_normal():
    vectors = features.hashed_token_model(64)()(np.arange(2000)[None, :], np.ones((1, 2000), bool))[0]
    assert abs(vectors.mean()) < 0.02 and abs(vectors.std() - 1) < 0.02
    assert np.abs(np.corrcoef(vectors[:50])[np.triu_indices(50, 1)]).max() < 0.6


# --- clusters ---------------------------------------------------------------------------------------


def as_points(spark, x, parts=4):
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id bigint, w array<double>").repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(9)
    return np.vstack([rng.normal(c, 0.3, (n, 3)) for c, n in ((0, 40), (3, 25), (6, 15), (-4, 1))])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, i, j)
        groups[best[1]] += groups.pop(best[2])
    label = np.zeros(len(x), int)
    for c, g in enumerate(groups):
        label[g] = c
    return label


@pytest.mark.parametrize("k", [2, 4, 7])
def test_hierarchy_equals_ward_on_points(spark, blobs, k):
    got = [r.cluster for r in clusters.hierarchical_labels(as_points(spark, blobs), k).orderBy("doc_id").collect()]
    assert same_partition(got, naive_ward(blobs, k))


def test_hierarchy_over_micro_clusters(spark, blobs):
    got = clusters.hierarchical_labels(as_points(spark, blobs), 4, micro=30).orderBy("doc_id").collect()
    assert same_partition([r.cluster for r in got], naive_ward(blobs, 4))


def greedy_merges(centers, weights):
    """Ward by the smallest growth of all pairs, each time anew."""
    c, n, left, out = centers.copy(), weights.astype(float).copy(), list(range(len(centers))), []
    while len(left) > 1:
        cost = {(a, b): n[a] * n[b] / (n[a] + n[b]) * ((c[a] - c[b]) ** 2).sum() for a in left for b in left if a < b}
        a, b = min(cost, key=lambda p: (cost[p], p))
        c[a], n[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b]), n[a] + n[b]
        left.remove(b)
        out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_chains_give_the_greedy_merges(seed):
    rng = np.random.default_rng(seed)
    centers, weights = rng.standard_normal((2 + 9 * seed, 3)), rng.integers(1, 20, 2 + 9 * seed)
    assert clusters.ward_merges(centers, weights) == greedy_merges(centers, weights)


def test_merges_of_many_centers_take_seconds():
    rng = np.random.default_rng(1)
    began = time.perf_counter()
    merges = clusters.ward_merges(rng.standard_normal((4096, 20)), rng.integers(1, 50, 4096))
    assert len(merges) == 4095 and time.perf_counter() - began < 30


def test_feature_tree_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.standard_normal((300, 4)) + 6 * (i % 3) for i in range(3)] + [np.ones((40, 4))])
    trees = [clusters.feature_tree(as_points(spark, x, p), 50) for p in (1, 7)]
    np.testing.assert_allclose(trees[0].centers, trees[1].centers, atol=1e-9)
    assert (trees[0].weights == trees[1].weights).all() and trees[0].weights.sum() == len(x) and len(trees[0].weights) == 50
    near = trees[0].place(x)
    for leaf in range(50):
        np.testing.assert_allclose(x[near == leaf].mean(axis=0), trees[0].centers[leaf], atol=1e-9)
    error = sum(((x[near == leaf] - trees[0].centers[leaf]) ** 2).sum() for leaf in range(50))
    assert error < 0.15 * ((x - x.mean(axis=0)) ** 2).sum()


def test_feature_tree_of_few_distinct_points(spark):
    """A leaf for each, exactly, also where values differ by the last bit."""
    x = np.array([[1.0, 5.0], [np.nextafter(1.0, 2), 5.0], [1.0, 5.0], [1e9, -3.0], [1.0, 5.5]] * 3)
    tree = clusters.feature_tree(as_points(spark, x), 512)
    assert sorted(map(tuple, tree.centers)) == sorted(set(map(tuple, x)))
    assert sorted(tree.weights.tolist()) == [3, 3, 3, 6]
    with pytest.raises(ValueError):
        clusters.feature_tree(as_points(spark, x).limit(0))


def test_chosen_k_equals_brute_force(spark, blobs):
    points = as_points(spark, blobs)
    scores = {k: silhouette(blobs, naive_ward(blobs, k), 2) for k in range(2, 13)}
    best = clusters.select_k(clusters.score_cuts(points, clusters.fit_hierarchy(points), 12)).first()
    assert best.k == max(scores, key=lambda k: (round(scores[k], 9), -k)) and best.score == pytest.approx(scores[best.k])


def silhouette(x, labels, power):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(scores)


def test_every_cut_is_scored(spark, blobs):
    points = as_points(spark, blobs)
    tree = clusters.fit_hierarchy(points)
    scores = {r.k: r.score for r in clusters.score_cuts(points, tree, 12).collect()}
    assert sorted(scores) == list(range(2, 13))
    for k in (2, 4, 9):
        labels = np.array([r.cluster for r in tree.labels(points, k).orderBy("doc_id").collect()])
        assert scores[k] == pytest.approx(silhouette(blobs, labels, 2), abs=1e-9)
    best = clusters.select_k(clusters.score_cuts(points, tree, 12)).first()
    assert best.k == max(scores, key=lambda k: (scores[k], -k))


def test_first_k_wins_ties(spark):
    scores = spark.createDataFrame([(5, 0.5), (3, 0.5), (4, 0.1)], "k int, score double")
    assert clusters.select_k(scores).first().k == 3


def test_lloyd_keeps_empty_clusters(spark, blobs):
    start = np.vstack([blobs[:3], [[100.0, 100.0, 100.0]]])
    used, moved = clusters.kmeans_lloyd(as_points(spark, blobs), start)
    centers, before = start.copy(), None
    for _ in range(100):
        near = ((blobs[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        last, new = centers, np.array([blobs[near == c].mean(0) if (near == c).any() else centers[c] for c in range(4)])
        if before is not None and np.linalg.norm(new - before) < 1e-4:
            break
        centers = before = new
    np.testing.assert_allclose(used, last, atol=1e-9)
    np.testing.assert_allclose(moved[3], [100.0] * 3)


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_bounded_rounds_give_the_labels_of_plain_ones(spark, spread):
    """Full runs, with points that tie between centers, equal centers and a center without points."""
    rng = np.random.default_rng(12)
    middles = rng.random((9, 3)) * 10
    x = np.vstack([middles.repeat(40, axis=0) + spread * rng.standard_normal((360, 3)), np.zeros((5, 3)), middles.repeat(3, axis=0)])
    points, start = stage(as_points(spark, x), "points"), np.vstack([x[:360:40] + 0.1, x[:1] + 0.1, [[200.0, 0, 0]]])
    centers, previous = start, None
    for _ in range(100):
        used, near = centers, np.array([((x - c) ** 2).sum(1) for c in centers]).argmin(axis=0)
        moved = np.array([x[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centers)])
        if previous is not None and np.linalg.norm(moved - previous) < 1e-4:
            break
        centers = previous = moved
    for bounded_from in (0, 3, 1000):
        trace = []
        got, _ = clusters.kmeans_lloyd(points, start, bounded_from=bounded_from, trace=trace)
        np.testing.assert_allclose(got, used, atol=1e-8)
        assert all(n == len(x) for n, _ in trace)
        skipped = sum(k for _, k in trace) / sum(n for n, _ in trace)
        assert skipped > 0.3 if bounded_from < 10 and spread < 1 and len(trace) > 4 else skipped >= 0


def test_kmeans_repeats_for_any_partitioning(spark, blobs):
    runs = [
        [r.cluster for r in clusters.kmeans_labels(as_points(spark, blobs, p), 4, seed=3).orderBy("doc_id").collect()]
        for p in (1, 5)
    ]
    assert runs[0] == runs[1]
    assert [r.doc_id for r in clusters.sample_rows(as_points(spark, blobs, 2), 5).collect()] == [
        r.doc_id for r in clusters.sample_rows(as_points(spark, blobs, 7), 5).collect()
    ]


def test_nearest_center_breaks_ties_low(spark):
    near = clusters.assign_nearest(as_points(spark, np.array([[0.0], [1.0]])), np.array([[1.0], [-1.0], [1.0]]))
    assert [(r.cluster, r.distance) for r in near.orderBy("doc_id").collect()] == [(0, 1.0), (0, 0.0)]


def test_exact_silhouette_in_blocks(spark, blobs):
    labels = naive_ward(blobs, 4)
    rows = [(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(blobs, labels))]
    df = spark.createDataFrame(rows, "doc_id bigint, w array<double>, cluster int")
    for block in (2000, 17):
        assert quality.silhouette_exact(df, block=block).first().silhouette == pytest.approx(silhouette(blobs, labels, 1), abs=1e-7)
    assert quality.silhouette_exact(df.where("cluster = 0")).first().silhouette is None


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_exact_silhouette_skips_clusters_by_their_means(spark, spread):
    """Singletons, equal points, repeated ids; clear clusters need few of the distances to others, mixed ones stay exact."""
    rng = np.random.default_rng(8)
    middles = rng.random((12, 3)) * 20
    labels = np.concatenate([np.arange(12).repeat(9), [12], [13] * 5])
    x = np.vstack([middles.repeat(9, axis=0) + spread * rng.standard_normal((108, 3)), [[50, 50, 50]], np.full((5, 3), 7.0)])
    df = spark.createDataFrame([(i // 2, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, labels))], "doc_id long, w array<double>, cluster int")
    assert quality.silhouette_exact(df, block=4).first().silhouette == pytest.approx(silhouette(x, labels, 1), abs=1e-7)
    asked = [len(r.wanted) for r in quality.silhouette_candidates(df).collect()]
    assert min(asked) >= 2 and (spread > 1 or np.mean(asked) < 4)


def test_quality_of_singletons_and_empty_clusters(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [9.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, w array<double>, cluster int")
    record = quality.quality_record(df, 5).first()
    assert record.cluster_sizes == [2, 0, 1, 0, 0]
    assert record.cluster_density == pytest.approx(0.5)
    assert record.davies_bouldin_score == pytest.approx(1.0 / np.hypot(9, 8))
    assert quality.largest_cluster(df).first().cluster == 0


def test_top_rows_agrees_with_a_plain_sort(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(9)
    got = [tuple(r) for r in ranking.top_rows(df, [F.desc("v"), "id"], 40, groups=3).collect()]
    assert got == [tuple(r) for r in df.orderBy(F.desc("v"), "id").limit(40).collect()]
    with pytest.raises(ValueError):
        ranking.bounded(df, 10, "rows")


@pytest.mark.parametrize("n", [32, 33])
def test_one_hierarchy_path_for_every_size(spark, n):
    """As many points as micro-centers, and one more, take the same path and agree where the groups are clear."""
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(3) * 0.01 + 10 * (i % 4)).tolist()) for i in range(n)]
    points = spark.createDataFrame(rows, "doc_id long, w array<double>")
    tree = clusters.fit_hierarchy(points, micro=32)
    assert tree.weights.sum() == n and tree.size <= 32
    groups = {}
    for r in tree.labels(points, 4).collect():
        groups.setdefault(r.cluster, set()).add(r.doc_id % 4)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2], [3]]


def test_more_clusters_than_micro_centers(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(60)], "doc_id long, w array<double>")
    with pytest.raises(ValueError, match="20 clusters from 8"):
        clusters.fit_hierarchy(points, micro=8).cut(20)
    assert clusters.hierarchical_labels(points, 20).select("cluster").distinct().count() == 20


def test_narrowing_keeps_all_that_can_be_on_top(spark):
    df = spark.range(30000).select("id", (F.col("id") % 997 + 1).alias("v"))
    narrow = ranking.at_least_top(df, "v", 5000)
    assert narrow.count() < 7000
    want = [tuple(r) for r in df.orderBy(F.desc("v"), "id").limit(5000).collect()]
    assert [tuple(r) for r in ranking.top_rows(narrow, [F.desc("v"), "id"], 5000).collect()] == want
    assert ranking.at_least_top(df.limit(0), "v", 10).count() == 0


def test_bisecting_labels_of_clear_groups(spark):
    rng = np.random.default_rng(2)
    middles = np.array([[0, 0], [40, 0], [0, 40], [40, 40]])
    x = middles.repeat(20, axis=0) + rng.standard_normal((80, 2))
    got = [r.cluster for r in clusters.bisecting_labels(as_points(spark, x), 4).orderBy("doc_id").collect()]
    assert same_partition(got, np.arange(4).repeat(20))


def test_embeddings_factorise_like_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((80, 3))) @ np.abs(rng.standard_normal((3, 12)))
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, embedding array<double>")
    rows = stage(topics.dense_rows(docs).select("doc_id", "indices", "values"), "dense")
    model = topics.fit_topics(rows, 12, 3, 42, 300)
    w = np.array([r.w for r in model.transform(rows).orderBy("doc_id").collect()])
    h = model.components
    np.testing.assert_allclose(w, topics.coordinate_sweeps(x @ h.T, h @ h.T, 20_000), atol=1e-5)
    assert ((x - w @ h) ** 2).sum() < 1e-3 * (x**2).sum()


def test_packed_slices_hold_all_cells_and_rows(spark, monkeypatch):
    monkeypatch.setattr(topics, "NEAR", 3)
    monkeypatch.setattr(topics, "RUN", 2)
    rows = [([0, 3], [1.0, 2.0]), ([], []), ([1, 2, 3], [0.5, 0.25, 4.0]), ([3], [1.0]), ([], [])]
    x = spark.createDataFrame(rows, "indices array<int>, values array<double>").coalesce(1)
    dense = np.zeros((len(rows), 4))
    for r, (cols, vals) in enumerate(rows):
        dense[r, cols] = vals
    right = np.arange(8.0).reshape(4, 2)
    for given in (x, topics._packed(x, 3)):
        wx, ww = topics._sum_over_rows(given, 4, 2, lambda n, r, c, v: topics._project(n, r, c, v, right))
        assert np.allclose(wx, (dense @ right).T @ dense) and np.allclose(ww, (dense @ right).T @ (dense @ right))
    assert sum(r.n for r in topics._packed(x, 3).collect()) == len(rows)
    batch = topics._packed(x, 1).toArrow().combine_chunks().to_batches()[0]
    n, r, c, v = next(topics._slices(iter([batch])))
    sums = np.zeros((2, 4))
    topics._add_cells(sums, dense @ right, r, c, v)
    assert n == len(rows) and np.allclose(sums, (dense @ right).T @ dense)


def test_positive_weights_solve_their_own_equations():
    rng = np.random.default_rng(0)
    base = rng.random((5, 9))
    gram, target, positive = base @ base.T, rng.random((40, 5)), rng.random((40, 5)) < 0.5
    positive[0] = False
    for w, t, own in zip(topics._solved(target, gram, positive), target, positive):
        assert not w[~own].any() and np.allclose(gram[np.ix_(own, own)] @ w[own], t[own])
