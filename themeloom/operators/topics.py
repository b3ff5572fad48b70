"""Non-negative topics: fit, transform, top words, coherence and stability.

The fit alternates non-negative least-squares steps. Document weights are a function
of the topic-term matrix alone, so no per-document state survives a round: a round is one narrow pass
over the vectors that sends back sums of the size of the topic-term matrix. Nothing has to be
checkpointed between rounds, and a lost executor only repeats its own part of the current pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.operators.features import MAX_VOCABULARY, Vocabulary
from themeloom.operators.ranking import RANK_DIGITS, by_score, top_n_per_group
from themeloom.session import drop_staged, released_shuffles, stage

BLOCK = 256  # terms per row of partial sums
SLICE = 400_000  # non-zero cells handled at once inside a task
NEAR = 2_000  # cells multiplied at once, so that their products stay in the processor's cache
RUN = 100_000  # cells added to the sums of terms at once
PART_BYTES = 64 << 20  # of packed cells that a task of a pass reads
MAX_TOPICS = 512
MAX_CELLS = 20_000_000  # the topic-term matrix: on the driver and once in every running task
TINY = 1e-12
PIVOT_CELLS = 2_000_000  # numbers of the linear systems that are solved at once
STEPS = 20  # coordinate sweeps of a topic step


# --- numpy on one batch of rows ---------------------------------------------------------------------


def _cells(indices: pa.Array, values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices ``(first row, n rows, row of cell, column of cell, value)`` of a batch of packed rows."""
    offsets = indices.offsets.to_numpy().astype(np.int64)
    cols = indices.flatten().to_numpy(zero_copy_only=False)
    vals = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = offsets - offsets[0]
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        a, b = offsets[lo], offsets[hi]
        rows = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        yield lo, hi - lo, rows, cols[a:b], vals[a:b]
        lo = hi


def _project(n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows times a ``terms x k`` matrix."""
    out = np.zeros((n, right.shape[1]))
    if not len(rows):
        return out
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    ends = np.r_[starts[1:], len(rows)]
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + NEAR, side="right")))
        lo, hi = starts[first], ends[last - 1]
        part = right.take(cols[lo:hi], axis=0)
        part *= vals[lo:hi, None]
        out[rows[starts[first:last]]] = np.add.reduceat(part, starts[first:last] - lo, axis=0)
        first = last
    return out


def _add_cells(sums: np.ndarray, w: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> None:
    """Adds ``w'`` times sparse rows to the ``k x terms`` matrix ``sums``."""
    by_topic = np.ascontiguousarray(w.T)
    for a in range(0, len(cols), RUN):
        r, c, v = rows[a : a + RUN], cols[a : a + RUN].astype(np.intp), vals[a : a + RUN]
        for total, weights in zip(sums, by_topic):
            total += np.bincount(c, weights=weights.take(r) * v, minlength=len(total))


def coordinate_sweeps(target: np.ndarray, gram: np.ndarray, sweeps: int, start=None) -> np.ndarray:
    """Rows ``w >= 0`` that lower ``w gram w' - 2 w target'``, one coordinate after the other.

    A coordinate whose diagonal is zero stays at zero.
    """
    columns = np.ascontiguousarray(target.T)
    w = np.zeros_like(columns) if start is None else np.array(start.T, order="C")
    live = np.flatnonzero(np.diag(gram) > TINY)
    for _ in range(sweeps):
        moved = 0.0
        for t in live:
            new = np.maximum(0.0, w[t] + (columns[t] - gram[t] @ w) / gram[t, t])
            moved = max(moved, float(np.abs(new - w[t]).max(initial=0.0)))
            w[t] = new
        if moved <= 1e-8 * max(float(w.max(initial=0.0)), TINY):
            break
    return np.ascontiguousarray(w.T)


def nonnegative_least_squares(target: np.ndarray, gram: np.ndarray, start=None) -> np.ndarray:
    """Rows ``w >= 0`` that minimise ``w gram w' - 2 w target'``, by block principal pivoting.

    Some coordinate sweeps guess which weights are positive; the guess is solved as a linear system, and weights that come out negative or
    zeros that ought to grow change sides until none does. Rows are independent of each other.
    """
    k = len(gram)
    gram = gram + 1e-12 * max(float(np.trace(gram)) / k, TINY) * np.eye(k)
    guess = coordinate_sweeps(target, gram, 6, start)
    chunk = max(1, PIVOT_CELLS // (k * k))
    parts = [_pivoted(target[a : a + chunk], gram, guess[a : a + chunk] > 0) for a in range(0, len(target), chunk)]
    return np.concatenate(parts) if parts else guess


def _solved(target: np.ndarray, gram: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rows with the weights of the positive places from their own equations, zero elsewhere; rows with as many places go together."""
    w = np.zeros(target.shape)
    sizes = positive.sum(axis=1)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)[:, None]
        places = np.nonzero(positive[rows[:, 0]])[1].reshape(-1, size)
        system = gram[places[:, :, None], places[:, None, :]]
        w[rows, places] = np.linalg.solve(system, target[rows, places][:, :, None])[:, :, 0]
    return w


def _pivoted(target: np.ndarray, gram: np.ndarray, positive: np.ndarray) -> np.ndarray:
    n, k = target.shape
    out, todo = np.zeros((n, k)), np.arange(n)
    allowed = np.diag(gram) > TINY
    positive = positive & allowed
    least, patience = np.full(n, k + 1), np.full(n, 3)
    slack = 1e-12 * np.abs(target).max(axis=1, initial=0.0)[:, None] + TINY**2
    for _ in range(5 * k + 20):
        w = _solved(target[todo], gram, positive[todo])
        slope = w @ gram - target[todo]
        wrong = np.where(positive[todo], w < 0, (slope < -slack[todo]) & allowed)
        count = wrong.sum(axis=1)
        out[todo] = np.maximum(w, 0.0)
        left = np.flatnonzero(count)
        todo, wrong, count = todo[left], wrong[left], count[left]
        if not len(todo):
            return out
        # All wrong ones change sides while that makes them fewer; otherwise the last one only, which can't cycle.
        fewer = count < least[todo]
        least[todo[fewer]], patience[todo[fewer]] = count[fewer], 3
        single = ~fewer & (patience[todo] == 0)
        patience[todo[~fewer & ~single]] -= 1
        last = k - 1 - np.argmax(wrong[:, ::-1], axis=1)
        wrong[single] = False
        wrong[single, last[single]] = True
        positive[todo] ^= wrong
    out[todo] = coordinate_sweeps(target[todo], gram, 5000, out[todo])
    return out


# --- passes over the distributed vectors ------------------------------------------------------------


def _packed(x: DataFrame, parts: int) -> DataFrame:
    """``<n, lengths, cols, vals>``: slices of rows ``<indices, values>`` as bytes, dealt to ``parts`` partitions.

    Arrays pass between Spark and Python number by number, bytes as a whole, and a fit makes some dozen passes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, rows, cols, vals in _cells(batch.column(0), batch.column(1)):
                own = (np.bincount(rows, minlength=n).astype("<i4"), cols.astype("<i4"), vals.astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())] + [pa.array([v.tobytes()]) for v in own], ["n", "lengths", "cols", "vals"])

    slices = x.select("indices", "values").mapInArrow(pack, "n int, lengths binary, cols binary, vals binary")
    return slices.repartition(parts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(n rows, row of cell, column of cell, value)`` of packed slices."""
    for batch in batches:
        for n, *own in zip(*batch.columns):
            lengths, cols, vals = (np.frombuffer(v.as_buffer(), t) for v, t in zip(own, ("<i4", "<i4", "<f8")))
            yield n.as_py(), np.repeat(np.arange(n.as_py()), lengths), cols, vals


def _sum_over_rows(x: DataFrame, n_terms: int, k: int, weights: Callable) -> tuple[np.ndarray, np.ndarray]:
    """``(sum of w'x as k x terms, sum of w'w as k x k)`` for the row weights that ``weights`` computes from slices.

    ``x`` is packed (:func:`_packed`) or is packed on the way.

    A task adds up its own rows and emits one row per touched block of terms; the tasks behind one shuffle add up the rows of their
    blocks as they come. The driver receives one row per block: k x terms numbers in all.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wx, ww, touched = np.zeros((k, n_terms)), np.zeros((k, k)), False
        for n, rows, cols, vals in _slices(batches):
            w = weights(n, rows, cols, vals)
            ww += w.T @ w
            touched = True
            _add_cells(wx, w, rows, cols, vals)
        if not touched:
            return
        blocks, sums = [-1], [ww.tobytes()]
        for b in range(0, n_terms, BLOCK):
            part = wx[:, b : b + BLOCK]
            if part.any():
                blocks.append(b // BLOCK)
                sums.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(sums.as_buffer(), np.float64)
                if block in found:
                    found[block] += part
                else:
                    found[block] = part.copy()
        if found:
            sums = pa.array([v.tobytes() for v in found.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), sums], ["block", "sums"])

    if "vals" not in x.columns:
        x = _packed(x, x.sparkSession.sparkContext.defaultParallelism)
    shape = "block int, sums binary"
    with released_shuffles(x.sparkSession):
        found = x.mapInArrow(partial, shape).repartition("block").mapInArrow(total, shape).toArrow()
    wx, ww = np.zeros((k, n_terms)), np.zeros((k, k))
    for block, sums in zip(found.column("block").to_pylist(), found.column("sums").to_pylist()):
        part = ww if block < 0 else wx[:, block * BLOCK : (block + 1) * BLOCK]
        part[:] = np.frombuffer(sums, np.float64).reshape(part.shape)
    return wx, ww


def _on_executors(spark: SparkSession, value: np.ndarray):
    return spark.sparkContext.broadcast(value)


def _spectral_start(x: DataFrame, n_terms: int, k: int, seed: int, mean: float) -> np.ndarray:
    """Topic-term start from a truncated singular value decomposition, by subspace iteration.

    Each component keeps the heavier of its positive and negative parts; zeros become the mean of the
    matrix, so that no term is locked out.
    """
    spark = x.sparkSession
    basis = np.random.default_rng(seed).standard_normal((n_terms, min(k + 8, n_terms)))
    basis = np.linalg.qr(basis)[0]
    gram = None
    for _ in range(4):
        shared = _on_executors(spark, basis)
        gram_times, gram = _sum_over_rows(
            x, n_terms, basis.shape[1], lambda n, r, c, v: _project(n, r, c, v, shared.value)
        )
        shared.destroy()
        last, basis = basis, np.linalg.qr(gram_times.T)[0]
    # The last pass has X'X applied to `last`; its Rayleigh quotient gives the singular pairs.
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    sigma = np.sqrt(np.maximum(values[order], 0.0))
    right = (last @ vectors[:, order]).T
    parts = _sign_norms(x, right)
    start = np.zeros((k, n_terms))
    for t in range(len(order)):
        plus, minus = np.maximum(right[t], 0.0), np.maximum(-right[t], 0.0)
        if t == 0:
            start[t] = np.sqrt(sigma[t]) * np.abs(right[t])
            continue
        norm_plus = parts[0, t] * np.linalg.norm(plus)
        norm_minus = parts[1, t] * np.linalg.norm(minus)
        part, norm = (plus, norm_plus) if norm_plus >= norm_minus else (minus, norm_minus)
        scale = sigma[t] if sigma[t] > TINY else 1.0
        start[t] = np.sqrt(norm / scale * sigma[t]) * part / max(np.linalg.norm(part), TINY)
    return np.where(start < TINY, mean, start)


def _sign_norms(x: DataFrame, right: np.ndarray) -> np.ndarray:
    """Norms of the positive and of the negative part of every column of ``X right'``; shape 2 x k."""
    k = len(right)
    shared = _on_executors(x.sparkSession, right.T)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k)
        for n, r, c, v in _slices(batches):
            u = _project(n, r, c, v, shared.value)
            total += np.concatenate([(np.maximum(u, 0) ** 2).sum(0), (np.minimum(u, 0) ** 2).sum(0)])
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, 2 * k], pa.int32()), pa.array(total))], ["sums"]
        )

    row = (
        x.mapInArrow(squares, "sums array<double>")
        .agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
        .first()
    )
    shared.destroy()
    return np.sqrt(row.sums.toArray().reshape(2, k))


@dataclass(frozen=True)
class TopicModel:
    """Topic-term weights (topics x terms, both capped) and the loss after each round."""

    components: np.ndarray
    losses: tuple[float, ...] = field(default=())

    @property
    def n_topics(self) -> int:
        return self.components.shape[0]

    def topic_terms(self, spark: SparkSession, n_words: int | None = None) -> DataFrame:
        """``<topic, term_id, weight>``, non-zero cells only.

        With ``n_words``, only the cells that can be among the ``n_words`` heaviest of their topic, ties
        included.
        """
        keep = self.components > 0
        if n_words is not None and n_words < self.components.shape[1]:
            ranked = np.round(self.components, RANK_DIGITS)
            least = -np.partition(-ranked, n_words - 1, axis=1)[:, n_words - 1 : n_words]
            keep &= ranked >= least
        topic, term = np.nonzero(keep)
        table = pa.table(
            {
                "topic": pa.array(topic, pa.int32()),
                "term_id": pa.array(term, pa.int32()),
                "weight": pa.array(self.components[topic, term]),
            }
        )
        return spark.createDataFrame(table)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Add ``w array<double>``, the topic weights of each row; narrow, any columns pass through."""
        shared = _on_executors(vectors.sparkSession, self.components)

        @F.arrow_udf("array<double>")
        def weights(indices: pa.Array, values: pa.Array) -> pa.Array:
            h = shared.value
            k, gram, right = len(h), h @ h.T, np.ascontiguousarray(h.T)
            parts = [
                nonnegative_least_squares(_project(n, r, c, v, right), gram)
                for _, n, r, c, v in _cells(indices, values)
            ]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            return pa.ListArray.from_arrays(
                pa.array(np.arange(len(indices) + 1) * k, pa.int32()), pa.array(flat)
            )

        return vectors.withColumn("w", weights("indices", "values"))


def fit_topics(
    vectors: DataFrame,
    n_terms: int,
    n_topics: int = 20,
    seed: int = 42,
    max_iter: int = 200,
    tol: float = 1e-4,
    start: str = "spectral",
) -> TopicModel:
    """Factorise the packed rows ``<indices, values>`` as weights times topics under Frobenius loss.

    ``vectors`` is read twice: pass a staged table (``session.stage``). What is read once per round is a packed copy of it. Stops after ``max_iter``
    rounds, or earlier when the projected gradient of the topics has fallen to ``tol`` of its first value. A round solves all
    row weights exactly and then improves the topics; the step is carried on beyond its end by a share that grows
    while the loss falls and shrinks when it rises, which takes a third of the rounds of plain steps.
    """
    if not 0 < n_topics <= MAX_TOPICS or n_terms > MAX_VOCABULARY or n_topics * n_terms > MAX_CELLS:
        raise ValueError(f"at most {MAX_TOPICS} topics, {MAX_VOCABULARY} terms and {MAX_CELLS} topic-term weights")
    spark = vectors.sparkSession
    x = vectors.select("indices", "values")
    total, square, n_rows, n_cells = x.select(
        F.expr("aggregate(values, 0D, (a, v) -> a + v)").alias("s"),
        F.expr("aggregate(values, 0D, (a, v) -> a + v * v)").alias("q"),
        F.size("values").cast("bigint").alias("n"),
    ).agg(F.sum("s"), F.sum("q"), F.count("*"), F.sum("n")).first()
    if not total:
        raise ValueError("no document holds a vocabulary term")
    mean = total / (n_rows * n_terms)
    packed = x = stage(_packed(x, max(spark.sparkContext.defaultParallelism, 1 + 12 * n_cells // PART_BYTES)), "packed")
    if start == "spectral":
        h = _spectral_start(x, n_terms, n_topics, seed, mean)
    elif start == "random":
        h = np.sqrt(mean / n_topics) * np.abs(np.random.default_rng(seed).standard_normal((n_topics, n_terms)))
    else:
        raise ValueError("start is 'spectral' or 'random'")

    losses, first = [], None
    before, reach, most = None, 0.5, 1.0
    for _ in range(max_iter):
        gram = h @ h.T
        shared = _on_executors(spark, np.ascontiguousarray(h.T))
        wx, ww = _sum_over_rows(
            x,
            n_terms,
            n_topics,
            lambda n, r, c, v: nonnegative_least_squares(_project(n, r, c, v, shared.value), gram),
        )
        shared.destroy()
        losses.append(float(square - 2 * np.sum(wx * h) + np.sum(ww * gram)))
        slope = ww @ h - wx
        violation = float(np.abs(np.where(h > 0, slope, np.minimum(slope, 0.0))).sum())
        first = violation if first is None else first
        if violation <= tol * max(first, TINY):
            break
        solved = coordinate_sweeps(wx.T, ww, STEPS, h.T).T
        if len(losses) > 1 and losses[-1] > losses[-2]:
            # Went too far: on from the plain step, with less reach.
            most, reach, h = reach, reach / 1.5, solved
        else:
            h = solved if before is None else np.maximum(solved + reach * (solved - before), 0.0)
            most = min(1.0, 1.01 * most)
            reach = min(most, 1.05 * reach)
        before = solved
    drop_staged(packed)
    return TopicModel(h, tuple(losses))


def dense_rows(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """Pack dense non-negative vectors as ``<indices, values>`` rows for :func:`fit_topics`."""
    values = F.transform(vector, lambda v: v.cast("double"))
    return docs.withColumns(
        {"indices": F.transform(vector, lambda _, i: i), "values": values}
    )


# --- topic tables -----------------------------------------------------------------------------------


def topic_top_words(topic_terms: DataFrame, vocab: DataFrame, n_words: int = 10) -> DataFrame:
    """``<topic, rank, term_id, word, weight>``: the heaviest terms of each topic, ties by term."""
    named = topic_terms.join(vocab.select("term_id", "term"), "term_id")
    ranked = top_n_per_group(named, ["topic"], [by_score("weight"), "term"], n_words)
    return ranked.select("topic", "rank", "term_id", F.col("term").alias("word"), "weight")


def document_theme(doc_topics: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``topic`` (the heaviest, ties to the lowest) and ``theme`` (its words joined by a space).

    ``words`` is the bounded table of topic words; it reaches the rows as one array, not as a join.
    """
    names = (
        words.groupBy("topic")
        .agg(F.expr("listagg(word, ' ') within group (order by rank)").alias("theme"))
        .agg(F.map_from_entries(F.collect_list(F.struct("topic", "theme"))))
        .scalar()
    )
    topic = (F.array_position("w", F.array_max("w")) - 1).cast("int")
    return doc_topics.withColumn("topic", topic).withColumn("theme", F.element_at(names, F.col("topic")))


def topic_coherence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``<topic, coherence>``: sum over word pairs of ln((D(later, earlier) + 1) / D(earlier)).

    D counts documents, and "earlier" is the better-ranked word. Each document is reduced to one bit
    mask per topic (which of the topic's words it holds), equal masks are counted, and the pair counts
    come from those few rows: no pair is emitted per document.
    """
    table = words.select("topic", "rank", "word").orderBy("topic", "rank").collect()
    terms = sorted({r.word for r in table})
    place = {w: i for i, w in enumerate(terms)}
    topics = sorted({r.topic for r in table})
    lists = {t: [place[r.word] for r in table if r.topic == t] for t in topics}
    if max(len(v) for v in lists.values()) > 62:
        raise ValueError("at most 62 words per topic")

    model = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="_hit", minTF=1.0)
    held = model.transform(docs.select("tokens")).select(F.unwrap_udt("_hit")["indices"].alias("held"))

    def mask(places: Sequence[int]):
        bits = [
            F.when(F.array_contains("held", p), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for i, p in enumerate(places)
        ]
        return sum(bits[1:], bits[0])

    masks = held.where(F.size("held") > 0).select(
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("topic"), mask(lists[t]).alias("mask")) for t in topics])
        ).alias("m")
    )
    counted = (
        masks.select("m.*").where("mask <> 0").groupBy("topic", "mask").agg(F.count("*").alias("docs"))
    )
    ranks = F.sequence(F.lit(0), F.lit(max(len(v) for v in lists.values()) - 1))

    def has(i):
        return F.expr(f"(shiftright(mask, {i}) & 1) = 1")

    singles = counted.select("topic", "mask", "docs", F.explode(ranks).alias("earlier")).where(has("earlier"))
    alone = singles.groupBy("topic", "earlier").agg(F.sum("docs").alias("d1"))
    pairs = (
        singles.select("topic", "mask", "docs", "earlier", F.explode(ranks).alias("later"))
        .where(F.col("later") > F.col("earlier"))
        .where(has("later"))
        .groupBy("topic", "earlier", "later")
        .agg(F.sum("docs").alias("d2"))
    )
    sizes = F.create_map(*[F.lit(v) for t in topics for v in (t, len(lists[t]))])
    wanted = (
        alone.select("topic", "earlier", "d1", F.explode(ranks).alias("later"))
        .where(F.col("later") > F.col("earlier"))
        .where(F.col("later") < F.element_at(sizes, F.col("topic")))
    )
    term = F.log((F.coalesce("d2", F.lit(0)) + 1) / F.col("d1"))
    return (
        wanted.join(pairs, ["topic", "earlier", "later"], "left")
        .groupBy("topic")
        .agg(F.sum(term).alias("coherence"))
    )


def best_matching(gain: np.ndarray) -> np.ndarray:
    """For each row of a square matrix a column of its own, so that the sum of the gains is greatest.

    Rows are added one by one; each is placed along the cheapest alternating path, with prices on rows and columns that
    keep every placed pair tight (shortest augmenting paths, cubic in the rows).
    """
    n = len(gain)
    cost = np.vstack([np.zeros(n + 1), np.hstack([np.zeros((n, 1)), gain.max(initial=0.0) - gain])])
    row_price, column_price = np.zeros(n + 1), np.zeros(n + 1)
    holder = np.zeros(n + 1, np.int64)  # row of each column; place 0 holds the row that looks for one
    for row in range(1, n + 1):
        holder[0], at = row, 0
        least, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while True:
            done[at] = True
            slack = cost[holder[at]] - row_price[holder[at]] - column_price
            better = ~done & (slack < least)
            least[better], came[better] = slack[better], at
            free = np.flatnonzero(~done)
            following = free[np.argmin(least[free])]
            step = least[following]
            row_price[holder[done]] += step
            column_price[done] -= step
            least[~done] -= step
            at = following
            if not holder[at]:
                break
        while at:
            holder[at] = holder[came[at]]
            at = came[at]
    match = np.empty(n, np.int64)
    match[holder[1:] - 1] = np.arange(n)
    return match


def topic_stability(runs: dict[int, tuple[TopicModel, Vocabulary]], spark: SparkSession, n_words: int = 10) -> DataFrame:
    """``<seed, other_seed, topic, other_topic, overlap>``: Jaccard overlap of the top words of topics that are matched across seeds.

    The matching is one-to-one and has the greatest sum of overlaps, so no topic answers for two. Only top words reach the driver.
    """
    sets = {}
    for seed, (model, vocab) in runs.items():
        words = topic_top_words(model.topic_terms(spark, n_words), vocab.table(spark), n_words)
        own = [set() for _ in range(model.n_topics)]
        for row in words.select("topic", "word").collect():
            own[row.topic].add(row.word)
        sets[seed] = own
    rows = []
    for seed, own in sets.items():
        for other_seed, others in sets.items():
            if seed < other_seed:
                k = max(len(own), len(others))
                overlap = np.zeros((k, k))
                for i, a in enumerate(own):
                    for j, b in enumerate(others):
                        overlap[i, j] = len(a & b) / max(1, len(a | b))
                for i, j in enumerate(best_matching(overlap).tolist()):
                    if i < len(own) and j < len(others):
                        rows += [(seed, other_seed, i, j, float(overlap[i, j])), (other_seed, seed, j, i, float(overlap[i, j]))]
    return spark.createDataFrame(rows, "seed int, other_seed int, topic int, other_topic int, overlap double")
