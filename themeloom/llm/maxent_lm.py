"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

The probability of a word given the two words before it is that of its class, times that of its subclass in the class, times that of the
word in the subclass. Classes are bins of the words by falling count, of about equal mass; a class has ``WIDTH`` subclasses at most, and
one for each of its words if there are no more. Class and subclass are softmaxes over a
bias, which is the logarithm of the counts, and rows of hashed weights: for the class those of the word before, of the pair before and of
the word before that (a skip), for the subclass that of the word before. Words that share a subclass, all of them rare, have their share of its counts.

Every task of the training rows makes gradient updates over its own texts, a batch of tokens at a time; the tasks' weights are averaged,
each row by how often a task has met it. All words that are broadcast have outcomes of their own; the rarer rest share one outcome and
are told apart by their smoothed counts, so that the model is a distribution over all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.common import crc_mod, mixed, no_collection, offsets, slices, table
from themeloom.session import drop_staged, released_shuffles, stage

FOLDS = 10
SMOOTHING = 0.1
FREQUENT = 600_000
MASS_BINS = 64
WIDTH = 48
# Rows of hashed weights for class and subclass, powers of two up to 2^16; the model's size, whatever the corpus.
ROWS = (1 << 14, 1 << 15)
STEEPEST = 12.0
BATCH = 4096
RATE = 1.0
PRIOR = 4.0
ROUNDS = 1
# A task's numbers of words are dropped and begun anew beyond so many.
LEXICON = 500_000
ABSENT = -1e4
# No word holds a space, so this stands for the end of a text; the other hash for what is before its start.
END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"  ")


# --- the model ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Where the outcomes are: class and subclass of each, the logarithm of its share of the subclass, biases of the two choices."""

    classes: np.ndarray
    subclasses: np.ndarray
    shares: np.ndarray
    class_bias: np.ndarray
    subclass_bias: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, bins: int = MASS_BINS, width: int = WIDTH) -> Tree:
        size, mass = len(counts), counts + SMOOTHING
        order = np.argsort(-counts, kind="stable")
        share = np.cumsum(mass[order]) / mass.sum()
        cuts = np.searchsorted(share, np.arange(1, bins) / bins, side="left")
        first = np.unique(np.concatenate([[0], cuts[cuts < size]]))
        n = np.diff(np.append(first, size))
        own = np.repeat(np.arange(len(first)), n)
        classes, subclasses = np.empty(size, np.int32), np.empty(size, np.int32)
        classes[order], subclasses[order] = own, (np.arange(size) - first[own]) // -(-n // width)[own]
        sums = [np.zeros(len(first)), np.zeros((len(first), width))]
        np.add.at(sums[0], classes, mass)
        np.add.at(sums[1], (classes, subclasses), mass)
        biases = [
            np.where(s > 0, np.log(np.where(s > 0, s, 1.0) / s.sum(axis=-1, keepdims=True)), ABSENT).astype(np.float32) for s in sums
        ]
        return cls(classes, subclasses, np.log(mass / sums[1][classes, subclasses]).astype(np.float32), *biases)

    @property
    def outcomes(self) -> int:
        return len(self.classes)


def _rows(hashes: np.ndarray, salt: object, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(hashes + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(rows - 1)).astype(np.int64)


class Model:
    """A tree with its hashed weights, one table for each of the two choices."""

    def __init__(self, tree: Tree, tables: list[np.ndarray] | None = None, rows: tuple[int, int] = ROWS):
        self.tree = tree
        widths = (len(tree.class_bias), tree.subclass_bias.shape[1])
        self.tables = tables or [np.zeros((r, w), np.float32) for r, w in zip(rows, widths)]

    def choices(self, before: np.ndarray, skipped: np.ndarray, outcomes: np.ndarray) -> Iterator[tuple]:
        """For each choice: its number, the tokens that make it, biases, rows of hashed weights (one list per feature), what is chosen."""
        tree, sizes = self.tree, [len(t) for t in self.tables]
        own, sub = tree.classes[outcomes], tree.subclasses[outcomes]
        with np.errstate(over="ignore"):
            pair = skipped * np.uint64(0xC2B2AE3D27D4EB4F) + before
        features = [_rows(before, 1, sizes[0]), _rows(pair, 2, sizes[0]), _rows(skipped, 3, sizes[0])]
        yield 0, np.arange(len(outcomes)), tree.class_bias[None, :], features, own
        several = np.flatnonzero(tree.subclass_bias[own, 1] > ABSENT)
        c = own[several]
        yield 1, several, np.take(tree.subclass_bias, c, axis=0), [_rows(before[several], 8 + c, sizes[1])], sub[several]

    def _softmax(self, table: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits and their sums. Biases are 0 at most and weights ``STEEPEST``, so that none overflows."""
        x = np.take(table, features[0], axis=0)
        for rows in features[1:]:
            x += np.take(table, rows, axis=0)
        x += bias
        np.exp(x, out=x)
        return x, x.sum(axis=1)

    def log_probability(self, before: np.ndarray, skipped: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
        """Natural logarithm for every token; ``before`` and ``skipped`` are hashes of the two words before it."""
        out = self.tree.shares[outcomes].astype(np.float64)
        for cut in range(0, len(out), BATCH):
            part = slice(cut, cut + BATCH)
            for k, at, bias, features, chosen in self.choices(before[part], skipped[part], outcomes[part]):
                if len(at):
                    x, total = self._softmax(self.tables[k], bias, features)
                    out[part][at] += np.log(x[np.arange(len(at)), chosen] / total)
        return out


class Learner:
    """Gradient updates of a model's weights; a row's step shrinks with the gradients that it has met (AdaGrad by row)."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, np.float32(rate)
        self.squares = [np.zeros(len(t), np.float32) for t in model.tables]
        self.met = [np.zeros(len(t), np.float32) for t in model.tables]

    def learn(self, before: np.ndarray, skipped: np.ndarray, outcomes: np.ndarray) -> None:
        for cut in range(0, len(outcomes), BATCH):
            part = slice(cut, cut + BATCH)
            for k, at, bias, features, chosen in self.model.choices(before[part], skipped[part], outcomes[part]):
                if len(at):
                    slope, total = self.model._softmax(self.model.tables[k], bias, features)
                    slope *= (-1 / total)[:, None]
                    slope[np.arange(len(at)), chosen] += 1
                    for rows in features:
                        self._update(k, rows, slope)

    def _update(self, k: int, rows: np.ndarray, slope: np.ndarray) -> None:
        by = np.argsort(rows.astype(np.uint16), kind="stable")
        ordered = rows[by]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        own, n = ordered[first], np.diff(np.append(first, len(rows)))
        sums = _group_sums(slope, by, first, n)
        self.met[k][own] += n
        self.squares[k][own] += np.einsum("ij,ij->i", sums, sums)
        sums *= (self.rate / np.sqrt(1 + self.squares[k][own]))[:, None]
        sums += self.model.tables[k][own]
        self.model.tables[k][own] = np.clip(sums, -STEEPEST, STEEPEST, out=sums)


_FEW = 8


def _group_sums(values: np.ndarray, by: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``values[by]`` over groups that begin at ``first`` and have ``n`` rows: small groups all at once, large ones each."""
    sums = values[by[first]]
    for k in range(1, min(_FEW, int(n.max(initial=1)))):
        some = np.flatnonzero((n > k) & (n <= _FEW))
        sums[some] += values[by[first[some] + k]]
    for g in np.flatnonzero(n > _FEW):
        sums[g] = values[by[first[g] : first[g] + n[g]]].sum(axis=0)
    return sums


_BLOCK = 512


def _learned(shared, vocabulary):
    """One pass of updates over a task's texts; its weights, times how often it has met their rows, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tables = shared.value
        learner, lexicon = Learner(Model(Tree(**tree), [t.copy() for t in tables])), Lexicon(Vocabulary(**vocabulary.value))
        for batch in slices(batches, "text"):
            words, sizes = lexicon.words(batch.column("text"))
            learner.learn(*lexicon.contexts(words, sizes), lexicon.outcomes[words])
        for k, (weights, met) in enumerate(zip(learner.model.tables, learner.met)):
            for block in range(0, len(weights), _BLOCK):
                n = met[block : block + _BLOCK]
                if n.any():
                    both = [(weights[block : block + _BLOCK] * n[:, None]).tobytes(), n.tobytes()]
                    columns = [pa.array([k], pa.int32()), pa.array([block], pa.int32()), *(pa.array([b], pa.binary()) for b in both)]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "block", "weights", "met"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[:1].copy()
    for c in ("weights", "met"):
        first[c] = [np.sum([np.frombuffer(b, np.float32) for b in rows[c]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]
    return first


def fit(training: DataFrame, vocabulary, tree: Tree, rounds: int = ROUNDS, rows: tuple[int, int] = ROWS) -> Model:
    """The model after ``rounds`` passes over ``<text>``; a pass is one set of tasks whose weights are averaged.

    A row that tasks have met n times in all moves to their mean by n / (n + ``PRIOR``), so rare rows stay near zero. What reaches
    the driver is one model of fixed size.
    """
    context = training.sparkSession.sparkContext
    model = Model(tree, rows=rows)
    texts = training.coalesce(2 * context.defaultParallelism)
    for _ in range(rounds):
        shared = context.broadcast((vars(tree), model.tables))
        parts = texts.mapInArrow(_learned(shared, vocabulary), "k int, block int, weights binary, met binary")
        with released_shuffles(training.sparkSession):
            sums = parts.groupBy("k", "block").applyInPandas(_summed, parts.schema).collect()
        shared.destroy()
        for r in sums:
            n = np.frombuffer(r["met"], np.float32)
            total = np.frombuffer(r["weights"], np.float32).reshape(len(n), -1)
            part = model.tables[r["k"]][r["block"] : r["block"] + len(n)]
            part[n > 0] = (total[n > 0]) / (n[n > 0, None] + PRIOR)
    return model


# --- the corpus ---------------------------------------------------------------------------------------


class Lexicon(dict):
    """Words of a task by number, with their hashes and, given a vocabulary, counts (-1: not held) and outcomes."""

    def __init__(self, vocabulary: Vocabulary | None = None):
        super().__init__()
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.counts, self.outcomes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self[b" "]

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of some texts, an end (number 0) after each, and how many each text has."""
        if len(self) > LEXICON:
            self._reset()
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = parts.flatten()
        # White space at either end of a text leaves an empty part there.
        real = np.asarray(pc.not_equal(pc.binary_length(found), 0))
        of = np.repeat(np.arange(len(texts)), np.asarray(parts.value_lengths()))
        sizes = np.bincount(of[real], minlength=len(texts)) + 1
        encoded = found.filter(pa.array(real)).dictionary_encode()
        with no_collection():
            distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
            numbers = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        words = np.zeros(int(sizes.sum()), np.int64)
        inner = np.ones(len(words), bool)
        inner[np.cumsum(sizes) - 1] = False
        words[inner] = numbers[np.asarray(encoded.indices)]
        if self.fresh:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.fresh], np.uint64)
            self.hashes = np.append(self.hashes, hashes)
            if self.vocabulary:
                counts, outcomes = self.vocabulary.look_up(hashes)
                self.counts, self.outcomes = np.append(self.counts, counts), np.append(self.outcomes, outcomes)
            self.fresh = []
        return words, sizes

    def contexts(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word before each token and of the one before that; a hash of its own stands before a text."""
        hashes = self.hashes[words]
        starts, start = offsets(sizes)[:-1], np.uint64(START)
        before = np.concatenate([[start], hashes[:-1]])[: len(words)]
        before[starts] = start
        skipped = np.concatenate([[start], before[:-1]])[: len(words)]
        skipped[starts] = start
        return before, skipped


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon, totals = Lexicon(), np.zeros(0, np.int64)

    def flushed(hashes: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(totals)
        return pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(totals[some])], ["word", "n"])

    for batch in slices(batches, "text"):
        hashes = lexicon.hashes
        words, _ = lexicon.words(batch.column("text"))
        if len(lexicon.hashes) < len(totals):  # numbers begin anew
            yield flushed(hashes)
            totals = np.zeros(0, np.int64)
        counts = np.bincount(words, minlength=len(lexicon.hashes))
        counts[: len(totals)] += totals
        totals = counts
    yield flushed(lexicon.hashes if len(totals) else np.zeros(0, np.uint64))


@dataclass
class Vocabulary:
    """Counts of the frequent words by hash (sorted), and the totals of the training tokens. Outcome 0 is all words that are not held."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int

    @classmethod
    def of(cls, counts: DataFrame, most: int) -> Vocabulary:
        """From ``<word, n>``. The words of at least some count are held, as many as ``most`` allows."""
        level = F.floor(F.log2("n") * 16).alias("level")
        levels = counts.groupBy(level).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
        left, least = most, None
        for row in sorted(levels, key=lambda r: -r["level"]):
            left -= row["words"]
            if left < 0:
                break
            least = row["level"]
        end = F.col("word") == int(np.uint64(END).astype(np.int64))
        wanted = end if least is None else (level >= least) | end
        held = counts.where(wanted).toArrow()
        hashes, n = held.column("word").to_numpy().view(np.uint64), held.column("n").to_numpy()
        by = np.argsort(hashes)
        return cls(hashes[by], n[by], sum(r["tokens"] for r in levels), sum(r["words"] for r in levels))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not held) and outcomes of words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = self.hashes[at] == hashes
        return np.where(held, self.counts[at], -1), np.where(held, at + 1, 0)

    def others(self) -> tuple[int, int]:
        """Tokens and distinct words of the shared outcome."""
        return self.tokens - int(self.counts.sum()), self.distinct - len(self.counts)

    def tree(self) -> Tree:
        return Tree.of(np.concatenate([[self.others()[0]], self.counts]).astype(np.float64))


def _scores(shared, vocabulary):
    """Sums of what a task knows about its texts, and the rare words that are looked up by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tables = shared.value
        model, lexicon = Model(Tree(**tree), tables), Lexicon(Vocabulary(**vocabulary.value))
        for batch in slices(batches, "text"):
            words, sizes = lexicon.words(batch.column("text"))
            modelled = model.log_probability(*lexicon.contexts(words, sizes), lexicon.outcomes[words]) / np.log(10)
            counts = lexicon.counts[words]
            held, starts = counts >= 0, offsets(sizes)[:-1]
            sums = {
                "n_tokens": sizes,
                "n_known": np.add.reduceat(held.astype(np.int64), starts),
                "log_counts": np.add.reduceat(np.where(held, np.log10(np.maximum(counts, 0) + SMOOTHING), 0.0), starts),
                "modelled": np.add.reduceat(modelled, starts),
            }
            rare = np.add.reduceat((~held).astype(np.int64), starts)
            unknown = lexicon.hashes[words[~held]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets(rare).astype(np.int32)), pa.array(unknown))
            columns = {"id": batch.column("id"), "held_out": batch.column("held_out")}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in sums.items()} | {"rare": lists})

    return run


_SCORE_ROWS = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, modelled double, rare array<bigint>"
)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    frequent: int = FREQUENT,
    rounds: int = ROUNDS,
    rows: tuple[int, int] = ROWS,
) -> DataFrame:
    """``<id, held_out, n_tokens, n_known, train_tokens, base_score, score>`` of every row of ``docs``.

    Counts and weights come from all rows whose crc32 of the id modulo ``folds`` is not 0. Scores are log10 probabilities of whole
    texts, the end of the text included. Null texts count as empty and have the end only; rows with null or repeated ids stay; without
    training rows every word is unknown. An empty table gives an empty result; other columns are ignored.

    Words are told apart by 64-bit hashes. At most ``frequent`` words are broadcast and have outcomes of their own; all others meet
    their counts in a join. The hashed weights are a model of a fixed size, ``rows`` rows for the two choices.
    """
    if frequent > FREQUENT:
        raise ValueError(f"at most {FREQUENT} words are broadcast")
    context = docs.sparkSession.sparkContext
    held_out = (crc_mod(id_col, folds) == 0).alias("held_out")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = narrow.where("NOT held_out").select("text")
    counts = training.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    known = Vocabulary.of(counts, frequent)
    vocabulary, tree = context.broadcast(vars(known)), known.tree()
    model = fit(training, vocabulary, tree, rounds, rows)
    shared = context.broadcast((vars(tree), model.tables))

    found = narrow.mapInArrow(_scores(shared, vocabulary), _SCORE_ROWS).withColumn("row", F.monotonically_increasing_id())
    found = stage(found, "scores")
    rare = found.select("row", F.explode(F.col("rare")).alias("word")).join(counts, "word", "left")
    looked_up = rare.groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("more_logs")
    )
    other_tokens, other_words = known.others()
    all_mass = float(np.log10(known.tokens + SMOOTHING * (known.distinct + 1)))
    other_mass = float(np.log10(other_tokens + SMOOTHING * (other_words + 1)))
    logs = F.coalesce("more_logs", F.lit(0.0))
    scored = found.join(looked_up, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(all_mass)).alias("base_score"),
        (F.col("modelled") + logs - F.size("rare") * F.lit(other_mass)).alias("score"),
    )
    scored = stage(scored, "scored")
    drop_staged(counts, found)
    return scored


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
