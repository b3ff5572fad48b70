"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on labelled statistics supply the rules: every path from a root is a conjunction of thresholds. A logistic model with
an L1 penalty keeps few of them, and those become one column expression, so that scoring is part of the scan of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import bounded_sample, crc_mod, table
from themeloom.session import drop_staged, stage

MAX_LABELLED = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.001
THRESHOLD = 0.3


def text_statistics(text: str = "text") -> dict[str, Column]:
    """Numbers that describe a whole text; none is null, an empty text has zeros."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.regexp_replace(whole, r"\A[ \t-\r]+|[ \t-\r]+\z", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.split(whole, "\n")
    n_chars, n_words = F.length(whole), F.size(words)
    some_chars, some_words = F.greatest(n_chars, F.lit(1)), F.greatest(n_words, F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)) / some_chars

    stats = {
        "n_words": n_words,
        "mean_word": n_chars / some_words,
        "distinct_words": F.size(F.array_distinct(words)) / some_words,
        "richness": F.log1p(F.size(F.array_distinct(words))) / F.log1p(some_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": n_words / F.size(lines),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "stops": share("[.!?]"),
        "signs": share(r"[^\p{L}\p{N}\s.,!?'\"-]"),
        "runs": share(r"([^\s])\1{3,}"),
    }
    return {k: v.cast("double") for k, v in stats.items()}


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic, "<=" or ">", threshold)`` hold."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        tests = [F.col(name) <= at if sign == "<=" else F.col(name) > at for name, sign, at in self.terms]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic score over rules; without rules the score is the same everywhere."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


    def score_of(self, stats: dict[str, Column]) -> Column:
        """The score as one expression of the statistics' own columns, each computed once a row.

        The rules are data in it, so the code that Spark generates stays small however many they are.
        """
        if not self.weights:
            return self.score()
        names = list(stats)

        def term(name: str, sign: str, at: float) -> Column:
            return F.struct(F.lit(names.index(name)).alias("i"), F.lit(sign == ">").alias("above"), F.lit(at).alias("at"))

        rules = F.array(
            *[F.struct(F.array(*[term(*t) for t in rule.terms]).alias("terms"), F.lit(weight).alias("weight")) for rule, weight in self.weights]
        )

        def scored(values: Column) -> Column:
            def holds(t: Column) -> Column:
                value = F.get(values, t["i"])
                return F.when(t["above"], value > t["at"]).otherwise(value <= t["at"])

            total = F.aggregate(rules, F.lit(self.intercept), lambda sum_, r: sum_ + F.when(F.forall(r["terms"], holds), r["weight"]).otherwise(0.0))
            return 1 / (1 + F.exp(-total))

        return F.element_at(F.transform(F.array(F.array(*stats.values())), scored), 1)


_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)$")


def tree_rules(trees: Sequence, names: Sequence[str]) -> list[Rule]:
    """The conjunctions that lead to the nodes of fitted trees, in the order of their first appearance.

    Of two tests of one statistic in one direction on a path only the stricter one stays.
    """
    rules: dict[Rule, None] = {}
    for tree in trees:
        path: list[tuple[int, str, str, float]] = []
        for line in tree.toDebugString.split("\n"):
            if not (found := _SPLIT.match(line)):
                continue
            depth, feature, sign, at = len(found[1]), int(found[2]), found[3], float(found[4])
            path = [step for step in path if step[0] < depth] + [(depth, names[feature], sign, at)]
            strict: dict[tuple[str, str], float] = {}
            for _, name, s, t in path:
                strict[name, s] = (min if s == "<=" else max)(t, strict.get((name, s), t))
            rules[Rule(tuple(sorted((n, s, t) for (n, s), t in strict.items())))] = None
    return list(rules)


def fit_rules(labelled: DataFrame, names: Sequence[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Fits trees and the sparse weights on ``<label, ...names>``, a bounded number of rows."""
    total, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, total):
        # One label only, or none: the score leans to it.
        return RuleEnsemble(0.0 if not total else 5.0 if positive else -5.0)
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(labelled)
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(vectors)
    rules = tree_rules(forest.trees, names)
    if not rules:
        return RuleEnsemble(5.0 if 2 * positive > total else -5.0)
    marks = F.array(*[rule.column().cast("double") for rule in rules])
    ready = labelled.select("label", array_to_vector(marks).alias("features"))
    fitted = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(ready)
    weighted = [(rule, float(w)) for rule, w in zip(rules, fitted.coefficients.toArray()) if w]
    return RuleEnsemble(float(fitted.intercept), tuple(weighted))


def _known(labels: DataFrame, folds: int) -> DataFrame:
    """``<id, label>`` of the labels that may be learnt from."""
    known = labels.where(crc_mod("doc_id", folds) != 0).groupBy(F.col("doc_id").cast("bigint").alias("id"))
    return known.agg(F.max("quality").cast("double").alias("label")).where("label is not null")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    threshold: float = THRESHOLD,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``<id, held_out, score, predicted>`` of every row of ``docs``, learnt from ``labels`` ``<doc_id, quality>``.

    Labels of ids with crc32 mod ``folds`` 0 are never used. At most about ``max_labelled`` labelled rows, chosen by a hash of
    the id, fit the rules. Null texts count as empty; rows with null or repeated ids stay and are scored by their texts; a label that is
    null is no label, of several the larger counts. Without labels every score is 0.5, with one label it leans to
    that. An empty table gives an empty result; other columns are ignored.
    """
    stats = text_statistics(text_col)
    held_out = (crc_mod(id_col, folds) == 0).alias("held_out")
    scored = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out, *[c.alias(k) for k, c in stats.items()])
    scored = stage(scored, "statistics")
    chosen = bounded_sample(_known(labels, folds), "id", max_labelled)
    labelled = stage(scored.join(F.broadcast(chosen), "id").select("id", "label", *stats), "labelled")
    score = fit_rules(labelled, list(stats)).score()
    drop_staged(chosen, labelled)
    return scored.select("id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    threshold: float = THRESHOLD,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """The rows of ``docs`` that the rules predict 1, with their columns; the texts are filtered where they are read.

    The sample to learn from is drawn from the labels, so that the statistics of its texts alone are computed before the pass over all.
    """
    stats = text_statistics(text_col)
    chosen = bounded_sample(_known(labels, folds), "id", max_labelled)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).join(F.broadcast(chosen), "id")
    labelled = stage(texts.select("id", "label", *[c.alias(k) for k, c in stats.items()]), "labelled")
    rules = fit_rules(labelled, list(stats))
    drop_staged(chosen, labelled)
    return docs.where(rules.score_of(stats) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
