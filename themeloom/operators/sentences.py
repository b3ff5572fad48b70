"""Sentence boundaries learnt from the corpus: which words keep their full stop although no sentence ends there.

An abbreviation is a word that is nearly always followed by a full stop, is short, and may hold further stops. The score is the
log-likelihood ratio of "a stop follows almost always" against "a stop follows as often as after any word", damped by the length
of the word and by its occurrences without a stop (Kiss and Strunk, Computational Linguistics 32, 2006). Counting is one aggregate by word with
map-side combine; what is broadcast are the abbreviations, whose number is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.functions.text import collapse_whitespace, let
from themeloom.operators.ranking import bounded

# Fixed values of the published method: the likelihood of a stop after an abbreviation, and the least score of one.
ALWAYS = 0.99
LEAST_SCORE = 0.3
MAX_ABBREVIATIONS = 20_000


def stop_counts(docs: DataFrame) -> DataFrame:
    """``<word, with_stop, without_stop>`` of the lower-case words of ``content`` that are letters and inner stops."""
    tokens = docs.select(F.explode(F.split(collapse_whitespace(F.col("content")), " ")).alias("token"))
    bare = F.lower(F.regexp_replace("token", r"\.$", "")).alias("word")
    words = tokens.select(bare, F.col("token").endswith(".").alias("stop")).where(F.rlike("word", F.lit(r"^\p{L}[\p{L}.]*$")))
    return words.groupBy("word").agg(F.count_if("stop").alias("with_stop"), F.count_if(~F.col("stop")).alias("without_stop"))


def abbreviation_scores(docs: DataFrame) -> DataFrame:
    """``<word, with_stop, without_stop, score>`` of all words that a stop follows at least once."""
    counts = stop_counts(docs)
    share = counts.agg(F.sum("with_stop") / F.sum(F.col("with_stop") + F.col("without_stop"))).scalar()
    with_stop, without = F.col("with_stop"), F.col("without_stop")
    # A corpus of nothing but stops has no words to tell apart.
    p = F.least(share, F.lit(ALWAYS))
    ratio = 2 * (with_stop * (F.log(F.lit(ALWAYS)) - F.log(p)) + without * (F.log(F.lit(1 - ALWAYS)) - F.log(1 - p)))
    letters = F.length(F.replace("word", F.lit(".")))
    stops = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * stops * F.pow(letters.cast("double"), -without)
    return counts.where("with_stop > 0").withColumn("score", score)


def abbreviations(docs: DataFrame, least: float = LEAST_SCORE) -> list[str]:
    """The words whose score is at least ``least``, sorted; more than ``MAX_ABBREVIATIONS`` are an error."""
    found = abbreviation_scores(docs).where(F.col("score") >= least).select("word")
    return sorted(r.word for r in bounded(found, MAX_ABBREVIATIONS, "abbreviations").collect())


def split_sentences_by(text: Column, known: Sequence[str]) -> Column:
    """Sentences of whitespace-collapsed text: a cut after ``.``, ``!`` or ``?`` and a space, but not after a full stop that belongs to a word.

    That is so after a known abbreviation, after an initial (a single letter), and after a number before a word in lower case (an ordinal).
    """

    def joined(pieces: Column) -> Column:
        def closed(piece: Column, i: Column) -> Column:
            word = F.lower(F.regexp_extract(piece, r"([^ ]+)\.$", 1))
            held = word.isin(list(known)) if known else F.lit(False)
            initial = F.rlike(word, F.lit(r"^[^\p{L}]*\p{L}$"))
            ordinal = F.rlike(word, F.lit(r"^\p{Nd}+$")) & F.coalesce(F.rlike(F.get(pieces, i + 1), F.lit(r"^\p{Ll}")), F.lit(False))
            return F.concat(piece, F.when((word != "") & (held | initial | ordinal), " ").otherwise("\n"))

        # No line feed is left in the text, so it can stand for the cuts.
        whole = F.array_join(F.transform(pieces, closed), "")
        return F.split(F.regexp_replace(whole, r"[ \n]$", ""), "\n")

    return let(F.split(collapse_whitespace(text), r"(?<=[.!?]) "), joined)
