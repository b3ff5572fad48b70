"""Themes scored by a language model: prompts out, responses in.

The model itself is the user's: it reads the prompt table and fills a response table
``<grp, perspective, segment, attempt, response>``. Group texts travel in bounded segments (see
``concat_group_text``), so a prompt never holds a whole corpus and no text is cut off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.operators.ranking import by_score, top_n_per_group
from themeloom.operators.themes import GLOBAL

# The names of the perspectives. The wording is the caller's to replace.
NAMES = ("theological", "narrative", "emotional", "literary")
PERSPECTIVES = {name: f"Below is one part of a collection. Under which index words would a catalogue of {name} subjects list it, and how strongly?" for name in NAMES}
RULES = (
    "\nAnswer with one JSON list of pairs and nothing else, for example [[\"harbour\", 0.8], [\"storm\", 0.35]]. "
    "A pair is a word of at least two letters without blanks and hyphens, and a number from 0 (barely present) to 1 (central). "
    "Name no word twice.\n\n"
)

THEME_LIST = "array<struct<word:string,weight:double>>"


def prompt_table(group_texts: DataFrame, perspectives: Mapping[str, str] = PERSPECTIVES, rules: str = RULES) -> DataFrame:
    """One prompt per group segment and perspective; the perspectives are a literal array, not a join."""
    asked = F.array(*[F.struct(F.lit(n).alias("perspective"), F.lit(t).alias("ask")) for n, t in perspectives.items()])
    rest = [c for c in group_texts.columns if c != "content"]
    return group_texts.withColumn("_p", F.explode(asked)).select(
        *rest,
        F.col("_p.perspective").alias("perspective"),
        F.concat(F.col("_p.ask"), F.lit(rules), F.col("content")).alias("prompt"),
    )


def response_list(response: Column) -> Column:
    """Text from the first ``[`` to the last ``]``, parsed: ``array<variant>``, null when it is no list."""
    text = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``items array<variant>``."""
    return responses.withColumn("items", response_list(F.col("response")))


def _pair(item: Column) -> Column:
    """``struct<word, weight>`` of a valid ``[word, weight]`` item, null otherwise.

    The kinds of both parts are tested, because a cast would accept "0.5" and true as weights.
    """
    word = F.try_variant_get(item, "$[0]", "string")
    weight = F.try_variant_get(item, "$[1]", "double")
    kind = F.schema_of_variant(F.try_variant_get(item, "$[1]", "variant"))
    valid = (
        (F.size(F.try_variant_get(item, "$", "array<variant>")) == 2)
        & (F.schema_of_variant(F.try_variant_get(item, "$[0]", "variant")) == "STRING")
        & (F.length(word) >= 2)
        & ~F.rlike(word, F.lit("[ -]"))
        & (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
        & weight.between(0, 1)
    )
    return F.when(valid, F.struct(word.alias("word"), weight.alias("weight")))


def validate_responses(responses: DataFrame) -> DataFrame:
    """Add ``themes array<struct<word, weight>>`` and ``valid``.

    A response is valid as a whole or not at all; an empty list is valid.
    """
    paired = parse_responses(responses).withColumn("_pairs", F.transform("items", _pair))
    valid = F.coalesce(F.forall("_pairs", lambda p: p.isNotNull()), F.lit(False))
    checked = paired.withColumn("valid", valid)
    return checked.select(
        *responses.columns,
        "valid",
        F.when(F.col("valid"), F.col("_pairs")).cast(THEME_LIST).alias("themes"),
    )


def first_valid_attempt(
    validated: DataFrame, keys: Sequence[str] = ("grp", "perspective"), max_attempts: int = 10
) -> DataFrame:
    """``<keys..., attempt, themes>``: the earliest valid attempt; an empty list when there is none.

    One aggregate that keeps a single candidate per key and task.
    """
    usable = F.when(F.col("valid") & (F.col("attempt") <= max_attempts), F.col("attempt"))
    best = F.min_by(F.struct("attempt", "themes"), usable)
    return (
        validated.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, "b.attempt", F.coalesce("b.themes", F.array().cast(THEME_LIST)).alias("themes"))
    )


def merge_perspectives(chosen: DataFrame, n_global: int = 50, n_peripheral: int = 30) -> DataFrame:
    """``<grp, rank, word, score>``: lower-cased union over perspectives and segments, best score per word."""
    words = chosen.select("grp", F.inline("themes")).select(
        "grp", F.lower("word").alias("word"), F.col("weight").alias("score")
    )
    best = words.groupBy("grp", "word").agg(F.max("score").alias("score"))
    ranked = top_n_per_group(best, ["grp"], [by_score("score"), "word"], max(n_global, n_peripheral))
    return ranked.where(
        F.col("rank") <= F.when(F.col("grp") == GLOBAL, n_global).otherwise(n_peripheral)
    ).select("grp", "rank", "word", "score")
