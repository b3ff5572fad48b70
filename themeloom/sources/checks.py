"""Checks and preparation at the entry of a plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from themeloom.functions.text import has_words, word_count_norefs, word_count_plain


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error before any job when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_nonempty(df: DataFrame, what: str = "sections") -> DataFrame:
    """The frame itself, or an error when it has no row; reads one row."""
    if df.isEmpty():
        raise ValueError(f"no {what} were produced")
    return df


def refuse_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """The frame itself, or an error when ``column`` has a value that stands for something else in the result."""
    if not df.where(F.col(column) == value).isEmpty():
        raise ValueError(f"{column} must not be {value!r}, which names the whole corpus")
    return df


def prepare_documents(docs: DataFrame, strip_refs: bool = True) -> DataFrame:
    """Null content becomes '', ``word_count`` is added and documents without words are dropped.

    The filter is a cheap test of its own: Spark pushes it to the scan, and a filter on the count would
    make it count every text twice.
    """
    filled = docs.withColumn("content", F.coalesce(F.col("content").cast("string"), F.lit("")))
    count = word_count_norefs if strip_refs else word_count_plain
    kept = filled.where(has_words(F.col("content"), strip_refs))
    return kept.withColumn("word_count", count(F.col("content")))


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reject_reason``: the first rule that holds for the row, null for a good row.

    A bad row never stops a job; ``where reject_reason is null`` goes on and the others are kept aside.
    """
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("reject_reason", reason)
