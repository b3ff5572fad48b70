"""Text columns: every function takes and returns Column expressions, so all of it runs in the JVM.

Character classes are Unicode ones, because ``\\w`` and ``\\s`` are ASCII-only in Java. White space is named
by its property: a negated list of ranges is an order of magnitude slower.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from themeloom.functions.stopwords import ENGLISH

SPACES = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
WORD = r"\p{L}\p{N}_"

# Markers around the body of a public-domain book, and words that name small numbers.
BOOK_STARTS = (
    "*** START OF THIS PROJECT GUTENBERG",
    "*** START OF THE PROJECT GUTENBERG",
    "The Project Gutenberg EBook of",
)
BOOK_ENDS = (
    "*** END OF THIS PROJECT GUTENBERG",
    "*** END OF THE PROJECT GUTENBERG",
    "End of the Project Gutenberg",
)
SCRIPTURE_STARTS = ("THE FIRST BOOK OF MOSES, CALLED GENESIS", "THE OLD TESTAMENT", "GENESIS")
SCRIPTURE_ENDS = (
    "*** END OF THE PROJECT",
    "*** END OF THIS PROJECT",
    "End of the Project Gutenberg",
    "THE END OF THE NEW TESTAMENT",
)
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """``[0, 1, ..., n-1]``; empty when n is 0."""
    return F.filter(F.sequence(F.lit(0), n), lambda i: i < n)


def split_words(text: Column) -> Column:
    """Whitespace-separated tokens, no empty ones."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def normalize_text(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-case, delete punctuation, drop stop words, join with one space.

    Stop words are tested after the punctuation is gone: "don't" has become "dont" and stays.
    """
    bare = F.regexp_replace(F.lower(text), f"[^{WORD}{SPACES}]", "")
    return F.array_join(remove_stopwords(split_words(bare), stop_words), " ")


def tokenize_words(text: Column) -> Column:
    """Lower-case word runs of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def tokenize_alpha(text: Column) -> Column:
    """Lower-case word runs made only of ASCII letters ("abc1" and "café" give nothing)."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(f"(?<![{WORD}])[a-z]++(?![{WORD}])"), F.lit(0)
    )


def remove_stopwords(tokens: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Drop stop words from a token array; the list is a hash set inside the plan, not a join."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def clean_theme_word(word: Column) -> Column:
    """Letters only, lower-case; null when shorter than three or the name of a small number."""
    letters = F.regexp_replace(F.lower(word), "[^a-zA-Z]", "")
    return F.when((F.length(letters) >= 3) & ~letters.isin(*NUMBER_WORDS), letters)


def word_count_plain(text: Column) -> Column:
    return F.size(split_words(text))


def word_count_norefs(text: Column) -> Column:
    """Whitespace tokens after deleting ``chapter:verse`` references."""
    return word_count_plain(F.regexp_replace(text, r"\p{Nd}+:\p{Nd}+", ""))


def has_words(text: Column, strip_refs: bool = True) -> Column:
    """Whether any word is left; most texts are decided by their first letter, without counting."""
    count = word_count_norefs(text) if strip_refs else word_count_plain(text)
    return F.rlike(text, F.lit(rf"[^{SPACES}\p{{Nd}}:]")) | (count > 0)


def _first_found(text: Column, markers: Sequence[str]) -> Column:
    """1-based position of the first marker, in list order, that occurs; null when none does."""
    return F.coalesce(*[F.nullif(F.locate(m, text), F.lit(0)) for m in markers])


def trim_boilerplate(
    text: Column, starts: Sequence[str] = BOOK_STARTS, ends: Sequence[str] = BOOK_ENDS
) -> Column:
    """Body between the line that holds a start marker and the first end marker in list order."""
    skip = F.coalesce(F.position(F.lit("\n"), text, _first_found(text, starts)), F.lit(0))
    stop = F.coalesce(_first_found(text, ends) - 1, F.length(text))
    return F.substring(text, skip + 1, F.greatest(stop - skip, F.lit(0)))


def extract_span(
    text: Column, starts: Sequence[str] = SCRIPTURE_STARTS, ends: Sequence[str] = SCRIPTURE_ENDS
) -> Column:
    """Upper-cased text from the earliest start marker to the earliest end marker.

    No start marker gives the empty text; no end marker runs to the end. Markers are compared
    case-insensitively.
    """

    def earliest(upper: Column, markers: Sequence[str]) -> Column:
        found = [F.nullif(F.locate(m.upper(), upper), F.lit(0)) for m in markers]
        return F.least(*found) if len(found) > 1 else found[0]

    def cut(upper: Column) -> Column:
        first = F.coalesce(earliest(upper, starts), F.length(upper) + 1)
        last = F.coalesce(earliest(upper, ends), F.length(upper) + 1)
        span = F.substring(upper, first, F.greatest(last - first, F.lit(0)))
        return F.regexp_replace(span, f"^[{SPACES}]+|[{SPACES}]+$", "")

    return let(F.upper(text), cut)


def split_sentences(text: Column) -> Column:
    """Sentences of whitespace-collapsed text: a cut after ``.``, ``!`` or ``?`` and a space."""
    return F.split(collapse_whitespace(text), r"(?<=[.!?]) ")


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one document, ordered by term.

    Sorting the tokens and measuring the runs keeps the counting inside the row: a corpus needs no
    shuffle by (document, term).
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s)),
            lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def source_id(path: Column, url: Column) -> Column:
    """Stem of the file name; for a source without a file, the first ten hex digits of md5(url)."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(stem, F.lit("")), F.substring(F.md5(url.cast("binary")), 1, 10))
