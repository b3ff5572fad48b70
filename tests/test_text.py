import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions.stopwords import read_stop_words
from themeloom.operators import sections, sentences


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "t string").select(column_of(F.col("t")).alias("x")).first().x


def test_normalize_tests_stop_words_after_punctuation(spark):
    assert one(spark, tx.normalize_text, "I don't  LIKE the café, 3 times!") == "dont like café 3 times"


@pytest.mark.parametrize(
    "text, words, alpha",
    [
        ("The a1 café b_c x dog-cat", ["the", "a1", "café", "b_c", "dog", "cat"], ["the", "x", "dog", "cat"]),
        ("", [], []),
        ("É é ǆ 12", ["12"], []),
    ],
)
def test_tokens(spark, text, words, alpha):
    assert one(spark, tx.tokenize_words, text) == words
    assert one(spark, tx.tokenize_alpha, text) == alpha


def test_all_unicode_white_space_separates(spark):
    blanks = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    text = "".join(f"w{i}{c}" for i, c in enumerate(blanks))
    assert one(spark, tx.split_words, text) == text.split()
    assert one(spark, tx.collapse_whitespace, text) == " ".join(text.split())


@pytest.mark.parametrize("word, clean", [("Love!", "love"), ("Ab1", None), ("SEVEN", None), ("eight", "eight"), ("éclair", "clair")])
def test_clean_theme_word(spark, word, clean):
    assert one(spark, tx.clean_theme_word, word) == clean


def test_word_counts(spark):
    assert one(spark, tx.word_count_plain, " 1:1 In the\tbeginning\n") == 4
    assert one(spark, tx.word_count_norefs, " 1:1 In the\tbeginning 12:34\n") == 3


@pytest.mark.parametrize("text, has", [("1:2 3:4", False), ("1:2 x", True), (" \n", False), ("12", True), ("1:", True), ("", False)])
def test_has_words_agrees_with_the_count(spark, text, has):
    assert one(spark, tx.has_words, text) is has
    assert (one(spark, tx.word_count_norefs, text) > 0) is has


@pytest.mark.parametrize(
    "text, body",
    [
        ("x\n*** START OF THE PROJECT GUTENBERG y\nbody\n*** END OF THE PROJECT GUTENBERG z", "body\n"),
        ("*** START OF THE PROJECT GUTENBERG no newline", "*** START OF THE PROJECT GUTENBERG no newline"),
        ("plain", "plain"),
        ("*** END OF THIS PROJECT GUTENBERG\n*** START OF THE PROJECT GUTENBERG\nlate", ""),
        ("The Project Gutenberg EBook of\na\n*** START OF THIS PROJECT GUTENBERG\nb", "b"),
    ],
)
def test_trim_boilerplate(spark, text, body):
    assert one(spark, tx.trim_boilerplate, text) == body


def test_extract_span(spark):
    assert one(spark, tx.extract_span, "pre the old testament Genesis abc end of the project gutenberg z") == "THE OLD TESTAMENT GENESIS ABC"
    assert one(spark, tx.extract_span, "nothing here") == ""
    assert one(spark, tx.extract_span, "genesis to the end") == "GENESIS TO THE END"


def test_term_counts(spark):
    rng = random.Random(3)
    tokens = [rng.choice("a b c dd eé z".split()) for _ in range(200)]
    got = one(spark, lambda t: tx.term_counts(F.split(t, " ")), " ".join(tokens))
    assert {r.term: r.tf for r in got} == Counter(tokens)
    assert [r.term for r in got] == sorted(set(tokens))
    assert one(spark, lambda t: tx.term_counts(tx.tokenize_alpha(t)), "") == []


def test_source_id(spark):
    rows = spark.createDataFrame([("file:/a/b/my.book.txt", "u"), (None, "http://x/y")], "p string, u string")
    ids = [r.s for r in rows.select(tx.source_id(F.col("p"), F.col("u")).alias("s")).collect()]
    assert ids == ["my.book", hashlib.md5(b"http://x/y").hexdigest()[:10]]


# --- sections ---------------------------------------------------------------------------------------


def fold(sentences, chunk_size, overlap, least):
    """The chunking rule, sentence by sentence."""
    chunks, held = [], []
    for sentence in sentences:
        size = sum(map(len, held))
        if size >= least and size + len(sentence) > chunk_size:
            chunks.append(" ".join(held))
            tail = []
            for s in reversed(held):
                if sum(map(len, tail)) + len(s) > overlap:
                    break
                tail.insert(0, s)
            held = tail
        held = [*held, sentence]
    if held and sum(map(len, held)) >= least:
        chunks.append(" ".join(held))
    return chunks


@pytest.mark.parametrize("limits", [(1000, 100, 100), (60, 25, 10), (30, 0, 1), (20, 50, 5)])
def test_chunks_equal_the_fold(docs, limits):
    rng = random.Random(sum(limits))
    texts = [
        " ".join("x" * rng.randint(1, 40) + rng.choice(".!?") for _ in range(rng.randint(0, 60))) for _ in range(30)
    ]
    got = {}
    for r in sections.chunk_sentences(docs(*texts, ""), *limits).collect():
        got.setdefault(r.doc_id, {})[r.position] = r.content
    for i, text in enumerate(texts):
        want = fold([s for s in text.split(" ") if s], *limits)
        assert [got.get(i, {})[p] for p in sorted(got.get(i, {}))] == want
        assert sorted(got.get(i, {})) == list(range(1, len(want) + 1))


def test_number_sections_keeps_long_ones(docs):
    rows = sections.text_sections(docs("A" * 150 + ". " + "B" * 40 + ".", "short."), 160, 0, 100).collect()
    assert [(r.doc_id, r.title, r.position) for r in rows] == [(0, "Section 1", 1)]


VERSES = """PREFACE
GENESIS
1:1 First verse
wraps here
1:2 Second: verse
2:1 Other chapter
SECOND BOOK
not a verse
1:1 Lone
EMPTY BOOK

"""


def test_headings_and_verses(docs):
    parts = sections.split_headings(docs(VERSES), "GENESIS|[A-Z]+ BOOK")
    assert [r.heading for r in parts.orderBy("part").collect()] == ["GENESIS", "SECOND BOOK"]
    verses = sections.split_chapters(parts).orderBy("part", "chapter", "verse").collect()
    assert [(r.heading, r.chapter, r.verse, r.content) for r in verses] == [
        ("GENESIS", 1, 1, "First verse wraps here"),
        ("GENESIS", 1, 2, "Second: verse"),
        ("GENESIS", 2, 1, "Other chapter"),
        ("SECOND BOOK", 1, 1, "Lone"),
    ]
    found = sections.verse_sections(parts).orderBy("part", "position").collect()
    assert [(r.title, r.content, r.category) for r in found] == [
        ("GENESIS 1:1-2", "First Verse Wraps Here Second: Verse", "OLD_TESTAMENT"),
        ("GENESIS 2:1-1", "Other Chapter", "OLD_TESTAMENT"),
        ("SECOND BOOK 1:1-1", "Lone", "NEW_TESTAMENT"),
    ]


def test_verse_windows_restart_in_each_chapter(docs):
    text = "GENESIS\n" + "\n".join(f"{c}:{v} v{v}" for c in (1, 2) for v in range(1, 24))
    rows = sections.verse_sections(sections.split_headings(docs(text), "GENESIS")).orderBy("position").collect()
    assert [r.title.split()[1] for r in rows] == ["1:1-10", "1:11-20", "1:21-23", "2:1-10", "2:11-20", "2:21-23"]


def test_line_windows(docs):
    rows = sections.line_windows(docs("\n".join(f"l{i}" for i in range(23)))).orderBy("window").collect()
    assert [(r.first_line, r.last_line) for r in rows] == [(1, 10), (11, 20), (21, 23)]
    assert rows[2].content == "l20 l21 l22"


def test_lookup_join_defaults(spark):
    df = spark.createDataFrame([("A",), ("B",)], "heading string")
    lookup = spark.createDataFrame([("A", "first")], "heading string, category string")
    rows = sections.categorize_by_lookup(df, lookup, outside="rest").collect()
    assert {r.heading: r.category for r in rows} == {"A": "first", "B": "rest"}


def test_group_text_segments_join_to_the_whole(spark):
    texts = [(i, "g", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id bigint, grp string, content string").repartition(7)
    rows = sections.concat_group_text(df, ["grp"], 16).orderBy("segment").collect()
    assert len(rows) == 13 and {r.piece for r in rows} == {0}
    assert " ".join(r.content for r in rows) == " ".join(t for _, _, t in texts)
    rows = sections.concat_group_text(df, ["grp"], 16, 20).orderBy("segment", "piece").collect()
    assert " ".join(r.content for r in rows) == " ".join(t for _, _, t in texts)
    assert len(rows) > 26 and max(len(r.content) for r in rows) < 20 + 4 + 16


def test_group_text_of_rows_without_ids(spark):
    """They stay, in segments of a bounded number of texts, though all are equal."""
    df = spark.createDataFrame([(None, "g", "same")] * 500 + [(3, "g", "own")], "doc_id bigint, grp string, content string").repartition(3)
    rows = sections.concat_group_text(df, ["grp"], 16).collect()
    assert sum(r.content.split().count("same") for r in rows) == 500 and max(len(r.content.split()) for r in rows) <= 16
    assert [r.content for r in rows if r.segment >= 0] == ["own"]


# --- sentence boundaries ----------------------------------------------------------------------------


def test_abbreviations_are_learnt_from_the_corpus(docs):
    text = "Dr. Smith saw Mr. Jones and met Dr. Brown. The dog sat. A cat ran, e.g. Tom did. Then the dog ran and the cat sat by the dog as Brown did it too, as Brown did before, did again."
    found = sentences.abbreviations(docs(*[text] * 20))
    assert {"dr", "mr", "e.g"} <= set(found) and not {"dog", "sat", "brown", "the"} & set(found)


def test_sentences_respect_words_that_keep_their_stop(spark, docs):
    rows = docs(
        "Dr. Smith came. He sat!  Did J. R. Brown stay? Yes.",
        "On the 3. day it rained. It was day 3. Then we left.",
        "",
        "No end",
        "etc.",
        "(A. Nonym) said so. Fine.",
    )
    got = [r.s for r in rows.select("doc_id", sentences.split_sentences_by(F.col("content"), ["dr", "etc"]).alias("s")).orderBy("doc_id").collect()]
    assert got == [
        ["Dr. Smith came.", "He sat!", "Did J. R. Brown stay?", "Yes."],
        ["On the 3. day it rained.", "It was day 3.", "Then we left."],
        [""],
        ["No end"],
        ["etc."],
        ["(A. Nonym) said so.", "Fine."],
    ]
    plain = rows.select("doc_id", sentences.split_sentences_by(F.col("content"), []).alias("s")).orderBy("doc_id").first().s
    assert plain[0] == "Dr." and plain[-1] == "Yes."


def test_scores_equal_the_formula(docs):
    df = docs("a.b. c d. c d. e", "c d f. f g")
    rows = {r.word: r for r in sentences.abbreviation_scores(df).collect()}
    stops, n = 4, 11
    for word, (w, o) in {"a.b": (1, 0), "d": (2, 1), "f": (1, 1)}.items():
        letters, inner = len(word.replace(".", "")), word.count(".") + 1
        ratio = 2 * (w * (math.log(0.99) - math.log(stops / n)) + o * (math.log(0.01) - math.log(1 - stops / n)))
        assert (rows[word].with_stop, rows[word].without_stop) == (w, o)
        assert rows[word].score == pytest.approx(ratio * math.exp(-letters) * inner * letters**-o)
    assert set(rows) == {"a.b", "d", "f"}


def test_a_second_list_of_stop_words_comes_from_a_file(spark, docs, tmp_path):
    (tmp_path / "words.txt").write_text("the\nfifteen\n\ncry\n")
    words = read_stop_words(spark, str(tmp_path / "words.txt"))
    assert sorted(words) == ["cry", "fifteen", "the"]
    tokens = tx.remove_stopwords(tx.tokenize_alpha(F.col("content")), words)
    assert docs("The fifteen dogs cry with the cat").select(tokens.alias("t")).first().t == ["dogs", "with", "cat"]


def test_chunks_keep_abbreviations_inside(docs):
    df = docs("Dr. Smith came here. Then he left us. " * 3)
    plain = [r.content for r in sections.chunk_sentences(df, 20, 0, 1).collect()]
    kept = [r.content for r in sections.chunk_sentences(df, 20, 0, 1, abbreviations=["dr"]).collect()]
    assert any(c.endswith("Dr.") for c in plain) and all(c.endswith(("here.", "us.")) for c in kept) and len(kept) == 6
