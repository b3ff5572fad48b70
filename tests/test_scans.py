"""Scans by header, by byte ranges and by lines."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from themeloom import schemas
from themeloom.functions.text import split_sentences, trim_boilerplate
from themeloom.operators import lines, sections
from themeloom.sources import ranges, readers


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that small files are cut."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


def quoted(value):
    return "" if value is None else '"' + value.replace('"', '""') + '"'


def csv_text(rows, names=("doc_id", "category", "headline", "content"), end="\n"):
    out = [",".join(names)]
    out += [",".join(quoted(row[n]) if n != "doc_id" else str(row[n]) for n in names) for row in rows]
    return end.join(out) + end


def random_rows(n, seed):
    rng = random.Random(seed)
    parts = ['say ""', "a,b", "line\nfeed", '"', "\r\ninside", "plain words", "é ü", "\n\n", " lead", "x" * 200]
    return [
        {"doc_id": i, "category": f"c{i % 3}", "headline": rng.choice(["", "h", 'q"q', "two\nlines"]) or None,
         "content": " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))}
        for i in range(n)
    ]


def found(df):
    return sorted(((r.doc_id, r.category, r.headline, r.content) for r in df.collect()), key=lambda r: (r[0], repr(r)))


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_quoted_files_equal_the_unsplit_read(spark, tmp_path, small_ranges, size, end):
    rows = random_rows(120, 1)
    (tmp_path / "a.csv").write_bytes(csv_text(rows, end=end).encode())
    (tmp_path / "b.csv").write_bytes(csv_text(random_rows(2, 2), ("content", "headline", "category", "doc_id"), end).encode())
    small_ranges(1 << 20)
    whole = found(readers.scan_csv(spark, str(tmp_path)))
    assert len(whole) == 122
    small_ranges(size)
    cut = readers.scan_csv(spark, str(tmp_path))
    assert found(cut) == whole
    if end == "\n":
        assert [r[3] for r in whole if r[0] > 1] == [r["content"] for r in rows if r["doc_id"] > 1]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text(csv_text(random_rows(300, 3)))
    small_ranges(2000)
    assert ranges.file_lines(spark, str(tmp_path)).select("block").distinct().count() > 10


def test_headers_of_different_order(spark, tmp_path):
    orders = (("category", "headline", "content"), ("content", "headline", "category"), ("extra", "content", "category", "headline"))
    for k, names in enumerate(orders):
        values = {"category": f"c{k}", "headline": f"h{k}", "content": f"text {k}", "extra": "7"}
        (tmp_path / f"{k}.csv").write_text("\t".join(names) + "\n" + "\t".join(values[n] for n in names) + "\nc\th\tt\tx\ty\n")
    scanned = readers.scan_checked(spark, str(tmp_path), schemas.CATEGORY_DOCUMENTS, "\t")
    good = sorted((r.category, r.headline, r.content) for r in readers.accepted(scanned).collect())
    assert good == [(f"c{k}", f"h{k}", f"text {k}") for k in range(3)]
    assert [r.reject_reason for r in scanned.where("reject_reason IS NOT NULL").collect()] == ["too many fields"] * 3
    (tmp_path / "9.csv").write_text("category\tother\na\tb\n")
    with pytest.raises(ValueError, match="missing columns: headline, content"):
        readers.scan_checked(spark, str(tmp_path), schemas.CATEGORY_DOCUMENTS, "\t")


BOOK = "preface\n*** START OF THE PROJECT GUTENBERG x\nnone yet\n" + "".join(
    f"  BOOK OF {k} \n" + "".join(f"{k}:{i} words of line {i}\n" for i in range(k)) for k in range(40)
) + "rest *** END OF THE PROJECT GUTENBERG x\nafter\n"


@pytest.mark.parametrize("size", [100, 1500, 1 << 20])
def test_lines_and_parts_of_books_over_byte_ranges(spark, tmp_path, small_ranges, size):
    """Lines, trim and headed parts of a cut file equal those of the whole text in one row."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text(BOOK)
    (tmp_path / "b.txt").write_bytes(b"one\r\n\r\nBOOK OF X\r\nlast without end")
    small_ranges(size)
    scanned = readers.scan_lines(spark, str(tmp_path))
    texts = {"sub/a": BOOK.removesuffix("\n").split("\n"), "b": ["one", "", "BOOK OF X", "last without end"]}
    got = sorted((r.source, r.line, r.text) for r in scanned.collect())
    assert got == sorted((s, i, t) for s, own in texts.items() for i, t in enumerate(own, 1))

    whole = spark.createDataFrame([(s, "\n".join(t)) for s, t in texts.items()], "doc_id string, content string")
    trimmed = whole.select("doc_id", trim_boilerplate(F.col("content")).alias("content"))
    kept = lines.trim_lines(scanned)
    joined = {}
    for r in kept.orderBy("source", "line").collect():
        joined.setdefault(r.source, []).append(r.text)
    assert {s: "\n".join(t) for s, t in joined.items()} == {r.doc_id: r.content for r in trimmed.collect()}

    parts = {}
    for run in (7, 50_000):
        parts = {}
        for r in lines.headed_lines(kept, "BOOK OF [A-Z0-9]+", run).orderBy("line").collect():
            parts.setdefault((r.source, r.part, r.heading), []).append(r.text)
        want = {(r.doc_id, r.part, r.heading): r.body for r in sections.split_headings(trimmed, "BOOK OF [A-Z0-9]+").collect()}
        assert {k: "\n".join(t).strip() for k, t in parts.items() if "\n".join(t).strip()} == want
    sizes = {(r.source, r.part): (r.lines, r.chars) for r in lines.part_sizes(lines.headed_lines(kept, "BOOK OF [A-Z0-9]+")).collect()}
    assert sizes == {k[:2]: (len(t), len("\n".join(t))) for k, t in parts.items()}


@pytest.mark.parametrize("text", ["x\n*** START OF THE PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG\n*** START OF THE PROJECT GUTENBERG\nbody", "", "plain"])
def test_trim_of_odd_books(spark, text):
    scanned = spark.createDataFrame([("s", i, t) for i, t in enumerate(text.split("\n"), 1)], "source string, line bigint, text string")
    want = spark.createDataFrame([(text,)], "t string").select(trim_boilerplate(F.col("t")).alias("t")).first().t
    assert "\n".join(r.text for r in lines.trim_lines(scanned).orderBy("line").collect()) == want


def test_empty_folder_of_lines(spark, tmp_path):
    Path(tmp_path / "empty.txt").write_text("")
    assert readers.scan_lines(spark, str(tmp_path)).collect() == []


def book_of_sentences(seed, n):
    rng = random.Random(seed)
    words = [["a", "bb", "ccc", "dddd."][rng.randrange(4)] for _ in range(n)]
    for _ in range(n // 15):
        words[rng.randrange(n)] = rng.choice(["end!", "why?", "x" * 90 + ".", "\n", "\n\n", "  "])
    return " ".join(words)


@pytest.mark.parametrize("limits", [(60, 12, 10), (200, 60, 30), (30, 0, 1), (25, 40, 5)])
def test_sentences_and_chunks_of_lines_equal_those_of_whole_texts(spark, limits):
    """For any size of blocks and runs, with sentences longer than a block."""
    texts = {f"s{k}": book_of_sentences(k, n) for k, n in enumerate((1, 7, 300, 1500))} | {"empty": " \n "}
    scanned = spark.createDataFrame([(s, i, t) for s, own in texts.items() for i, t in enumerate(own.split("\n"), 1)], "source string, line bigint, text string")
    whole = spark.createDataFrame(list(texts.items()), "doc_id string, content string")
    want = {}
    for r in sections.chunk_sentences(whole, *limits).orderBy("doc_id", "position").collect():
        want.setdefault(r.doc_id, []).append(r.content)
    plain = {r.doc_id: r.s for r in whole.select("doc_id", split_sentences(F.col("content")).alias("s")).collect() if r.s != [""]}
    for block_chars, run in ((1, 3), (500, 40), (1 << 20, 50_000)):
        cut = lines.line_sentences(scanned, run)
        got = {}
        for r in cut.orderBy("source", "sentence").collect():
            got.setdefault(r.source, []).append(r.text)
        assert got == plain
        chunks = {}
        for r in lines.chunk_lines(cut, *limits, block_chars=block_chars, run=run).orderBy("source", "first", "end").collect():
            chunks.setdefault(r.source, []).append(r.content)
        assert chunks == {s: c for s, c in want.items() if c != [""]}


def test_chunks_of_lines_cut_the_sentences_once(spark):
    scanned = spark.createDataFrame([("s", i, "One two. Three four! Five") for i in range(1, 9)], "source string, line bigint, text string")
    found = lines.chunk_lines(lines.line_sentences(scanned), 40, 10, 5)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 1
