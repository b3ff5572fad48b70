import json
import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from themeloom import schemas, session
from themeloom.operators import chart, responses, stats, themes
from themeloom.plans import theme_maps
from themeloom.sources import checks, manifest, readers, theme_files


def written(path):
    return json.loads("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))))


@pytest.fixture(scope="module")
def small(spark):
    rows = [("global", 1, 'sa"y', 0.25), ("global", 2, "böse", 0.0001), ("c10", 1, "x", 1.0), ("c2", 1, "y", 0.5)]
    return spark.createDataFrame(rows, schemas.THEMES)


def test_theme_json_round_trip(spark, small, tmp_path):
    theme_files.themes_export_json(small, str(tmp_path / "t"))
    data = written(tmp_path / "t")
    assert list(data) == ["global", "c2", "c10"]
    assert data["global"] == [['sa"y', 0.25], ["böse", 0.0001]]
    back = theme_files.themes_import_json(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.drop("position").collect())) == sorted(map(tuple, small.collect()))


def test_volume_json_forms(spark, tmp_path):
    rows = [("global", 5, 0.5, 1.0, 2.0, [5, 3], 0.1), ("c2", 3, 0.5, 1.0, None, [5, 3], 0.1)]
    df = spark.createDataFrame(rows, schemas.VOLUMES)
    theme_files.volumes_export_json(df, str(tmp_path / "v"))
    assert written(tmp_path / "v")["global"]["cluster_sizes"] == [5, 3]
    assert written(tmp_path / "v")["c2"]["davies_bouldin_score"] is None
    assert sorted(map(tuple, theme_files.volumes_import_json(spark, str(tmp_path / "v")).collect())) == sorted(rows)
    theme_files.volumes_export_json(df, str(tmp_path / "s"), scalar=True)
    assert written(tmp_path / "s") == {"global": 5, "c2": 3}
    assert theme_files.volumes_import_json(spark, str(tmp_path / "s")).where("grp = 'c2'").first().volume == 3


def test_theme_map_validation(spark, small):
    volumes = spark.createDataFrame([("global", 5.0), ("c2", float("nan"))], "grp string, volume double")
    found = {(r.grp, r.violation) for r in chart.validate_theme_map(small, volumes).collect()}
    assert found == {("c2", "no numeric volume"), ("c10", "no numeric volume")}
    with pytest.raises(ValueError):
        chart.check_theme_map(small.where("grp = 'global'"), volumes)
    only = chart.validate_theme_map(small.where("grp <> 'global'"), volumes).collect()
    assert ("global", "no global themes") in {(r.grp, r.violation) for r in only}


def test_largest_cluster_ties_and_names(spark):
    rows = [(0, 1), (1, 1), (2, 0), (3, 0), (4, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, cluster int")
    assert {r.grp: r.volume for r in themes.named_volumes(df).collect()} == {"global": 2, "c2": 2, "c5": 1}


def test_words_missing_in_a_category_score_zero(spark):
    cells = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 1.0)], "category string, term_id int, tfidf double")
    sizes = spark.createDataFrame([("a", 2), ("b", 4), ("c", 1)], "category string, n_docs bigint")
    words = spark.createDataFrame([(0, 1, 0, "love", 2.0), (0, 2, 1, "hope", 1.0)], "topic int, rank int, term_id int, word string, weight double")
    got = [tuple(r) for r in themes.category_themes_tfidf(cells, sizes, words).orderBy("category", "rank").collect()]
    assert got == [
        ("a", 1, "love", 0.5), ("a", 2, "hope", 0.0),
        ("b", 1, "hope", 0.25), ("b", 2, "love", 0.0),
        ("c", 1, "hope", 0.0), ("c", 2, "love", 0.0),
    ]


@pytest.mark.parametrize(
    "response, valid",
    [
        ('ok [["ab", 0.5], ["cd", 1]] end', True),
        ("[]", True),
        ('[["ab", "0.5"]]', False),
        ('[["ab", true]]', False),
        ('[["ab", 1.01]]', False),
        ('[["ab", -0.1]]', False),
        ('[["a", 0.5]]', False),
        ('[["a b", 0.5]]', False),
        ('[["a-b", 0.5]]', False),
        ('[["ab", 0.5, 1]]', False),
        ('[[3, 0.5]]', False),
        ('["ab", 0.5]', False),
        ('[["ab", 0.5], null]', False),
        ('{"ab": 0.5}', False),
        ('[["ab", 0.5]', False),
        ("", False),
        (None, False),
    ],
)
def test_response_rules(spark, response, valid):
    df = spark.createDataFrame([("g", "p", 1, response)], schemas.RESPONSES)
    assert responses.validate_responses(df).first().valid is valid


def test_first_valid_attempt_and_merge(spark):
    rows = [
        ("global", "p", 1, "bad"), ("global", "p", 2, '[["Love", 0.5]]'), ("global", "p", 3, '[["hate", 0.9]]'),
        ("global", "q", 1, '[["love", 0.75]]'), ("x", "p", 11, '[["late", 0.5]]'), ("x", "p", 1, "bad"),
    ]
    df = spark.createDataFrame(rows, schemas.RESPONSES)
    first = responses.first_valid_attempt(responses.validate_responses(df))
    chosen = {(r.grp, r.perspective): (r.attempt, len(r.themes)) for r in first.collect()}
    assert chosen == {("global", "p"): (2, 1), ("global", "q"): (1, 1), ("x", "p"): (None, 0)}
    assert [tuple(r) for r in responses.merge_perspectives(first).collect()] == [("global", 1, "love", 0.75)]


def test_required_columns_and_rows(spark, docs):
    with pytest.raises(ValueError, match="category"):
        checks.require_columns(docs("a"), ["category", "content"])
    with pytest.raises(ValueError):
        checks.require_nonempty(docs("a").where("false"))


def test_manifest_keeps_what_could_not_be_read(spark):
    old = spark.createDataFrame([("a", "h1", None), ("b", "h2", None)], schemas.MANIFEST)
    texts = spark.createDataFrame([("a", None), ("b", "new"), ("c", "first")], schemas.RAW_TEXT)
    changed = manifest.refresh_changed(texts, old)
    assert {r.source for r in changed.collect()} == {"b", "c"}
    merged = {r.source: r.content_hash for r in manifest.manifest_upsert(old, changed).collect()}
    assert merged["a"] == "h1" and merged["b"] != "h2" and set(merged) == {"a", "b", "c"}
    cached = spark.createDataFrame([("a", "kept"), ("b", "old")], schemas.RAW_TEXT)
    assert {r.source: r.text for r in manifest.current_texts(cached, changed).collect()} == {"a": "kept", "b": "new", "c": "first"}


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "d.csv").write_text('category,headline,content\nx,h,"a ""b""\nc, d"\ny,,\n')
    rows = readers.scan_csv(spark, str(tmp_path), schemas.CATEGORY_DOCUMENTS).collect()
    assert [(r.category, r.content) for r in rows] == [("x", 'a "b"\nc, d'), ("y", None)]


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("filename\tcontent\ttitle\n1.txt\tsome \"text\" here\tx\n")
    content = schemas.RAW_TEXT.__class__([schemas.DOCUMENTS["content"]])
    assert [tuple(r) for r in readers.scan_tsv(spark, str(tmp_path), content).collect()] == [('some "text" here',)]
    with pytest.raises(ValueError, match="category"):
        readers.scan_tsv(spark, str(tmp_path), schemas.CATEGORY_DOCUMENTS)


def test_whole_text_sources(spark, tmp_path):
    (tmp_path / "my.book.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.scan_wholetext(spark, str(tmp_path)).collect()] == [("my.book", "one\ntwo")]


def fake_session(settings, master):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-1", master=master))


def test_staging_follows_the_session(spark):
    named = {"spark.checkpoint.dir": "/shared/folder/"}
    assert session.staging_root(fake_session(named, "yarn")).startswith("/shared/folder/themeloom/app-1")
    with pytest.raises(ValueError):
        session.staging_root(fake_session({}, "yarn"))
    assert Path(session.staging_root(fake_session({}, "local[2]"))).is_dir()
    staged = session.stage(spark.range(3).toDF("a"), "x")
    assert staged.count() == 3 and session.staging_root(spark) in staged.inputFiles()[0]


# --- complete maps ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stories(spark):
    """Three vocabularies, mixed a little; the first is the most frequent."""
    words = {
        "sport": "match team goal player coach league season score".split(),
        "money": "bank market share profit price trade growth bond".split(),
        "music": "song band album chart singer guitar concert tour".split(),
    }
    rows = []
    for i in range(60):
        kind = ("sport", "sport", "money", "music")[i % 4]
        pool = words[kind]
        rng = random.Random(i)  # documents of one kind differ, so that kinds and not copies are the clusters
        text = " ".join(rng.choices(pool, k=40)) + f" the report{i % 3}."
        rows.append((i, kind, f"headline {i}", text))
    return spark.createDataFrame(rows, "doc_id bigint, category string, headline string, content string")


def test_news_map_has_the_expected_shape(stories):
    result = theme_maps.news_theme_map(stories.select("doc_id", "content"), max_clusters=10, n_topics=3, max_iter=50)
    volumes = {r.grp: r.volume for r in result.volumes.collect()}
    assert volumes["global"] == max(volumes.values()) == 30 and sum(volumes.values()) == 60 and len(volumes) == 3
    for grp in volumes:
        rows = result.themes.where(F.col("grp") == grp).orderBy("rank").collect()
        scores = [r.score for r in rows]
        assert scores == sorted(scores, reverse=True) and [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert all(len(set(scores[i : i + 5])) == 1 for i in range(0, len(scores), 5))
    chart.check_theme_map(result.themes, result.volumes)
    labels = {r.doc_id: r.cluster for r in result.labels.collect()}
    assert len({labels[i] for i in range(60) if i % 4 in (0, 1)}) == 1


def test_category_map(stories):
    result = theme_maps.category_theme_map(stories, n_topics=3, max_iter=20)
    volumes = {r.grp: r for r in result.volumes.collect()}
    assert set(volumes) == {"global", "sport", "money", "music"}
    assert volumes["global"].volume == sum(v.volume for g, v in volumes.items() if g != "global")
    assert volumes["global"].cluster_sizes == [volumes[g].volume for g in ("sport", "money", "music")]
    assert volumes["music"].cluster_sizes is None
    plain = theme_maps.category_theme_map(stories, n_topics=3, max_iter=5, stop_words=["song", "the"])
    assert plain.themes.where("word = 'song'").isEmpty() and not result.themes.where("word = 'song'").isEmpty()
    best = result.themes.where("grp = 'music' and rank = 1").first().word
    assert best in "song band album chart singer guitar concert tour".split()


def test_chunk_map_exports_for_the_page(spark, stories, tmp_path):
    whole = stories.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "content"))), lambda s: s["content"]), " ").alias("content"))
    book = whole.select(F.lit(0).cast("bigint").alias("doc_id"), "content")
    result = theme_maps.chunk_theme_map(book, n_clusters=4, chunk_size=150, overlap=20, min_chunk_size=50, n_topics=3, max_iter=20)
    result.export_json(str(tmp_path))
    data, sizes = written(tmp_path / "themes.json"), written(tmp_path / "volumes.json")
    assert "global" in data and set(data) <= set(sizes)
    assert sum(sizes["global"]["cluster_sizes"]) == sum(v["volume"] for v in sizes.values()) == result.labelled_sections().count()
    result.write(str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/themes")).count() == result.themes.count()


def test_verse_maps(docs):
    topics = ["light darkness heaven earth", "king throne battle sword", "harvest seed field grain"]
    lines = ["GENESIS"] + [f"{c}:{v} {topics[c % 3]} word{v % 2}" for c in range(1, 13) for v in range(1, 21)]
    text = "intro\n" + "\n".join(lines)
    flat = theme_maps.verse_theme_map(docs(text), "GENESIS", n_clusters=3, n_topics=3, max_iter=20)
    assert sum(r.volume for r in flat.volumes.collect()) == 24
    tree = theme_maps.verse_hierarchy_map(docs(text), "GENESIS", max_clusters=5, n_topics=3, max_iter=20)
    assert sum(r.volume for r in tree.volumes.collect()) == 24
    assert tree.volumes.count() == 3


def test_responses_map_and_prompts(stories):
    prompts = theme_maps.category_prompts(stories, span=16)
    assert prompts.where("grp = 'global'").count() == 4 * 4
    answers = prompts.withColumns({"attempt": F.lit(1), "response": F.lit('[["Grace", 0.5]]')}).drop("prompt")
    result = theme_maps.response_theme_map(checks.prepare_documents(stories), answers)
    assert {(r.grp, r.word) for r in result.themes.collect()} == {(g, "grace") for g in ("global", "sport", "money", "music")}


def test_sections_of_a_news_map_have_titles(spark, docs):
    result = theme_maps.news_theme_map(docs(*[f"river boat water {'stone' if i % 2 else 'sail'} w{i % 5}" for i in range(12)]), max_clusters=4, n_topics=3)
    rows = result.labelled_sections().collect()
    assert len(rows) == 12 and {r.title for r in rows} == {f"Document {i}" for i in range(12)}
    assert result.document_themes.count() == 12


def test_parts_beyond_the_range_of_an_int(spark, docs):
    text = "The Old Testament\n" + "\n".join(f"BOOK OF P{i}\n1:1 in the beginning" for i in range(2300))
    found = theme_maps.scripture_sections(docs(text), "BOOK OF [A-Z0-9]+")
    assert found.count() == found.select("position").distinct().count() > 2200


def test_a_category_named_like_the_whole_is_refused(spark):
    bad = spark.createDataFrame([(1, "global", "h", "some words")], "doc_id long, category string, headline string, content string")
    with pytest.raises(ValueError, match="global"):
        theme_maps.category_theme_map(bad)


def test_broken_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("doc_id\tcategory\theadline\tcontent\n1\ta\tb\tfine\nx\ta\tb\tbad id\n3\ta\tb\ttoo\tmany\n4\ta\n")
    checked = readers.scan_checked(spark, str(tmp_path), schemas.DOCUMENTS, "\t")
    assert sorted((r.reject_reason or "", r.content or "") for r in checked.collect()) == [
        ("", ""), ("", "fine"), ("too many fields", "too"), ("value of another type", "bad id"),
    ]
    assert {r.doc_id for r in readers.scan_tsv(spark, str(tmp_path)).collect()} == {1, 4}


def test_sources_of_equal_names_stay_apart(spark, tmp_path):
    for folder in ("a b", "c+d"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my book.v1.txt").write_text(folder)
    got = {r.source: r.text for r in readers.scan_wholetext(spark, str(tmp_path)).collect()}
    assert got == {"a b/my book.v1": "a b", "c+d/my book.v1": "c+d"}


def test_a_source_changed_twice_is_one_row(spark):
    old = spark.createDataFrame([("s", "h0", None), ("t", "h", None)], "source string, content_hash string, last_updated timestamp")
    new = spark.createDataFrame([("s", "h1"), ("s", "h2"), ("u", "h3")], "source string, content_hash string")
    rows = manifest.manifest_upsert(old, new).collect()
    assert sorted((r.source, r.content_hash) for r in rows) == [("s", "h2"), ("t", "h"), ("u", "h3")]


def test_category_records_hold_all_sizes_on_every_row(spark):
    rows = [(3, "money", 5), (1, "sport", 2), (2, "money", 4), (4, None, 1)]
    records = stats.category_volume_records(spark.createDataFrame(rows, "doc_id bigint, category string, word_count int"))
    assert {r.grp: (r.volume, r.cluster_sizes) for r in records.collect()} == {
        "global": (12, [2, 9, 1]), "sport": (2, [2, 9, 1]), "money": (9, [2, 9, 1]), None: (1, [2, 9, 1])
    }
