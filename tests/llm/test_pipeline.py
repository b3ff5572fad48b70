"""The pipeline's stages, each against a plain version on what the stage before kept."""

import hashlib

import public_tokenizers
import tiktoken
from test_dedup import plain_fingerprint, roots
from test_text_ops import plain_contamination, plain_spans

import corpus_pipeline
from themeloom.llm import bpe, quality
from themeloom.llm.common import table
from themeloom.session import stage


def test_every_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    predicted = {r.id: r.predicted for r in quality.score_quality(docs, table(spark, sf_dir, "labels")).collect()}
    for name, function in corpus_pipeline.STAGES:
        before = dict(kept)
        docs = stage(function(spark, docs, sf_dir), name)
        if name == "byte_bpe":
            break
        assert docs.columns == columns
        rows = docs.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(kept)
        if name == "quality":
            assert set(kept) == {k for k in before if predicted[k]}
        elif name == "simhash":
            prints = {k: plain_fingerprint(t) for k, t in before.items()}
            ids = sorted(prints)
            links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
            assert kept == {k: before[k] for k, root in roots(ids, links).items() if k == root}
        elif name == "decontamination":
            items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            judged = plain_contamination(before.items(), items)
            assert kept == {k: t for k, t in before.items() if not judged[k][4]}
        elif name == "pii":
            assert set(kept) == set(before)
            assert all(not plain_spans(t) for t in kept.values())
            assert all(kept[k] == t for k, t in before.items() if not any(c in "@0123456789" for c in t))
            assert all(r.n_chars == len(r.text) for r in rows)
    encoding = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    for r in docs.collect():
        ids = encoding.encode_ordinary(kept.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert not kept


def test_stages_take_empty_tables_and_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-1, "", "en", None, 0)], docs.schema)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), sf_dir).collect() == []
        function(spark, docs.limit(5).unionByName(odd), sf_dir).collect()


def test_run_is_the_registered_query(spark, sf_dir):
    import __spark_entry__ as entry_points

    assert entry_points.queries()["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_tokens_are_the_same_in_smaller_slices(spark):
    docs = spark.createDataFrame([(i, f"word{i} again  and again\n {i * 7919}") for i in range(40)] + [(None, None)], "doc_id bigint, text string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(bpe.token_digests(docs, 64, 3)) == key(bpe.token_digests(docs))
