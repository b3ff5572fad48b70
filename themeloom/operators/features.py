"""Tokens to vocabulary, TF-IDF vectors and embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from themeloom.functions.text import term_counts, tokenize_words
from themeloom.operators.ranking import at_least_top, top_rows
from themeloom.session import stage

MAX_VOCABULARY = 500_000


def document_terms(docs: DataFrame) -> DataFrame:
    """``<doc_id, term, tf>`` from ``<doc_id, tokens>``; counted inside each row, no shuffle."""
    return docs.select("doc_id", F.inline(term_counts(F.col("tokens"))))


term_frequency = document_terms


def document_frequency(docs: DataFrame) -> DataFrame:
    """``<term, df>``: documents that hold the term. One shuffle of map-side counts."""
    terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def adaptive_bounds(n_docs: int) -> tuple[int, float]:
    """``(min_df, max_df)`` by corpus size."""
    if n_docs < 100:
        return 1, 0.95
    return (2, 0.9) if n_docs < 1000 else (3, 0.85)


def adaptive_bounds_table(docs: DataFrame) -> DataFrame:
    """The same rule as one row ``<n, min_df, max_df>``."""
    n = F.col("n")
    return docs.agg(F.count("*").alias("n")).select(
        "n",
        F.when(n < 100, 1).when(n < 1000, 2).otherwise(3).alias("min_df"),
        F.when(n < 100, 0.95).when(n < 1000, 0.9).otherwise(0.85).alias("max_df"),
    )


def vocabulary(
    docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int = 20_000
) -> DataFrame:
    """``<term_id, term, df, tf, idf>``: terms within the bounds, capped by total count, ids by name.

    Equal counts are broken by the term. ``max_features`` rows at most leave the sort, so numbering
    them in one partition is bounded.
    """
    if not 0 < max_features <= MAX_VOCABULARY:
        raise ValueError(f"max_features must be between 1 and {MAX_VOCABULARY}")
    # Every document adds one row without a term, so the one pass over the corpus counts the documents too.
    # The counts are staged: the bounds need the document count before they can be applied.
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("tf")))
    cells = docs.select(F.inline(F.concat(marker, term_counts(F.coalesce("tokens", F.array().cast("array<string>"))))))
    counted = stage(cells.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "term-counts")
    documents = counted.where("term is null").first()
    n_docs = F.lit(documents.df if documents else 0)
    kept = counted.where(
        F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)
    )
    return top_rows(at_least_top(kept, "tf", max_features), [F.desc("tf"), "term"], max_features).select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "term",
        "df",
        "tf",
        (F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1).alias("idf"),
    )


def count_vocabulary(docs: DataFrame, max_features: int = 1000) -> DataFrame:
    """``<term_id, term, df, tf>``: the most frequent terms, without frequency bounds."""
    return vocabulary(docs, max_features=max_features).drop("idf")


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: at most ``MAX_VOCABULARY`` terms, so it lives on the driver."""

    terms: tuple[str, ...]
    df: tuple[int, ...]
    tf: tuple[int, ...]
    idf: tuple[float, ...]

    def __len__(self) -> int:
        return len(self.terms)

    @staticmethod
    def collect(table: DataFrame) -> Vocabulary:
        rows = table.select("term_id", "term", "df", "tf", "idf").toPandas().sort_values("term_id")
        if rows.empty:
            raise ValueError("no term is within the frequency bounds")
        return Vocabulary(tuple(rows.term), tuple(rows.df), tuple(rows.tf), tuple(rows.idf))

    @staticmethod
    def fit(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int = 20_000) -> Vocabulary:
        return Vocabulary.collect(vocabulary(docs, min_df, max_df, max_features))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self)), self.terms, map(int, self.df), map(int, self.tf), map(float, self.idf)))
        return spark.createDataFrame(rows, "term_id int, term string, df bigint, tf bigint, idf double")


def tfidf_vectors(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Replace ``tokens`` by ``<indices, counts, values>``: L2-normalised TF-IDF over ``vocab``.

    Counting, weighting and scaling are feature transformers with a broadcast vocabulary of checked size:
    one narrow pass in the JVM, whatever the corpus size. A document without a vocabulary term
    keeps its row with empty arrays.
    """
    count = CountVectorizerModel.from_vocabulary(list(vocab.terms), inputCol="tokens", outputCol="_tf")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([float(v) for v in vocab.idf]), inputCol="_tf", outputCol="_weighted"
    )
    scale = Normalizer(p=2.0, inputCol="_weighted", outputCol="_tfidf")
    out = scale.transform(weigh.transform(count.transform(docs)))
    tf, tfidf = F.unwrap_udt("_tf"), F.unwrap_udt("_tfidf")
    return out.select(
        *[c for c in docs.columns if c != "tokens"],
        tfidf["indices"].alias("indices"),
        tf["values"].alias("counts"),
        tfidf["values"].alias("values"),
    )


def tfidf_rows(vectors: DataFrame) -> DataFrame:
    """Long form ``<..., term_id, tf, tfidf>`` of :func:`tfidf_vectors`; narrow."""
    rest = [c for c in vectors.columns if c not in ("indices", "counts", "values")]
    cells = F.explode(F.arrays_zip("indices", "counts", "values")).alias("cell")
    return vectors.select(*rest, cells).select(
        *rest,
        F.col("cell.indices").alias("term_id"),
        F.col("cell.counts").cast("bigint").alias("tf"),
        F.col("cell.values").alias("tfidf"),
    )


def tfidf(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int = 20_000) -> DataFrame:
    """Fit the vocabulary and return the long TF-IDF table of the same documents; their tokens are staged, as both read them."""
    docs = stage(docs, "tokens")
    return tfidf_rows(tfidf_vectors(docs, Vocabulary.fit(docs, min_df, max_df, max_features)))


TokenModel = Callable[[np.ndarray, np.ndarray], np.ndarray]
MAX_TOKENS = 512


def hashed_token_model(dim: int = 64, seed: int = 42) -> Callable[[], TokenModel]:
    """Factory of the default embedding model: a pseudo-random normal vector for each token id, without weights to load.

    Like any model it takes token ids and a mask, both (rows, places), and gives vectors (rows, places, dim).
    """

    def make() -> TokenModel:
        def mixed(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        def encode(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            distinct, at = np.unique(ids[mask], return_inverse=True)
            place = np.arange(1, 2 * dim + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)
            bits = mixed(mixed(distinct.astype(np.int64).view(np.uint64))[:, None] + place * np.uint64(0x9E3779B97F4A7C15))
            uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            normal = np.sqrt(-2 * np.log(uniform[:, :dim])) * np.cos(2 * np.pi * uniform[:, dim:])
            out = np.zeros((*ids.shape, dim), np.float32)
            out[mask] = normal.astype(np.float32)[at]
            return out

        return encode

    return make


def token_ids(content: Column) -> Column:
    """Hashes of the word tokens of a text, in order."""
    return F.transform(tokenize_words(content), lambda token: F.xxhash64(token))


def _windows(sizes: np.ndarray, max_tokens: int, truncate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token and number of tokens of every window; a row without tokens has none."""
    if truncate:
        sizes = np.minimum(sizes, max_tokens)
    count = -(-sizes // max_tokens)
    row = np.repeat(np.arange(len(sizes)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * max_tokens
    return row, first, np.minimum(sizes[row] - first, max_tokens)


def _encoded(ids: pa.Array, encode: TokenModel, batch_size: int, max_tokens: int, truncate: bool) -> Iterator[tuple]:
    """``(windows, their rows, vectors, mask)`` of batches of padded windows of like length."""
    sizes = np.asarray(ids.value_lengths(), np.int64)
    flat, starts = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    row, first, n = _windows(sizes, max_tokens, truncate)
    by = np.argsort(n, kind="stable")
    for at in range(0, len(by), batch_size):
        chosen = by[at : at + batch_size]
        mask = np.arange(n[chosen].max()) < n[chosen][:, None]
        padded = np.zeros(mask.shape, np.int64)
        place = (starts[row[chosen]] + first[chosen])[:, None] + np.arange(mask.shape[1])
        padded[mask] = flat[place[mask]]
        yield chosen, row[chosen], encode(padded, mask), mask


def embed_documents(
    docs: DataFrame,
    model: Callable[[], TokenModel] | None = None,
    batch_size: int = 32,
    max_tokens: int = MAX_TOKENS,
    truncate: bool = False,
) -> DataFrame:
    """Add ``embedding``: the mean of the vectors that a model gives the tokens of ``content``.

    A text is cut into windows of ``max_tokens``, as models have a longest input; with ``truncate`` only the first one is read. Windows of
    like length make a padded batch with a mask, and what is padded does not count: the result is that of :func:`masked_mean_pool` over
    :func:`token_vectors`, for any batch size. The model is made once per task; the pass is narrow. A text without tokens gets zeros.
    """
    make = model or hashed_token_model()

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for ids in batches:
            sums, counts = [], []
            for windows, rows, vectors, mask in _encoded(ids, encode, batch_size, max_tokens, truncate):
                sums.append((windows, rows, (vectors * mask[:, :, None]).sum(axis=1, dtype=np.float64), mask.sum(axis=1)))
            dim = sums[0][2].shape[1] if sums else encode(np.zeros((1, 1), np.int64), np.ones((1, 1), bool)).shape[2]
            total, tokens = np.zeros((len(ids), dim)), np.zeros(len(ids), np.int64)
            if sums:
                windows, rows, vectors, n = (np.concatenate(part) for part in zip(*sums))
                by = np.argsort(windows)  # windows of a text are added in their order, however they were batched
                np.add.at(total, rows[by], vectors[by])
                np.add.at(tokens, rows, n)
            mean = (total / np.maximum(tokens, 1)[:, None]).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(mean.ravel()))

    ids = F.coalesce(token_ids(F.col("content")), F.array().cast("array<bigint>"))
    return docs.withColumn("embedding", embed(ids))


def token_vectors(
    docs: DataFrame,
    model: Callable[[], TokenModel] | None = None,
    batch_size: int = 32,
    max_tokens: int = MAX_TOKENS,
    truncate: bool = False,
    key: str = "doc_id",
) -> DataFrame:
    """``<key, vector, mask>``: the model's vectors one by one, those of padding with mask 0, as :func:`masked_mean_pool` takes them."""
    make = model or hashed_token_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            for _, rows, vectors, mask in _encoded(batch.column("ids"), encode, batch_size, max_tokens, truncate):
                dim = vectors.shape[2]
                keys = batch.column(key).take(pa.array(np.repeat(rows, mask.shape[1])))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(mask.size + 1) * dim, pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array(mask.ravel().astype(np.int32))], [key, "vector", "mask"])

    ids = F.coalesce(token_ids(F.col("content")), F.array().cast("array<bigint>")).alias("ids")
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, ids).mapInArrow(run, f"{key} {kind}, vector array<float>, mask int")


def embed_texts(docs: DataFrame, model: Callable, batch_size: int = 32) -> DataFrame:
    """Add ``embedding`` by a model that takes whole texts and does its own tokens and windows; it loads once per worker."""
    embed = predict_batch_udf(model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return docs.withColumn("embedding", embed(F.col("content")))


def masked_mean_pool(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key, embedding>``: mean of the token vectors weighted by the attention mask.

    Input ``<key, vector, mask>``, one row per token; rows are combined map-side.
    """
    pooled = (
        tokens.where("mask > 0")
        .groupBy(key)
        .agg(Summarizer.mean(array_to_vector("vector"), F.col("mask").cast("double")).alias("mean"))
    )
    return pooled.select(key, vector_to_array("mean").alias("embedding"))


def abs_embedding(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.abs(x))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, words, categories and mean words of ``<category, word_count>``."""
    return docs.agg(
        F.count("*").alias("documents"),
        F.sum("word_count").cast("bigint").alias("total_words"),
        F.count_distinct("category").alias("categories"),
        F.avg("word_count").alias("avg_words"),
    )


def clamp_topics(n_rows: int, n_topics: int = 20) -> int:
    """Topics for a small corpus: fewer than its rows, at least one."""
    return max(1, min(n_topics, n_rows - 1))


def clamp_clusters(n_rows: int, n_clusters: int) -> int:
    """Clusters for a small corpus: at most a third of its rows, but three remain allowed."""
    return min(n_clusters, max(3, math.floor(n_rows / 3)))


def clamp_params(docs: DataFrame, n_clusters: int = 17, n_topics: int = 20) -> DataFrame:
    """Both clamps as one row ``<n, topics, clusters>``."""
    n = F.col("n")
    return docs.agg(F.count("*").alias("n")).select(
        "n",
        F.greatest(F.lit(1), F.least(F.lit(n_topics), n - 1)).cast("int").alias("topics"),
        F.least(F.lit(n_clusters), F.greatest(F.lit(3), F.floor(n / 3))).cast("int").alias("clusters"),
    )
