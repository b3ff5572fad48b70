"""Explicit schemas of the tables that are read from or written to files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


DOCUMENTS = _struct(
    ("doc_id", T.LongType()),
    ("category", T.StringType()),
    ("headline", T.StringType()),
    ("content", T.StringType()),
)
CATEGORY_DOCUMENTS = _struct(
    ("category", T.StringType()), ("headline", T.StringType()), ("content", T.StringType())
)
RAW_TEXT = _struct(("source", T.StringType()), ("text", T.StringType()))
MANIFEST = _struct(
    ("source", T.StringType()), ("content_hash", T.StringType()), ("last_updated", T.TimestampType())
)
THEMES = _struct(
    ("grp", T.StringType()), ("rank", T.IntegerType()), ("word", T.StringType()), ("score", T.DoubleType())
)
VOLUMES = _struct(
    ("grp", T.StringType()),
    ("volume", T.LongType()),
    ("silhouette_score", T.DoubleType()),
    ("calinski_harabasz_score", T.DoubleType()),
    ("davies_bouldin_score", T.DoubleType()),
    ("cluster_sizes", T.ArrayType(T.LongType())),
    ("cluster_density", T.DoubleType()),
)
RESPONSES = _struct(
    ("grp", T.StringType()),
    ("perspective", T.StringType()),
    ("attempt", T.IntegerType()),
    ("response", T.StringType()),
)
GLOBAL_SUMMARY = _struct(("word", T.StringType()), ("frequency", T.LongType()))
CLUSTER_SUMMARY = _struct(
    ("cluster", T.StringType()), ("word", T.StringType()), ("frequency", T.LongType())
)
