"""Scans of text corpora and summary files, all with explicit schemas."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from themeloom import schemas
from themeloom.operators.ranking import bounded
from themeloom.session import stage
from themeloom.sources import ranges
from themeloom.sources.checks import split_rejects

MAX_HEADERS = 1000


def _names(header: str, sep: str) -> list[str]:
    return next(csv.reader([header], delimiter=sep))


def _headers(spark: SparkSession, path: str, sep: str) -> dict[tuple[str, ...], list[str] | None]:
    """The files of each header under ``path``; ``None`` instead of all files where there is one header only."""
    first = stage(ranges.first_lines(ranges.file_lines(spark, path)), "headers")
    headers = [r.header for r in bounded(first.select("header").distinct(), MAX_HEADERS, "headers").collect()]
    if len(headers) == 1:
        return {tuple(_names(headers[0], sep)): None}
    files = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    return {tuple(_names(r.header, sep)): r.files for r in files}


def _checked(found: DataFrame, header: Sequence[str], schema: T.StructType, sep: str) -> DataFrame:
    """The columns of ``schema`` out of text columns ``_0, _1, ...`` in the order of a header, the last one for what is too many."""
    place = {name: f"_{i}" for i, name in reversed(list(enumerate(header)))}
    text = {f.name: F.col(place[f.name]) for f in schema.fields}
    bad_value = [text[f.name].isNotNull() & text[f.name].try_cast(f.dataType).isNull() for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    rules = {"too many fields": F.col(f"_{len(header)}").isNotNull()}
    if bad_value:
        rules["value of another type"] = reduce(lambda a, b: a | b, bad_value)
    values = [text[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    record = F.concat_ws(sep, *[F.col(f"_{i}") for i in range(len(header) + 1)]).alias("record")
    return split_rejects(found, rules).select(*values, "reject_reason", record)


def _texts(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header) + 1)])


def scan_checked(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = False, range_bytes: int | None = None
) -> DataFrame:
    """The columns of ``schema``, found by their names in the header of every file, with ``reject_reason`` and ``record``.

    Columns are never inferred from the data: only the first line of each file is read ahead, and files are read in groups of equal
    headers. A file without one of the columns is an error. A line with more fields than its header, or with a value that its column's
    type can't hold, has a reason; the others have null. ``record`` has the line's fields, up to the first one too many. Fields missing
    at the end of a line are null, as Spark reads them. No line ends the scan or is lost.

    With ``multi_line``, quoted fields may hold line feeds. Files above ``range_bytes`` (the session's ``spark.sql.files.maxPartitionBytes``)
    are then cut into records by byte ranges (:func:`ranges.quoted_records`), so that many tasks share one; smaller files are a task each.
    """
    form = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}
    groups = _headers(spark, path, sep)
    for header in groups:
        if missing := [c for c in schema.names if c not in header]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    large: set[str] = set()
    if multi_line:
        most = range_bytes or int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
        large = {r.file for r in ranges.file_sizes(spark, path).where(F.col("bytes") > most).collect()}
    out = []
    for header, files in groups.items():
        if large:
            files = files or [r.file for r in ranges.file_sizes(spark, path).collect()]
        cut = [f for f in files or () if f in large]
        whole = [f for f in files or () if f not in large]
        if whole or not files:
            out.append(_checked(spark.read.options(**form).schema(_texts(header)).csv(whole or path), header, schema, sep))
        if cut:
            records = ranges.quoted_records(ranges.file_lines(spark, cut)).where("NOT first")
            parsed = records.select(F.from_csv("record", _texts(header).simpleString()[7:-1].replace(":", " "), form).alias("r")).select("r.*")
            out.append(_checked(parsed, header, schema, sep))
    return reduce(DataFrame.unionByName, out)


def accepted(scanned: DataFrame) -> DataFrame:
    """The good rows of a checked scan."""
    return scanned.where("reject_reason IS NULL").drop("reject_reason", "record")


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType = schemas.DOCUMENTS, multi_line: bool = False) -> DataFrame:
    """Good rows of tab-separated documents with a header. One record per line keeps large files splittable."""
    return accepted(scan_checked(spark, path, schema, "\t", multi_line))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.DOCUMENTS, multi_line: bool = True) -> DataFrame:
    """Good rows of comma-separated documents with quoted multi-line text; large files are shared by many tasks."""
    return accepted(scan_checked(spark, path, schema, ",", multi_line))


def _source(spark: SparkSession, path: str, file: Column) -> Column:
    """A file's path below ``path`` without its suffix."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    # Paths come URL-encoded, but a plus sign is itself.
    whole = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    below = F.when(F.contains(whole, F.lit(root + "/")), F.substring_index(whole, root + "/", -1)).otherwise(F.substring_index(whole, "/", -1))
    return F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "")


def scan_wholetext(spark: SparkSession, path: str) -> DataFrame:
    """``<source, text>``: one row per file.

    The source is the file's path below ``path`` without its suffix: the stem for a flat folder, and different for files of
    equal names in different folders. For files above the size of a row, see :func:`scan_lines`.
    """
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return found.select(_source(spark, path, F.col("_metadata.file_path")).alias("source"), F.col("value").alias("text"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``<source, line, text>``: the lines of every file with their numbers from 1, for files larger than one row can be.

    A file is read by as many tasks as it has byte ranges. Sources are named as in :func:`scan_wholetext`.
    """
    found = ranges.numbered_lines(ranges.file_lines(spark, path, recursive=True))
    return found.select(_source(spark, path, F.col("file")).alias("source"), "line", F.regexp_replace("value", "\r$", "").alias("text"))


def scan_summary(spark: SparkSession, path: str, by_cluster: bool = False) -> DataFrame:
    """Word-frequency summaries, overall or by cluster."""
    schema = schemas.CLUSTER_SUMMARY if by_cluster else schemas.GLOBAL_SUMMARY
    return accepted(scan_checked(spark, path, schema))
