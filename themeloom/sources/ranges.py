"""Lines and quoted records of large files, cut out of byte ranges.

Spark's text source splits files by byte ranges at line ends. A range knows neither its line numbers nor whether it starts inside quotes; both
are prefix sums over the ranges of a file, of line counts and of quote parities. The table of ranges is small, the lines
themselves are only dealt by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from themeloom.session import stage


def file_lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``<file, block, n, value>``: lines without their line feed; ``n`` grows inside the byte range that begins at ``block``."""
    found = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n").text(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )


def file_sizes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``<file, bytes>`` of the files below a path, from the listing."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _before(blocks: DataFrame, amount: str) -> Column:
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``<file, line, value>`` of :func:`file_lines`, with line numbers of the whole file from 1."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"))
    blocks = blocks.select("file", "block", _before(blocks, "lines").alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("n"))
    return lines.withColumn("inside", inside).join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("line"), "value")


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``<file, first, record>``: the records of delimited files whose quoted fields may hold line feeds.

    A line begins a record if an even number of quotes stands before it in its file, as a doubled quote inside quotes counts
    twice. Lines that begin none belong to the last record begun before, be it in an earlier range. Empty lines between records are
    left out. In a file whose first line ends with a carriage return, those at line ends are dropped. ``first`` tells the first record of a file. A quote inside a field that is not
    quoted is not allowed for; nor is a record larger than a row can be.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote)))
    counted = lines.withColumn("odd", (quotes % 2).cast("int"))
    parity = counted.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.min_by("value", "n").endswith("\r").alias("crlf"))
    first = F.max(F.when(F.col("block") == 0, F.col("crlf"))).over(Window.partitionBy("file"))
    parity = parity.select("file", "block", (_before(parity, "odd") % 2).alias("open"), first.alias("crlf"))
    order = Window.partitionBy("file", "block").orderBy("n")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    begins = (F.col("open") + F.coalesce(F.sum("odd").over(until), F.lit(0))) % 2 == 0
    marked = counted.join(parity, ["file", "block"]).withColumn("begins", begins.cast("int"))
    # The number of the record in its range; 0 goes on with one of an earlier range.
    line = F.when(F.col("crlf"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("value")
    placed = stage(marked.select("file", "block", "n", line, F.sum("begins").over(order).alias("record")), "records")
    ranges = placed.groupBy("file", "block").agg(F.max("record").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("last") > 0, F.struct("block", "last")), ignorenulls=True).over(earlier)
    heads = ranges.select("file", "block", holder.alias("holder")).where("holder IS NOT NULL")
    heads = heads.select("file", "block", F.col("holder.block").alias("held_block"), F.col("holder.last").alias("held_record"))
    whole = placed.where("record > 0").select("file", "block", "record", F.col("block").alias("part"), "n", "value")
    rest = placed.where("record = 0").join(heads, ["file", "block"])
    rest = rest.select("file", F.col("held_block").alias("block"), F.col("held_record").alias("record"), F.col("block").alias("part"), "n", "value")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "value"))), lambda r: r["value"]), "\n")
    records = whole.unionByName(rest).groupBy("file", "block", "record").agg(text.alias("text"))
    header = (F.col("block") == 0) & (F.col("record") == 1)
    return records.where("text <> ''").select("file", header.alias("first"), F.col("text").alias("record"))


def first_lines(lines: DataFrame) -> DataFrame:
    """``<file, header>``: the first line of every file of :func:`file_lines`."""
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    return first.select("file", F.regexp_replace("header", "\r$", "").alias("header"))
