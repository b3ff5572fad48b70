"""Make a theme map from the command line: ``spark-submit -m themeloom <kind> --input ... --output ...``.

Input is a folder of text files (``chunks``, ``verses``, ``verse-tree``) or of delimited documents (``news``:
tab-separated with a ``content`` column; ``categories``: CSV with category, headline and content). Output is a
folder with the theme and volume tables as parquet and as JSON for the page.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from themeloom import schemas
from themeloom.plans import theme_maps
from themeloom.session import clear_staging, spread, stage
from themeloom.sources import readers


def _with_id(df: DataFrame) -> DataFrame:
    """Number the documents; equal documents stay separate documents. The numbers are staged, so every later pass sees the same ones."""
    return spread(stage(df.withColumn("doc_id", F.monotonically_increasing_id()), "documents"), "doc_id")


def main() -> None:
    parser = argparse.ArgumentParser(prog="themeloom", description=__doc__)
    parser.add_argument("kind", choices=["news", "chunks", "verses", "verse-tree", "categories"])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--clusters", type=int)
    parser.add_argument("--chunk-size", type=int, default=1000)
    parser.add_argument("--overlap", type=int, default=100)
    parser.add_argument("--heading", help="pattern of a heading line, for verses")
    parser.add_argument("--topics", type=int)
    parser.add_argument("--seed", type=int, default=42)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("themeloom").getOrCreate()

    options = {"seed": args.seed}
    if args.topics:
        options["n_topics"] = args.topics
    if args.kind == "news":
        content = T.StructType([T.StructField("content", T.StringType())])
        docs = _with_id(readers.scan_tsv(spark, args.input, content))
        if args.clusters:
            options["max_clusters"] = args.clusters
        result = theme_maps.news_theme_map(docs, **options)
    elif args.kind == "categories":
        docs = _with_id(readers.scan_csv(spark, args.input, schemas.CATEGORY_DOCUMENTS))
        result = theme_maps.category_theme_map(docs, **options)
    else:
        docs = _with_id(readers.scan_wholetext(spark, args.input)).withColumnRenamed("text", "content")
        if args.kind == "chunks":
            if args.clusters:
                options["n_clusters"] = args.clusters
            result = theme_maps.chunk_theme_map(docs, chunk_size=args.chunk_size, overlap=args.overlap, **options)
        else:
            if not args.heading:
                parser.error("verses need --heading")
            if args.clusters:
                options["n_clusters" if args.kind == "verses" else "max_clusters"] = args.clusters
            plan = theme_maps.verse_theme_map if args.kind == "verses" else theme_maps.verse_hierarchy_map
            result = plan(docs, args.heading, **options)
    result.write(f"{args.output}/tables")
    result.export_json(f"{args.output}/page", scalar_volumes=args.kind in ("news", "verse-tree"))
    clear_staging(spark)
    spark.stop()


if __name__ == "__main__":
    main()
