"""Theme and volume tables as files: parquet for further work, JSON for a page.

The JSON form is one object with a key per group, made for charts of some dozen groups. Its lines are
built per group in parallel; only the finished lines meet in one task, and their number is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom import schemas

MAX_GROUPS = 100_000


def _key(text: Column) -> Column:
    """A JSON string literal, escaped by Spark's own writer."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _number(value: Column, digits: int | None) -> Column:
    return value.cast("string") if digits is None else F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def _group_order(grp: Column) -> list[Column]:
    """The global group, then ``c2, c10, ...`` by number, then names."""
    number = F.regexp_extract(grp, r"^c(\d+)$", 1).try_cast("int")
    return [grp != "global", number.isNull(), number, grp]


def themes_lines(themes: DataFrame, digits: int | None = None) -> DataFrame:
    """``<grp, line>``: ``"group": [["word", score], ...]`` with pairs in rank order."""
    pair = F.concat(F.lit("["), _key(F.col("word")), F.lit(", "), _number(F.col("score"), digits), F.lit("]"))
    pairs = F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair"))))
    joined = F.array_join(F.transform(pairs, lambda p: p["pair"]), ", ")
    return themes.groupBy("grp").agg(joined.alias("pairs")).select(
        "grp", F.concat(_key(F.col("grp")), F.lit(": ["), F.col("pairs"), F.lit("]")).alias("line")
    )


def volumes_lines(volumes: DataFrame, scalar: bool = False, digits: int | None = None) -> DataFrame:
    """``<grp, line>``: a number per group (``scalar``), or the volume with its quality fields; groups without sizes have no such field."""
    if scalar:
        value = F.col("volume").cast("string")
    else:
        def field(name: str) -> Column:
            text = F.coalesce(_number(F.col(name), digits), F.lit("null"))
            return F.concat(F.lit(f'"{name}": '), text)

        value = F.concat(
            F.lit("{"),
            F.concat_ws(
                ", ",
                F.concat(F.lit('"volume": '), F.col("volume").cast("string")),
                field("silhouette_score"),
                field("calinski_harabasz_score"),
                field("davies_bouldin_score"),
                F.concat(F.lit('"cluster_sizes": ['), F.array_join("cluster_sizes", ", "), F.lit("]")),
                field("cluster_density"),
            ),
            F.lit("}"),
        )
    return volumes.select("grp", F.concat(_key(F.col("grp")), F.lit(": "), value).alias("line"))


def json_object(lines: DataFrame) -> DataFrame:
    """One row ``<value>``: the lines of at most ``MAX_GROUPS`` groups as one JSON object."""
    order = _group_order(F.col("grp"))
    keyed = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.col("line"))
    listed = F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["line"])
    whole = F.concat(F.lit("{"), F.array_join(listed, ",\n"), F.lit("}"))
    checked = F.when(F.count("*") <= MAX_GROUPS, whole).otherwise(
        F.raise_error(F.lit(f"more than {MAX_GROUPS} groups"))
    )
    return lines.limit(MAX_GROUPS + 1).agg(checked.alias("value"))


def themes_export_json(themes: DataFrame, path: str, digits: int | None = None) -> None:
    json_object(themes_lines(themes, digits)).coalesce(1).write.mode("overwrite").text(path)


def volumes_export_json(volumes: DataFrame, path: str, scalar: bool = False, digits: int | None = None) -> None:
    json_object(volumes_lines(volumes, scalar, digits)).coalesce(1).write.mode("overwrite").text(path)


def write_themes(themes: DataFrame, path: str) -> None:
    themes.write.mode("overwrite").parquet(path)


write_volumes = write_themes


def themes_import_json(spark: SparkSession, path: str) -> DataFrame:
    """``<position, grp, rank, word, score>`` from a themes file; both orders come from the file."""
    themes = F.from_json("value", "map<string,array<array<string>>>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(themes).alias("position", "grp", "pairs"))
        .select("position", "grp", F.posexplode("pairs").alias("pos", "pair"))
        .select(
            "position",
            "grp",
            (F.col("pos") + 1).alias("rank"),
            F.col("pair")[0].alias("word"),
            F.col("pair")[1].cast("double").alias("score"),
        )
    )


def volumes_import_json(spark: SparkSession, path: str) -> DataFrame:
    """Volume rows from a volumes file of either form; a scalar file leaves the quality fields null."""
    entries = F.from_json("value", "map<string,string>")
    fields = [f for f in schemas.VOLUMES.fields if f.name != "grp"]
    record = F.from_json("entry", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(entries).alias("grp", "entry"))
        .withColumn("_r", F.when(F.col("entry").startswith("{"), record))
        .select(
            "grp",
            F.coalesce(F.col("entry").try_cast("bigint"), F.col("_r.volume")).alias("volume"),
            *[F.col(f"_r.{f.name}") for f in fields if f.name != "volume"],
        )
    )


def labelled_sections(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """``<doc_id, title, content, position, cluster>``: every section with its cluster.

    Both sides have one row per section and are joined on the section key.
    """
    keys = [c for c in ("doc_id", "position") if c in labels.columns]
    return sections.join(labels.select(*keys, "cluster"), keys).select(
        "doc_id", "title", "content", "position", "cluster"
    )
