"""URL filter: rules by host and path, boosted trees on lexical features for what no rule judges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import bounded_sample, table
from themeloom.session import drop_staged, stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

MAX_RULES = 500
MAX_LABELLED = 20_000
FOLDS = 5
TREES = 20
DEPTH = 4


def _after_scheme(url: str) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def host_of(url: str = "url") -> Column:
    raw = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``, null if none fits. Of equally long ones the first wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into one expression")
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _share(text: Column, pattern: str) -> Column:
    left = F.length(F.regexp_replace(text, pattern, ""))
    return (F.length(text) - left) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character of the characters' distribution."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1))
    parts = F.transform(F.array_distinct(letters), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def lexical_features(url: str = "url") -> dict[str, Column]:
    """Numbers that describe a url's spelling; none is null."""
    whole, host, path = F.coalesce(F.col(url), F.lit("")), host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    features = {
        "url_length": F.length(whole),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": F.size(labels),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        "digit_share": _share(whole, "[0-9]"),
        "host_digit_share": _share(host, "[0-9]"),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.instr(whole, "#") > 0,
        "secure": F.lower(whole).startswith("https:"),
        "suffix_length": F.length(suffix),
        "first_label_length": F.length(F.element_at(labels, 1)),
        "file_name": path.rlike(r"\.[A-Za-z0-9]+\z"),
        "trailing_slash": path.endswith("/"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features.items()}


def suffix_of(host: str = "host") -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def fold_of(host: str = "host") -> Column:
    """Urls of one host are in one fold."""
    return F.pmod(F.xxhash64(F.lit(17), host), F.lit(FOLDS)).cast("int")


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """``<suffix, suffix_urls, blocked, judged>`` of ``urls`` ``<host, verdict>``: how many urls end in a host suffix, and how many of them
    are blocked and judged, in all (place 1) and in each fold of hosts."""
    blocked = (F.col("verdict") == "block").cast("int")
    fold = fold_of()

    def counts(what: Column) -> Column:
        own = [F.sum(F.when(fold == k, what)) for k in range(FOLDS)]
        return F.array(*[F.coalesce(c, F.lit(0)) for c in (F.sum(what), *own)])

    judged = F.col("verdict").isNotNull().cast("int")
    return urls.groupBy(suffix_of().alias("suffix")).agg(
        F.log1p(F.count("*")).alias("suffix_urls"), counts(F.coalesce(blocked, F.lit(0))).alias("blocked"), counts(judged).alias("judged")
    )


def blocked_share() -> Column:
    """The smoothed share of a suffix's judged urls that are blocked. A judged url doesn't count itself, nor the others of its fold of hosts: a
    share with its own verdict in it would tell the trees that verdict."""
    fold = fold_of() + 2

    def others(counts: str) -> Column:
        return F.col(counts)[0] - F.when(F.col("verdict").isNotNull(), F.element_at(counts, fold)).otherwise(0)

    return (others("blocked") + 1) / (others("judged") + 2)


def fit_trees(labelled: DataFrame, names: Sequence[str]) -> GBTClassificationModel | float:
    """Boosted trees over ``labelled`` ``<label, ...names>``, a bounded number of rows; a constant where the labels don't differ.

    Fitting is by Spark's own distributed learner.
    """
    total, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, total):
        return float(positive / total) if total else 0.0
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(labelled).select("label", "features")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(rows)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``<id, host, path, rule, verdict, score>`` of every row.

    About ``max_labelled`` labelled urls at most, chosen by a hash of the url, fit the trees. A url that a rule fits gets the rule's verdict and is a labelled example for the trees; the trees judge all others (``score``
    is their probability of ``block``, null under a rule). Null urls and such without ``://`` have an empty host and path and are
    judged by the trees. Without labelled urls, or where all have one label, that label decides (``allow`` without any).
    Repeated rows and null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    base = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))
    split = base.select("id", "url", host_of().alias("host"), path_of().alias("path"))
    ruled = split.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("id", "url", "host", "path", "found.rule", "found.verdict")
    own = lexical_features()
    stats = stage(suffix_statistics(ruled), "suffixes")
    featured = ruled.withColumns(own).withColumn("suffix", suffix_of()).join(stats, "suffix", "left")
    featured = stage(featured.withColumn("suffix_blocked", blocked_share()).drop("suffix", "blocked", "judged"), "urls")
    drop_staged(stats)
    names = [*own, "suffix_urls", "suffix_blocked"]
    label = (F.col("verdict") == "block").cast("double").alias("label")
    labelled = featured.where("verdict is not null").select("url", label, *names)
    model = fit_trees(bounded_sample(labelled, "url", max_labelled), names)
    if isinstance(model, float):
        scored = featured.withColumn("score", F.lit(model))
    else:
        rows = VectorAssembler(inputCols=names, outputCol="features").transform(featured)
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", judged).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
