"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Features are lengths, depth, digit share, entropy, counts of parameters and separators, and how often urls of the same
suffix were blocked among the labelled ones. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import checked_broadcast, lower_ascii

LEXICAL = ["url_chars", "host_chars", "path_chars", "depth", "digit_share", "entropy", "params", "hyphens", "labels", "dots_in_path", "has_fragment", "https"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end.
    Both are empty for null and for urls without '://'."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule (verdict, host, path without its slash), or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. rules is a list in the driver, so its
    size is known; each rule is one condition.
    """
    fits = [
        F.when(((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rule_path)), F.struct(F.lit(len(rule_host) + 1 + len(rule_path)).alias("chars"), F.lit(f"{rule_host}/{rule_path}").alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, rule_host, rule_path in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<chars:int,rule:string,verdict:string>")


def lexical_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the LEXICAL columns and suffix (last part of the host)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, c: sum_ + (lambda p: -p * F.log2(p))((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size))
    query = F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_chars": F.length(url).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "digit_share": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "entropy": entropy,
            "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "hyphens": F.length(F.regexp_replace(url, "[^-]", "")).cast("double"),
            "labels": F.size(F.split("host", "\\.")).cast("double"),
            "dots_in_path": F.length(F.regexp_replace("path", "[^.]", "")).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "https": F.startswith(url, F.lit("https:")).cast("double"),
            "suffix": F.element_at(F.split("host", "\\."), -1),
        }
    )


def suffix_rates(labelled: DataFrame, weight: float = 20.0) -> DataFrame:
    """suffix and the share of blocked urls among the labelled ones (label), drawn towards one half."""
    return labelled.groupBy("suffix").agg(((F.sum("label") + weight / 2) / (F.count("*") + weight)).alias("suffix_rate"))


def assembled(urls: DataFrame, rates: DataFrame) -> DataFrame:
    with_rates = urls.join(checked_broadcast(rates), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.5)))
    return VectorAssembler(inputCols=[*LEXICAL, "suffix_rate"], outputCol="features").transform(with_rates)


def fit_url_filter(labelled: DataFrame, *, trees: int = 10, depth: int = 4, seed: int = 11) -> tuple[GBTClassificationModel | None, DataFrame]:
    """Boosted trees for labelled urls (url, host, path, label 0 or 1), and the suffix rates they use.

    Rates come from one half of the urls (by hash) and trees from the other, so the trees see rates of urls that they
    don't learn from. With fewer than two classes in their half there are no trees.
    """
    half = F.pmod(F.xxhash64("url"), F.lit(2))
    rows = lexical_features(labelled)
    rates, rows = suffix_rates(rows.filter(half == 0)), rows.filter(half == 1)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None, rates
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(assembled(rows, rates).select("features", F.col("label").cast("double")))
    return model, rates


def held_out_auc(labelled: DataFrame, **settings) -> float | None:
    """Area under the curve of receiver operation on a fifth of the urls (by hash) that takes no part in the fit; null
    where there are no trees."""
    fifth = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(5))
    model, rates = fit_url_filter(labelled.filter(fifth != 0), **settings)
    if model is None:
        return None
    scored = model.transform(assembled(lexical_features(labelled.filter(fifth == 0)), rates))
    return BinaryClassificationEvaluator(labelCol="label").evaluate(scored.withColumn("label", F.col("label").cast("double")))


def labelled_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url") -> DataFrame:
    """url, host, path and label (1 for block) of the urls that a rule judges."""
    host, path = host_and_path(F.col(url))
    ruled = pages.select(F.col(url).alias("url"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.filter("fit is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("int").alias("label"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url", page_id: str = "page_id", trees: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), block_score, for each row of pages.

    The longest fitting rule decides; the urls that rules judge are the labelled ones from which the trees learn to
    judge the others (block from a score of one half on). Without trees all others are allowed. A null url is judged as
    the empty one. Rows that repeat a page_id are judged each by its url, equal urls alike. Of two rules of one length
    (equal but for the verdict) block wins. Other columns are not read. The trees are fitted while the result is made.
    """
    host, path = host_and_path(F.col(url))
    cut = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    ruled = cut.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    model, rates = fit_url_filter(labelled_urls(pages, rules, url=url), trees=trees)
    if model is None:
        scored = ruled.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(assembled(lexical_features(ruled), rates)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("page").alias(page_id), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("score").alias("block_score"))
