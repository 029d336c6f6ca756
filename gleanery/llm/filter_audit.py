"""Filter interaction audit: what each filter removes, in every order of the filters, and what that costs.

There is one table of failing rows for each filter. What a filter removes after others depends on which ones came
before, not on their order, so each failing row is asked once for each set of other filters: a left semi join with the
rows that fail one of the set finds the redundant failures, a left anti join the removals, and the rows that survive a
set are its own anti join. Orders are put together from the counts of sets at the end.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.shared import saved, words_of

#: What separates words, and signs that a text should not hold.
SPACE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


def text_filters(text: Column, first: Column, doc_id: Column) -> dict[str, Column]:
    """Failure of each filter: A short, B repetitive, C capitals, D signs, E equal to the text of a smaller id.

    first is the least id of the rows of an equal text.
    """
    words = words_of(text, SPACE)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(SIGNS),
        "E": F.coalesce(first < doc_id, F.lit(False)),
    }


def judged(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "lang", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """row, part, good, toxic and a boolean for each filter, for each row of docs (saved).

    Null texts and parts are empty. An id with several labels is good or toxic if one of them says so. A row without an id
    has no labels, is no copy and makes no other row one. Equal texts are known by 256-bit hashes; rows that repeat an
    id are judged each, and are no copies of each other for having equal ids.
    """
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    own = text_filters(F.col("t"), F.lit(None).cast("bigint"), F.col("i"))
    # numbered before the first shuffle and written at once: a task that runs again numbers its rows alike
    rows = saved(texts.select(F.monotonically_increasing_id().alias("row"), "i", "part", F.sha2("t", 256).alias("h"), *(own[f].alias(f) for f in "ABCD")), "judged-texts")
    # a hot text is one row here: sides of the join are a table each, so that a hot key can be split
    first = saved(rows.filter("i is not null").groupBy("h").agg(F.min("i").alias("first"), F.max("i").alias("last")).filter("first < last").select("h", "first"), "first-texts")
    known = labels.select(F.col(doc_id).alias("i"), F.col(good).alias("g"), F.col(toxic).alias("x")).filter("i is not null").groupBy("i").agg(F.coalesce(F.bool_or(F.col("g") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("x") == 1), F.lit(False)).alias("toxic"))
    out = rows.join(first, "h", "left").select("row", "i", "part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("i"), F.lit(False)).alias("E"))
    none = F.lit(False)
    return saved(out.join(known, "i", "left").select("row", "part", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"), *"ABCDE"), "judged")


def _sets(names: str) -> list[str]:
    return ["".join(c) for n in range(len(names) + 1) for c in combinations(names, n)]


def _choice(names: str, of: Column, sets) -> Column:
    """An array of the sets that belong to the filter in a column."""
    out = F.lit(None).cast("array<string>")
    for f in names:
        out = F.when(of == f, F.array(*map(F.lit, sets(f)))).otherwise(out)
    return out


def failing(rows: DataFrame, filters: str) -> dict[str, DataFrame]:
    """One relation of failing rows for each filter: row, part, good, toxic."""
    return {f: rows.filter(f).select("row", "part", "good", "toxic") for f in filters}


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, with counts of rows of the part; see filter_audit.

    rows: row (unique), part, good, toxic and a boolean for each filter (one letter each, at most five).
    """
    spark = rows.sparkSession
    tables = failing(rows, filters)
    fails = None
    for f, table in tables.items():
        named = table.withColumn("f", F.lit(f))
        fails = named if fails is None else fails.unionByName(named)
    fails = saved(fails, "failing")
    # rows hit by a set: those that fail one of its filters
    # merged: Spark takes an exploded table for as small as the one before and would broadcast it
    hits = fails.select("row", F.explode(_choice(filters, F.col("f"), lambda f: [s for s in _sets(filters) if f in s])).alias("before")).hint("merge")
    asked = fails.select("row", "part", "good", "toxic", "f", F.explode(_choice(filters, F.col("f"), lambda f: [s for s in _sets(filters) if f not in s])).alias("before"))
    keys = ["part", "f", "before"]
    removed = asked.join(hits, ["row", "before"], "left_anti").groupBy(*keys).agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    redundant = asked.join(hits, ["row", "before"], "left_semi").groupBy(*keys).agg(F.count("*").alias("redundant"))
    # survivors of a set: rows that fail nothing, and those at risk that no filter of the set hits
    clean = rows.join(fails.select("row"), "row", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    at_risk = fails.select("row", "part").distinct().select("row", "part", F.explode(F.array(*map(F.lit, _sets(filters)))).alias("before"))
    alive = at_risk.join(hits, ["row", "before"], "left_anti").groupBy("part", "before").agg(F.count("*").alias("alive"))
    # from here on tables have a row for each part and set
    parts = saved(rows.select("part").distinct().join(clean, "part", "left"), "parts")
    removed, redundant, alive = saved(removed, "removed"), saved(redundant, "redundant"), saved(alive, "alive")
    n = len(filters)
    share = {s: factorial(len(s)) * factorial(n - 1 - len(s)) for s in _sets(filters) if len(s) < n}
    weight = F.lit(None).cast("bigint")
    for s, w in share.items():
        weight = F.when(F.col("before") == s, w).otherwise(weight)
    by_filter = removed.groupBy("part", "f").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(F.length("before") == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"))
    plan = _orders(spark, filters)  # a row for each order and step: fixed by the number of filters
    grid = parts.select("part", "clean", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("before"), F.lit("".join(sorted(s + f))).alias("after")) for f in filters for s in _sets(filters) if f not in s))).alias("x")).select("part", "clean", "x.*")
    zero = F.lit(0).cast("bigint")
    counts = grid.join(removed, keys, "left").join(redundant, keys, "left").join(alive.withColumnRenamed("before", "after"), ["part", "after"], "left").join(by_filter, ["part", "f"], "left")
    counts = counts.select(*keys, (F.coalesce("clean", zero) + F.coalesce("alive", zero)).alias("kept"), *(F.coalesce(c, zero).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))
    return counts.join(F.broadcast(plan), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    rows = [("".join(p), k + 1, p[k], "".join(sorted(p[:k]))) for p in permutations(filters) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, f string, before string")


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Counts of documents for each part, order of the five text filters and step.

    kept (after the step), removed (at it), redundant (failing its filter, removed before), unique_fails (failing its filter
    only), good_lost and toxic_lost (removed here and so labelled), shapley (what its filter removes, summed over all
    orders). Parts are the values of the part column, null as the empty string; parts and orders that lose nothing have
    their zeros. No documents: no rows. Repeated rows count each; see judged for nulls and ties.
    """
    return audit(judged(docs, labels, **columns))
