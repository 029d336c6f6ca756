"""License scan by MinHash bands over overlapping windows, with DataFrame functions only.

Of a text the shingles that some template has are kept, in order; words between them are skipped, so that what is put into a
copy does not lengthen it. Windows of twice a template's length over these, one length apart, hold any copy. A band is one
MinHash value; there are so many bands that a window that contains the asked share of a template's shingles meets it in
some band with probability 1 - miss. What meets is verified by exact containment, within a stretch of words. Of templates
that are nearly the same (two versions of a license), a text holds those whose own shingles it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.decontaminate import benchmark_words
from gleanery.llm.license_texts import TEXTS
from gleanery.llm.shared import checked_broadcast, saved

#: Short notices by which texts name their license.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: What the query looks for: the short notices and whole texts, headers and notices.
TEMPLATES = NOTICES + TEXTS
SHINGLE = 3


def _shingles(rows: DataFrame) -> DataFrame:
    """rows (with words w) and h: the hashes of their shingles, in order; none where there are fewer words."""
    hashed = rows.withColumn("g", F.transform("w", lambda w: F.xxhash64(w)))
    runs = F.transform("g", lambda x, at: F.xxhash64(x, *(F.get("g", at + k) for k in range(1, SHINGLE))))
    return hashed.withColumn("r", runs).withColumn("h", F.slice("r", 1, F.greatest(F.size("w") - SHINGLE + 1, F.lit(0)))).drop("g", "r")


def least(hashes: Column, seed: Column) -> Column:
    """The MinHash value for a seed: each hash is hashed again with it, so the values of two seeds are independent."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, seed)))


#: Lengths of templates are rounded up to a class; the lengths of two classes differ by this factor.
CLASS_RATIO = 1.6


def bands_for(own: int, window: int, share: float, miss: float) -> int:
    """Bands for templates of own distinct shingles: a window of so many shingles that holds share of them misses all with at most miss."""
    jaccard = share * own / (window + (1 - share) * own)
    return math.ceil(math.log(miss) / math.log(1 - jaccard)) if jaccard < 1 else 1


def reach(words: Column) -> Column:
    """Words within which the shingles of a copy must stand, for a template of so many: a copy may be stretched about threefold."""
    return 3 * words + 60


def _templates(templates: DataFrame, share: float, name: str, notice: str) -> DataFrame:
    """license, template (a number), m (words), t (distinct shingles), alike: array<struct<template, only>>, the templates of other
    licenses that share so much with this one that a copy of one can pass for the other, and what only this one has."""
    known = templates.select(F.col(name).alias("license"), benchmark_words(F.col(notice)).alias("w"))
    known = _shingles(known).filter("size(h) > 0").select("license", F.size("w").alias("m"), F.array_distinct("h").alias("t"), F.xxhash64("license", "w").alias("template"))
    known = saved(known.dropDuplicates(["template"]), "templates")
    own = known.select("template", "license", F.size("t").alias("n"), F.explode("t").alias("h"))
    both = own.join(own.toDF("template2", "license2", "n2", "h"), "h").filter("license <> license2").groupBy("template", "template2", "n", "n2").agg(F.count("*").alias("common"))
    near = both.filter(F.col("common") >= share * F.least("n", "n2")).select("template", "template2")
    alike = near.join(known.select("template", "t"), "template").join(known.select(F.col("template").alias("template2"), F.col("t").alias("t2")), "template2")
    alike = alike.groupBy("template").agg(F.collect_list(F.struct(F.col("template2").alias("template"), F.array_except("t", "t2").alias("only"))).alias("alike"))
    return saved(known.join(alike, "template", "left").select("license", "m", "t", "template", F.coalesce("alike", F.array().cast("array<struct<template:bigint,only:array<bigint>>>")).alias("alike")), "templates")


def _classes(known: DataFrame, share: float, miss: float) -> list[tuple[int, int, int]]:
    """(shingles, bands, needed) of each class of lengths: its windows are twice so many shingles long, one apart; a window of fewer than
    needed distinct shingles holds no template of the class. The driver sees one row for each length of templates."""
    sizes = [(r["s"], r["n"]) for r in known.groupBy((F.col("m") - SHINGLE + 1).alias("s")).agg(F.min(F.size("t")).alias("n")).collect()]
    by_class: dict[int, list[tuple[int, int]]] = {}
    for s, n in sizes:
        c = math.ceil(math.log(s, CLASS_RATIO) - 1e-9)
        by_class.setdefault(c, []).append((s, n))
    out = []
    for rows in by_class.values():
        most, fewest = max(s for s, _ in rows), min(n for _, n in rows)
        out.append((most, bands_for(fewest, 2 * most, share, miss), math.ceil(share * fewest - 1e-9)))
    return sorted(out)


def known_shingles(docs: DataFrame, known: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """row (a number), i, hits: array<struct<at, h>>, for each row of docs: the shingles that some template has, in order."""
    marks = checked_broadcast(known.select(F.explode("t").alias("h")).distinct().withColumn("known", F.lit(True)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("i"), benchmark_words(F.col(text)).alias("w"))
    every = _shingles(rows).select("row", "i", F.posexplode_outer("h").alias("at", "h")).join(marks, "h", "left")
    # the first shingle stands for the row, so that rows without a known one stay
    some = every.filter("known or at is null or at = 0").select("row", "i", F.when(F.col("known"), F.struct("at", "h")).alias("hit"))
    return some.groupBy("row").agg(F.first("i").alias("i"), F.array_sort(F.collect_list("hit")).alias("hits"))


def license_matches(rows: DataFrame, known: DataFrame, *, share: float = 0.8, miss: float = 1e-3) -> DataFrame:
    """row, license, template, rivals: the windows of rows (row, hits) that hold a template.

    A window holds a template if it has at least share of its distinct shingles within reach of each other. Rivals
    (template, seen) are those it can pass for; seen is the part found of the shingles that only this template has. A copy
    with so much else from templates inside that it has over a class's length of known shingles may be missed.
    """
    classes = _classes(known, share, miss)
    if not classes:
        return rows.select("row", F.lit("").alias("license"), F.lit(0).cast("bigint").alias("template"), F.array().cast("array<struct<template:bigint,seen:double>>").alias("rivals")).limit(0)
    steps = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(bands).alias("bands"), F.lit(need).alias("need")) for s, bands, need in classes))
    cut = rows.filter(F.size("hits") >= min(need for *_, need in classes)).select("row", "hits", F.explode(steps).alias("c")).filter(F.size("hits") >= F.col("c.need"))
    cut = cut.select("row", "hits", "c.*", F.explode(F.sequence(F.lit(0), F.size("hits") - 1, F.col("c.s"))).alias("start"))
    windows = cut.select("row", "s", "bands", "need", "start", F.slice("hits", F.col("start") + 1, 2 * F.col("s")).alias("x")).withColumn("h", F.array_distinct(F.transform("x", lambda v: v["h"])))
    windows = saved(windows.filter(F.size("h") >= F.col("need")).select("row", "s", "bands", "start", "x", "h"), "windows")

    def values(hashes: Column) -> Column:
        """The MinHash values of a row's class (s, bands), by band."""
        seeds = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda j: F.xxhash64(F.col("s"), j))
        return F.transform(seeds, lambda seed: least(hashes, seed))

    of = F.lit(None)
    for s, bands, _ in reversed(classes):
        of = F.when(F.col("m") - SHINGLE + 1 <= s, F.struct(F.lit(s).alias("s"), F.lit(bands).alias("bands"))).otherwise(of)
    keys = known.select("template", "t", of.alias("c")).select("template", "t", "c.*").select("s", "template", F.posexplode(values(F.col("t"))).alias("band", "value"))
    met = windows.select("row", "s", "start", F.posexplode(values(F.col("h"))).alias("band", "value")).join(checked_broadcast(keys), ["s", "band", "value"]).select("row", "s", "start", "template").distinct()
    both = met.join(windows, ["row", "s", "start"]).join(checked_broadcast(known), "template")
    own = F.filter("x", lambda v: F.array_contains("t", v["h"]))
    both = both.withColumn("own", own).filter(F.size("own") >= share * F.size("t"))
    near = lambda v: F.filter("own", lambda o: o["at"].between(v["at"], v["at"] + reach(F.col("m"))))
    held = F.exists("own", lambda v: F.size(F.array_distinct(F.transform(near(v), lambda o: o["h"]))) >= share * F.size("t"))
    rivals = F.transform("alike", lambda r: F.struct(r["template"].alias("template"), F.when(F.size(r["only"]) == 0, 0.0).otherwise(F.size(F.array_intersect(F.col("h"), r["only"])) / F.size(r["only"])).alias("seen")))
    return both.filter(held).select("row", "license", "template", rivals.alias("rivals"))


def scan_licenses(docs: DataFrame, templates: DataFrame, *, share: float = 0.8, miss: float = 1e-3, text: str = "text", doc_id: str = "doc_id", name: str = "license", notice: str = "notice") -> DataFrame:
    """doc_id and licenses (array, sorted): the templates that each text holds, for each row of docs.

    A template goes if less than half of what sets it apart from a rival is found, and more of the rival's is. Rows are
    judged by their own texts, whether they repeat a doc_id or have none; null and empty texts and templates of fewer than SHINGLE
    words hold nothing. Other columns are not read. Jobs run while the result is made.
    """
    known = _templates(templates, share, name, notice)
    rows = saved(known_shingles(docs, known, text=text, doc_id=doc_id), "license-rows")
    matches = saved(license_matches(rows, known, share=share, miss=miss), "licenses")
    seen = matches.select("row", "template", F.explode("rivals").alias("r")).groupBy("row", "template", F.col("r.template").alias("rival")).agg(F.max("r.seen").alias("seen"))
    lesser = seen.join(seen.toDF("row", "rival", "template", "more"), ["row", "template", "rival"]).filter("seen < 0.5 and seen < more").select("row", "template").distinct()
    named = matches.join(lesser, ["row", "template"], "left_anti").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    out = rows.select("row", "i").join(named, "row", "left")
    return out.select(F.col("i").alias(doc_id), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
