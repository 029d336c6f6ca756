"""Catalog and metadata records in one form: ids, names, years from text, members coerced and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years that a record may have.
LEAST_YEAR, MOST_YEAR = 1935, 2099


def years_of(text: Column) -> Column:
    """Numbers of four digits in a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]{4})"), 1), lambda y: y.cast("int"))


def catalog_records(raw: DataFrame, as_of: Column, *, kind: str = "single", least: int = LEAST_YEAR, most: int = MOST_YEAR) -> DataFrame:
    """id, kind, name, year, label of raw (id, kind, name, year as text, released) that are fit for a catalog.

    Rows without a proper id or a name go, those of a year out of range, and those that come out more than a day after as_of.
    No year and no date are no reason. A record is a group if it or the list says so; others have their year in the label.
    """
    id_, name = F.lower(F.trim("id")), F.trim("name")
    year = F.nullif(F.regexp_extract(F.coalesce("year", F.lit("")), "(?<![A-Za-z0-9_])(19[0-9]{2}|20[0-9]{2})(?![A-Za-z0-9_])", 1), F.lit("")).cast("int")
    rows = raw.select(id_.alias("id"), F.when((F.col("kind") == "group") | F.lit(kind == "group"), "group").otherwise("single").alias("kind"), name.alias("name"), year.alias("year"), "released")
    rows = rows.filter(F.col("id").rlike("^tt[0-9]{7,10}$") & (F.col("name") != "") & F.coalesce(F.col("year").between(least, most), F.lit(True)) & F.coalesce(F.col("released") <= as_of + F.expr("interval 1 day"), F.lit(True)))
    label = F.when((F.col("kind") == "single") & F.col("year").isNotNull(), F.concat("name", F.lit(" ("), "year", F.lit(")"))).otherwise(F.col("name"))
    return rows.select("id", "kind", "name", "year", label.alias("label"))


def metadata_records(raw: DataFrame) -> DataFrame:
    """id, kind, name, year, year_end, members of raw (id, kind, requested, name, year as text, videos).

    videos: array<struct<season, episode, number, name, title, released, first>> of strings. A row needs a name. Its kind is the one asked for
    where its own is neither group nor single. A group may be without an end year (still running), others end in their year. Only groups
    have members: those with whole numbers, the second above zero, the number standing in for the episode.
    """
    kind = F.when(F.col("kind").isin("group", "single"), F.col("kind")).otherwise(F.col("requested"))
    rows = raw.withColumn("__kind", kind).withColumn("__years", years_of(F.col("year"))).filter(F.trim("name") != "")

    def member(v: Column) -> Column:
        title = F.nullif(F.trim(F.coalesce(v["name"], v["title"])), F.lit(""))
        return F.struct(v["season"].try_cast("int").alias("major"), F.coalesce(v["episode"], v["number"]).try_cast("int").alias("minor"), title.alias("title"), F.coalesce(v["released"], v["first"]).alias("released"))

    members = F.filter(F.transform("videos", member), lambda m: m["major"].isNotNull() & (m["minor"] > 0))
    first, second, group = F.get("__years", F.lit(0)), F.get("__years", F.lit(1)), F.col("__kind") == "group"
    return rows.select("id", F.col("__kind").alias("kind"), F.trim("name").alias("name"), first.alias("year"), F.coalesce(second, F.when(~F.coalesce(group, F.lit(False)), first)).alias("year_end"), F.when(group, members).alias("members"))
