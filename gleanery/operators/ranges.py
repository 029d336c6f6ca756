"""Joining points to the ranges that hold them, as an equi join over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import saved


def _bucket(x: Column, level: Column | int) -> Column:
    """x in buckets of 2 ** level; rounds down for negative numbers as well."""
    return F.call_function("shiftright", x, F.lit(level) if isinstance(level, int) else level)


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """Rows of points with each row of ranges of equal keys and low <= value <= high (whole numbers, both ends included).

    how: inner, left (points without a range stay, with nulls), left_semi or left_anti. A null key, value or end fits
    nothing, and neither does a range that ends before it starts. Columns other than the keys must have different names.
    The columns of an inner or left join are the keys, then those of points, then those of ranges.

    Each range goes to the least level whose buckets of 2 ** level are at least as wide as it is, so it touches two
    buckets at most, however wide it is; a point goes to its bucket of each level that occurs (64 at most, commonly a few). The
    condition that remains is checked on pairs of one bucket only. Hot keys are spread over their buckets, and Spark
    splits a bucket that is hot itself.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    lo, hi, v = F.col(low).cast("bigint"), F.col(high).cast("bigint"), F.col(value).cast("bigint")
    width = hi - lo  # one less than the number of values
    level = F.when(width == 0, 0).otherwise(F.length(F.bin(width)))
    sound = ranges.filter(lo <= hi).withColumn("__level", level.cast("int"))
    levels = sorted(r[0] for r in sound.select("__level").distinct().collect())  # one row a level
    if not levels:
        levels = [0]
    ends = F.array_distinct(F.array(_bucket(lo, F.col("__level")), _bucket(hi, F.col("__level"))))
    right = sound.withColumn("__bucket", F.explode(ends))
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("__level"), _bucket(v, n).alias("__bucket")) for n in levels)))
    by = [*keys, "__level", "__bucket"]
    # points that are looked at twice are numbered, in a table: a plan that runs twice may number them in another way
    left = points if how == "inner" else saved(points.withColumn("__row", F.monotonically_increasing_id()))
    probes = left.filter(v.isNotNull()).withColumn("__at", at).select(*left.columns, "__at.*")
    if how in ("inner", "left"):
        found = probes.join(right, by).filter((v >= lo) & (v <= hi)).drop("__level", "__bucket")
        if how == "inner":
            return found
        return found.unionByName(left.join(found.select("__row"), "__row", "left_anti"), allowMissingColumns=True).drop("__row")
    # a point has a row for each level, and any of them may find a range: numbers of the points that did, then their rows
    hits = probes.select(*by, v.alias("__v"), "__row")
    slim = right.select(*by, lo.alias("__lo"), hi.alias("__hi"))
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in by]
    rows = hits.alias("p").join(slim.alias("r"), [*same, F.col("p.__v").between(F.col("r.__lo"), F.col("r.__hi"))], "left_semi").select("__row").distinct()
    return left.join(rows, "__row", how).drop("__row")
