"""Range joins and notations of ranges against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import notations as N
from gleanery.operators.ranges import range_join


def tables(spark, seed, widths):
    rng = random.Random(seed)
    points = [(n, rng.choice(["a", "b", None]), rng.choice([None, *range(-300, 300)])) for n in range(300)]
    ranges = []
    for m in range(80):
        lo = rng.randrange(-350, 350)
        ranges.append((m, rng.choice(["a", "b", "c", None]), lo, lo + rng.choice(widths)))
    ranges += [(900, "a", None, 5), (901, "a", 5, None), (902, "a", 9, 3), ranges[0]]
    p = spark.createDataFrame(points, "n int, k string, x bigint").repartition(3)
    return points, ranges, p, spark.createDataFrame(ranges, "m int, k string, lo bigint, hi bigint").repartition(3)


@pytest.mark.parametrize("widths", [[0], [0, 1, 2, 3, 4, 7, 8, 9], [5, 100, 2**40], [1 << 62]])
def test_range_join_is_the_loop(spark, widths):
    points, ranges, p, r = tables(spark, len(widths), widths)
    fits = [(n, m) for n, k, x in points for m, key, lo, hi in ranges if k is not None and k == key and None not in (x, lo, hi) and lo <= x <= hi]
    join = lambda how: range_join(p, r, ["k"], "x", "lo", "hi", how)
    assert sorted((a["n"], a["m"]) for a in join("inner").collect()) == sorted(fits)
    inside = {n for n, _ in fits}
    assert sorted(a["n"] for a in join("left_semi").collect()) == sorted(inside)
    assert sorted(a["n"] for a in join("left_anti").collect()) == sorted(n for n, *_ in points if n not in inside)
    left = sorted(((a["n"], a["m"]) for a in join("left").collect()), key=str)
    assert left == sorted([*fits, *((n, None) for n, *_ in points if n not in inside)], key=str)


def test_range_join_of_nothing(spark):
    _, _, p, r = tables(spark, 1, [3])
    assert range_join(p, r.limit(0), ["k"], "x", "lo", "hi").count() == 0
    assert range_join(p, r.limit(0), ["k"], "x", "lo", "hi", "left").count() == 300
    assert range_join(p.limit(0), r, ["k"], "x", "lo", "hi", "left_anti").count() == 0
    with pytest.raises(ValueError, match="kind of join"):
        range_join(p, r, ["k"], "x", "lo", "hi", "cross")


def test_wide_ranges_touch_two_buckets(spark):
    """Rows that are joined do not grow with the width of the ranges."""
    wide = spark.range(50).select(F.lit("a").alias("k"), (F.col("id") * 10**9).alias("lo"), (F.col("id") * 10**9 + 10**12).alias("hi"))
    points = spark.range(10).select(F.lit("a").alias("k"), (F.col("id") * 10**11).alias("x"))
    plan = range_join(points, wide, ["k"], "x", "lo", "hi")
    assert plan.count() == sum(1 for p in range(10) for r in range(50) if r * 10**9 <= p * 10**11 <= r * 10**9 + 10**12)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


def evidence(major, minor, file, title):
    """The rule as loops over matches."""

    def found(text, notations):
        return [[None if g in (None, "") else int(g) for g in (*m.groups(), None, None)[:3]] for _, p in notations for m in re.finditer(p, text or "", re.A)]

    if major is None or minor is None:
        return "unknown"
    for text in (file, title):
        members = found(text, N.MEMBER_NOTATIONS)
        if members:
            ok = any(s == major and lo <= minor <= (hi if hi is not None and lo <= hi <= lo + N.LONGEST else lo) for s, lo, hi in members)
            return "match" if ok else "mismatch"
    majors = found(title, N.MAJOR_NOTATIONS)
    if not majors:
        return "unknown"
    return "match" if any(lo <= major <= (lo if hi is None else hi) for lo, hi, _ in majors) else "mismatch"


def test_notations_are_the_loop(spark):
    rng = random.Random(21)
    parts = ["S01E02", "s1 e3", "S01E01-E03", "S01E01E02", "S02.E05-09", "1x01", "1x01-03", "5.1x264", "x265", "1x264", "Cap.102", "cap 102_103", "[Cap.1001]", "S01-S08", "S1-8", "S03", "Season 1", "Seasons 1-5", "Temporada 2 a 4", "Temp.1", "Saison 3", "Stagioni 1-8", "T4", "T01", "St4", "T444", "S01E90-E05", "S01E01-E99", "-", " ", ".", "é", "_", "E04", "2004", "y 3"]
    rows = []
    for n in range(1500):
        text = lambda: rng.choice([None, "", "".join(rng.choice(parts) + rng.choice(["", " ", ".", "-"]) for _ in range(rng.randrange(1, 5)))])
        rows.append((n, rng.choice([None, 1, 1, 2, 3, 4]), rng.choice([None, 1, 2, 3, 5, 90]), text(), text()))
    df = spark.createDataFrame(rows, "n int, major int, minor int, file string, title string").repartition(4)
    got = {r["n"]: r["e"] for r in df.select("n", N.member_evidence(*map(F.col, ("major", "minor", "file", "title"))).alias("e")).collect()}
    for n, *row in rows:
        assert got[n] == evidence(*row), row
    assert set(got.values()) == {"match", "mismatch", "unknown"}


def test_ranges_of_texts_join_with_members(spark):
    """What a text names, as rows, meets the members that it holds."""
    texts = spark.createDataFrame([("r1", "Show S01E02-E04"), ("r2", "Show 2x01"), ("r3", "none")], "record string, title string")
    named = texts.select("record", F.inline(N.member_ranges(F.col("title"))))
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 2)], "major int, minor int")
    got = range_join(members, named, ["major"], "minor", "low", "high")
    assert sorted((r["record"], r["major"], r["minor"]) for r in got.collect()) == [("r1", 1, 2), ("r1", 1, 4), ("r2", 2, 1)]
