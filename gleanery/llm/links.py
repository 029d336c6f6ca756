"""From candidate buckets to links between similar sets, without making all pairs of a bucket.

A bucket holds sets that may be similar; every similar pair shares some bucket. Each set is compared with the pivot of
its buckets only. A similar pair x, y of which x isn't similar to their pivot p is found by what the two add to p and
lack of it. Let A and R be how many elements a set adds and lacks, D = A - R, n its size, c = (1 - t) / (1 + t):

- x and y are similar if their additions and lacks overlap in at least need = (A + R of both - c * (n of both)) / 2;
- lacks can make up min(R) of it. A set is similar to p if excess = R + (1 - c) * D / 2 - c * n_p is not above 0, and
  need - min(R) >= excess(x) + (1 - c) * D(y) / 2. Where that is above 0 the pair shares an addition: sets meet in a prefix
  of their additions, the rarest first, which is as much shorter as the pair must share more;
- else y is a shorter copy (D < 0) and x but little beyond the threshold, and nearly all that y lacks x lacks as well: such
  sets meet in a prefix of additions and lacks, which for y is little longer than its additions.

Unlike the base that a family of near copies has in common, additions are rare, so what meets grows with the rows of the
buckets and not with the square of a family's size. No link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import checked_broadcast, saved

#: Sets of a pivot that are looked at to see what they have in common.
SAMPLE = 64


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Jaccard similarity of at least so many per cent (1 or more), in whole numbers; empty sets are not similar.

    shared is named once, as a plan may work it out each time it is named.
    """
    return ((100 + percent) * shared >= percent * (a + b)) & (a + b > 0)


def _pivoted(buckets: DataFrame) -> DataFrame:
    """key, id, pivot for buckets of two ids or more; the pivot is the id of most weight, then the least id."""
    known = buckets.dropna(subset=["key", "id"])
    heads = known.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id"))["id"].alias("pivot"), F.min("id").alias("least"), F.max("id").alias("most"))
    return known.join(heads.filter("least <> most").select("key", "pivot"), "key").select("key", "id", "pivot")


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    sets = saved(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent)).select("a", "b")


def _common(star: DataFrame, members: DataFrame, pivots: DataFrame) -> DataFrame | None:
    """pivot and common, for pivots of more than SAMPLE sets: what at least two of SAMPLE of its sets add to it.

    It only makes an order, in which what many sets of a pivot add comes last; any order finds all links.
    """
    large = star.groupBy("pivot").count().filter(F.col("count") > SAMPLE).select("pivot")
    place = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("id"), "id"))
    sample = saved(star.join(large, "pivot", "left_semi").withColumn("place", place).filter(F.col("place") <= SAMPLE).select("pivot", "id"), "sample")
    if sample.isEmpty():
        return None
    drawn = members.select("id", "x", F.explode("stars.pivot").alias("pivot")).join(checked_broadcast(sample), ["pivot", "id"], "left_semi")
    # what SAMPLE sets add is one sorted array for each pivot, in which what two of them add stands side by side
    added = drawn.join(pivots, "pivot").groupBy("pivot").agg(F.sort_array(F.flatten(F.collect_list(F.array_except("x", "p")))).alias("added"))
    twice = F.filter("added", lambda token, at: (at > 0) & (F.get("added", at - 1) == token))
    return saved(added.select("pivot", F.array_distinct(twice).alias("common")).filter("size(common) > 0"), "common")


def _judged(star: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """star (pivot, id and others) with n, adds, lacks, linked, and first and second: the tokens in which a pair meets
    that must share an addition, and those in which a pair meets that may share lacks only."""
    t = percent / 100
    c = (1 - t) / (1 + t)
    tiny = 1e-6
    pivots = sets_of(star.select(F.col("pivot").alias("id")).distinct()).select(F.col("id").alias("pivot"), F.col("tokens").alias("p"))
    # a set goes to its pivots from where it is made
    asked = star.groupBy("id").agg(F.collect_list(F.struct(*(c for c in star.columns if c != "id"))).alias("stars"))
    members = saved(sets_of(asked).select("id", "stars", F.col("tokens").alias("x"), F.size("tokens").alias("n")), "sets")
    # how short a partner can be: no shorter than any of the pivot's sets
    shortest = members.select("n", F.explode("stars.pivot").alias("pivot")).groupBy("pivot").agg(F.min("n").alias("shortest"))
    pivots = saved(pivots.join(shortest, "pivot"), "pivots")
    common = _common(star, members, pivots)
    both = members.select("id", "x", "n", F.inline("stars")).join(pivots.join(common, "pivot", "left") if common is not None else pivots.withColumn("common", F.lit(None).cast("array<bigint>")), "pivot")
    both = both.withColumn("more", F.array_except("x", "p")).withColumn("lacking", F.array_except("p", "x"))
    both = both.withColumn("added", F.when(F.col("common").isNull(), F.col("more")).otherwise(F.concat(F.array_except("more", "common"), F.array_intersect("more", "common"))))
    both = both.select("*", F.size("p").alias("n_p"), F.size("added").alias("adds"), F.size("lacking").alias("lacks"))
    both = both.withColumn("linked", similar(F.col("n") - F.col("adds"), F.col("n"), F.col("n_p"), percent))
    own = (1 - c) / 2 * (F.col("adds") - F.col("lacks"))
    excess = F.col("lacks") + own - c * F.col("n_p")
    partner = (1 - c) / 2 * (F.greatest("shortest", F.ceil(t * F.col("n") - tiny)) - F.col("n_p"))
    needed = F.greatest(F.lit(1), F.ceil(F.when(F.col("linked"), own).otherwise(excess + partner) - tiny)).cast("int")
    first = F.slice("added", 1, F.greatest(F.lit(0), F.col("adds") - needed + 1).cast("int"))
    shorter = F.when(F.col("linked"), F.col("adds") < F.col("lacks")).otherwise(excess + partner <= tiny)
    in_all = F.greatest(F.lit(1), F.ceil(F.when(F.col("linked"), F.col("lacks") + own).otherwise(2 * excess / (1 - c)) - tiny)).cast("int")
    second = F.slice(F.concat("added", "lacking"), 1, F.greatest(F.lit(0), F.col("adds") + F.col("lacks") - in_all + 1).cast("int"))
    second = F.when(shorter & (in_all <= F.col("lacks")), second).otherwise(F.array().cast("array<bigint>"))
    return both.select(*star.columns, "n", "adds", "lacks", "linked", first.alias("first"), second.alias("second"))


def _meeting(judged: DataFrame, percent: int, wanted: Column) -> DataFrame:
    """(a, b), a < b: pairs of a pivot that may be similar, at least one of them not linked to it; wanted is a condition
    on the aliases x and y, where x.id < y.id."""
    t = percent / 100
    c = (1 - t) / (1 + t)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("first").alias("tokens")), F.struct(F.lit(1).alias("kind"), F.col("second").alias("tokens")))
    rows = judged.select("*", F.explode(kinds).alias("k")).drop("first", "second")
    rows = rows.select("*", F.col("k.kind").alias("kind"), F.posexplode("k.tokens").alias("at", "token")).drop("k")
    x, y = rows.alias("x"), rows.alias("y")
    size = lambda s: F.col(f"{s}.adds") + F.col(f"{s}.lacks")
    need = (size("x") + size("y") - c * (F.col("x.n") + F.col("y.n"))) / 2
    rest = lambda s: F.when(F.col("x.kind") == 0, F.col(f"{s}.adds")).otherwise(size(s)) - F.col(f"{s}.at")
    reach = F.least(rest("x"), rest("y")) + F.when(F.col("x.kind") == 0, F.least("x.lacks", "y.lacks")).otherwise(0)
    met = (
        (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))
        & ~(F.col("x.linked") & F.col("y.linked")) & wanted
        & (F.least("x.n", "y.n") * 100 >= percent * F.greatest("x.n", "y.n"))
        & (reach >= need - 1e-6)
    )
    return x.join(y, met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def classes(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, near: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(node, component) for every id that is similar to another one, directly or over others.

    buckets: key, id, weight (the pivot of a bucket is the id of most weight, then the least id); only buckets of two
    ids or more matter. sets_of(asked) returns asked (distinct ids and whatever columns) with tokens (array of distinct
    longs, the rarest first in an order that all sets have in common). near(pairs) leaves out pairs (a, b) that a cheaper bound shows not to
    be similar. Rows with a null key or id have no links. Jobs run while the result is made.
    """
    rows = saved(_pivoted(buckets), "pivots")
    star = rows.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = saved(near(star), "near")
    found = components(_verified(star, sets_of, percent))
    # buckets within one class are done; in the others sets are compared by what they differ in from the pivot
    classed = rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).filter("least <> most and n > 2").select("key")
    star = saved(classed.join(mixed, "key", "left_semi").filter("id <> pivot").select("pivot", "id", "class").distinct(), "star")
    if star.isEmpty():
        return found
    judged = saved(_judged(star, sets_of, percent), "judged")
    judged = judged.join(judged.filter("not linked").select("pivot").distinct(), "pivot", "left_semi")
    pairs = saved(near(_meeting(judged, percent, F.col("x.class") != F.col("y.class"))), "pairs")
    if pairs.isEmpty():
        return found
    # what is known of the classes already is a star of short paths
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(_verified(pairs, sets_of, percent).unionByName(known))


def later(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """id: every id that is similar to a lesser id.

    buckets (key, id), sets_of as in classes. The pivot of a bucket is its least id: what is similar to it is settled,
    the others are compared by what they differ in from it. Jobs run while the result is made.
    """
    rows = _pivoted(buckets.withColumn("weight", F.lit(0)))
    star = saved(rows.filter("id <> pivot").select("pivot", "id").distinct(), "star")
    judged = saved(_judged(star, sets_of, percent), "judged")
    settled = judged.filter("linked").select("id").distinct()
    judged = judged.join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn("open", F.col("settled").isNull()).drop("settled")
    judged = judged.join(judged.filter("open").select("pivot").distinct(), "pivot", "left_semi")
    pairs = saved(_meeting(judged, percent, F.col("y.open")), "pairs")
    return settled.unionByName(_verified(pairs, sets_of, percent).select(F.col("b").alias("id"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of an edge (a, b).

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round is a table in the shared
    folder. The number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = saved(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = saved(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
