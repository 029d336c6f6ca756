"""Choosing among candidates: slots, caps, quotas, uniqueness over two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.sources.tables import saved


def slot_winners(df: DataFrame, entity: list[str], slot: str, order: list[Column]) -> DataFrame:
    """The best row of each slot of each entity."""
    return top(df, [*entity, slot], order, 1).drop("place")


def top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most)


def exclusive_slots(df: DataFrame, entity: list[str], key: str, slots: list[tuple[str, Column, list[Column]]]) -> DataFrame:
    """Winners of slots (name, eligible, order) in order of priority; a later slot can't have an earlier winner."""
    out = None
    for name, eligible, order in slots:
        rest = df.filter(eligible)
        if out is not None:
            rest = rest.join(out.select(*entity, key), [*entity, key], "left_anti")
        found = top(rest, entity, order, 1).drop("place").withColumn("slot", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


#: A round of greedy_unique that decides less than this share of the rows is the last one.
LEAST_SHARE = 0.1


def greedy_unique(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows that a walk in the given (total) order keeps if no key may repeat among kept rows; a null key repeats nothing.

    Rounds: rows that are first in all their groups are kept; rows that share a key with a kept one go. Where groups cross at
    random each round decides a good part of the rows. Long chains, of which a round decides the head only, are left to a
    walk of each connected component: components by stars, each in one task, row by row in order with the keys it has kept
    so far in memory. No number of rounds or length of chain is too large; a single chain that holds most of a large table
    would be walked by one task, as the walk of a chain has no order but its own.
    """
    rest = saved(df.withColumn("__place", F.struct(*order)))
    n = rest.count()
    kept = rest.limit(0)
    while n:
        first, wins = rest, F.lit(True)
        for k, key in enumerate(keys):
            least = rest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("__place").alias(f"__first{k}"))
            first = first.join(least, key, "left")
            wins = wins & (F.col(key).isNull() | (F.col("__place") == F.col(f"__first{k}")))
        won = saved(first.filter(wins).select(rest.columns))
        kept = kept.unionByName(won)
        for key in keys:
            rest = rest.join(won.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
        rest = saved(rest.join(won.filter(_none(keys)).select("__place"), "__place", "left_anti").select(won.columns))
        left = rest.count()
        if left and n - left < LEAST_SHARE * n:
            return kept.unionByName(_walked(rest, keys)).select(df.columns)
        n = left
    return kept.select(df.columns)


def _none(keys: list[str]) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNull()
    return out


def _walked(rest: DataFrame, keys: list[str]) -> DataFrame:
    """The walk in each connected component of rows that share keys."""
    nodes = [F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(key).cast("string"))) for k, key in enumerate(keys)]
    rows = rest.withColumn("__node", F.coalesce(*nodes))
    edges = rows.select("__node", F.explode(F.array(*nodes)).alias("other")).filter("other is not null")
    found = connected_components(edges, "__node", "other").select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = rows.join(found, "__node").repartition("__component").sortWithinPartitions("__component", "__place")

    def walk(batches):
        component, used = None, [set() for _ in keys]
        for batch in batches:
            values = [batch.column(key).to_pylist() for key in keys]
            keep = []
            for n, own in enumerate(batch.column("__component").to_pylist()):
                if own != component:
                    component, used = own, [set() for _ in keys]
                row = [v[n] for v in values]
                if not any(x is not None and x in u for x, u in zip(row, used, strict=True)):
                    keep.append(n)
                    for x, u in zip(row, used, strict=True):
                        u.add(x)
            yield batch.take(keep)

    return joined.mapInArrow(walk, joined.schema).select(rest.columns)


def cap_and_fill(df: DataFrame, stratum: str, order: list[Column], cap: int, target: int) -> DataFrame:
    """At most cap rows of a stratum; the rest fills up to target in all."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    # rows past the target in their stratum can't be taken: they go before the global order
    return ranked.filter(F.col("place") <= target).orderBy(F.col("place") > cap, "place", stratum).limit(target)


def round_robin(df: DataFrame, entity: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows in all, one of each entity a round."""
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    return ranked.filter(F.col("round") <= most).orderBy("round", entity).limit(most)


def consensus(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """The value that at least so many and half of the rows with a value have; ties to the smaller; else null."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("support"))
    best = counts.withColumn("total", F.sum("support").over(Window.partitionBy(*keys))).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("support"), value))).filter("rn = 1")
    return best.select(*keys, F.when((F.col("support") >= least) & (2 * F.col("support") >= F.col("total")), F.col(value)).alias(value), "support", "total")


def priority_union(tiers: list[DataFrame], key: str, order: str, keep: list[str] = ()) -> DataFrame:
    """One row per key of tables in order of priority: that of the first tier that has the key, its first by the order column, with tier
    (from 1) and the kept columns. Null keys go."""
    every = None
    for n, rows in enumerate(tiers, 1):
        one = rows.select(key, F.struct(F.lit(n).alias("tier"), F.col(order).alias(order), *keep).alias("__first"))
        every = one if every is None else every.unionByName(one)
    return every.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("__first").alias("__first")).select(key, "__first.*")
