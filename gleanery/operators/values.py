"""Columns that depend on a few columns only, worked out once for each combination of their values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Combinations that may be broadcast; with more of them each row is worked out by itself.
MOST_VALUES = 50_000


def once_per_value(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], most: int = MOST_VALUES) -> DataFrame:
    """work(rows), where work adds columns that depend on the keys only.

    Where the keys have few combinations of values (about most of them, by a count of hashes), work sees each of them once and rows are joined
    with what it made, nulls included. With more combinations the rows would gain little, and work sees all of them.
    """
    if rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] > most:
        return work(rows)
    made = work(rows.select(*keys).distinct())
    new = [c for c in made.columns if c not in keys]
    side = made.select(*(F.col(k).alias(f"__{k}") for k in keys), *new)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(F.broadcast(side), same).select(*rows.columns, *new)
