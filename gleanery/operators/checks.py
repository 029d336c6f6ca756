"""Data quality: constraints and what violates them, repaired keys, and states that stop a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.merge import prepared


def violations(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """rule and violations: rows for which a rule is false (null is not), in one pass, and keys that several rows have."""
    flat = df.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))
    out = flat.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules))))
    for name, keys in (unique or {}).items():
        repeated = df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations"))
        out = out.unionByName(repeated.withColumn("rule", F.lit(name)))
    return out


def repaired(df: DataFrame, key: str, clean: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): df with its key in canonical form, one row a key (the first in order), and what can't be kept, with a reason
    ('no_key' where clean is null, 'repeated')."""
    rows = prepared(df.withColumn(key, clean), key, F.col(key).isNotNull(), order)
    reason = F.when(F.col("reason") == "invalid", "no_key").otherwise("repeated")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").withColumn("reason", reason)


def write_state(failures: Column, skipped: Column, confirmed: Column, saved: Column) -> Column:
    """What a report of a write says: error before skipped before unknown (not confirmed, or no count) before empty before saved."""
    sure = F.coalesce(confirmed, F.lit(False)) & (saved >= 0)
    return F.when(F.coalesce(failures > 0, F.lit(False)), "error").when(F.coalesce(skipped, F.lit(False)), "skipped").when(~F.coalesce(sure, F.lit(False)), "unknown").when(saved == 0, "empty").otherwise("saved")


def gate(states: DataFrame, column: str = "state", stop: tuple[str, ...] = ("error", "unknown")) -> None:
    """Raises if a row's state is one that stops a run; the message counts them."""
    found = {r[column]: r["count"] for r in states.filter(F.col(column).isin(*stop)).groupBy(column).count().collect()}  # one a state
    if found:
        raise RuntimeError("states that stop the run: " + ", ".join(f"{k} {n}" for k, n in sorted(found.items())))
