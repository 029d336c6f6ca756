"""Failure streaks: rows after a run of failures of a source are skipped."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def failure_streaks(df: DataFrame, keys: list[str], order: list[Column], failed: Column, most: int) -> DataFrame:
    """df with skipped: a row of its key before it was the most-th failure in a row. order must be total."""
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__failed", F.coalesce(failed, F.lit(False)))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(upto))
    inner = Window.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__streak", F.sum(F.col("__failed").cast("int")).over(inner))
    breach = F.col("__failed") & (F.col("__streak") >= most)
    skipped = F.coalesce(F.bool_or(breach).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("skipped", skipped).drop("__failed", "__island", "__streak")


def breaker_streaks(df: DataFrame, source: str, kind: str, order: list[Column], outcome: str, most: int) -> DataFrame:
    """df with skipped, for outcomes 'ok', 'error' and 'limited' (null counts as ok). order must be total.

    A (source, kind) closes at its most-th error since its last ok, or at a limited row that is at least the
    (3 * most)-th of its source since the last ok of any kind there; its later rows are skipped and count for nothing.

    What one kind does changes what others of its source may do, so a source is walked in order: one shuffle by source, rows sorted within
    it, and a walk batch by batch that keeps two small numbers for each kind of the source at hand.
    """
    numbered = df.withColumn("__at", F.struct(*order))
    code = F.when(F.col(outcome) == "error", 1).when(F.col(outcome) == "limited", 2).otherwise(0)
    rows = numbered.withColumn("__code", code).withColumn("__who", F.struct(source)).repartition(source).sortWithinPartitions(source, "__at")

    def walk(batches):
        at, errors, closed, strikes = None, {}, set(), 0
        for batch in batches:
            skipped = []
            for who, what, code in zip(batch.column("__who").to_pylist(), batch.column(kind).to_pylist(), batch.column("__code").to_pylist(), strict=True):
                if at is None or who != at:
                    at, errors, closed, strikes = who, {}, set(), 0
                skipped.append(what in closed)
                if skipped[-1]:
                    continue
                if code == 0:
                    errors[what], strikes = 0, 0
                elif code == 1:
                    errors[what] = errors.get(what, 0) + 1
                    if errors[what] >= most:
                        closed.add(what)
                else:
                    strikes += 1
                    if strikes >= 3 * most:
                        closed.add(what)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(skipped, pa.bool_())], names=[*batch.schema.names, "skipped"])

    return rows.mapInArrow(walk, StructType([*rows.schema.fields, StructField("skipped", BooleanType())])).select(*df.columns, "skipped")
