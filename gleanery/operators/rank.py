"""Places over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.tables import saved


def ranked(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in a total order.

    Rows are dealt into ranges of the order, each range numbers its own rows, and starts at the count of all rows before it: the driver
    sees one count a range. The ranges are a table in the shared folder, so that rows and counts belong to the same dealing.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    starts, total = [], 0
    for number, n in counts:
        starts.append((number, total))
        total += n
    side = df.sparkSession.createDataFrame(starts, "__range int, __start bigint")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(side), "__range").withColumn(place, F.col("__start") + within).drop("__range", "__start")
