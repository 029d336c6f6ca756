"""Streaming twins: ingest each file once, windowed metrics, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gleanery.session import instants
from gleanery.sources.tables import scratch


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or files at a path, each of them once; timestamps as instants."""
    schema = spark.read.parquet(path).schema
    return instants(spark.readStream.schema(schema).parquet(f"{path}*"))  # a pattern, so that a single file will do


def in_slices(df: DataFrame, order: str, slices: int, rows_per_file: int = 500_000) -> DataFrame:
    """A stream that brings the rows of df slice by slice, in order of a column of whole numbers, a micro-batch each.

    Each slice is written by itself, so that its files are newer than those before. All slices have as many files, by the number of all rows, so that
    a number of files is a slice: a row for each file, which is left out again, keeps Spark from leaving out files without others.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    step, files = (high - low) // slices + 1, n // slices // rows_per_file + 1
    marks = spark.range(files).select(F.col("id").cast("int").alias("file__"), F.lit(True).alias("mark__"))
    for k in range(slices):
        own = df.filter((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step))
        own = own.withColumn("file__", F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int")).unionByName(marks, allowMissingColumns=True)
        own.repartition(files, "file__").write.partitionBy("file__").parquet(f"{path}/slice={k}")
    stream = spark.readStream.schema(StructType([*df.schema.fields, StructField("mark__", BooleanType())]))
    rows = stream.option("maxFilesPerTrigger", files).parquet(f"{path}/slice=*/file__=*").filter("mark__ is null").drop("mark__")
    return instants(rows)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All that there is now, written as a table in the shared folder; restarts go on from the checkpoint beside it."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingested(spark: SparkSession, path: str) -> DataFrame:
    return run(source(spark, path), "append")


def windowed_metrics(rows: DataFrame, every: str, *, kind: str = "event_type", time: str = "ts", value: str = "value", late: str = "1 day", root: str | None = None) -> DataFrame:
    """Counts and sums per kind and tumbling window of a stream, as they stand after the last batch that touched them.

    Rows of windows that the watermark has left behind are dropped, and so is the state of such windows: it is that of the
    last while, however long the stream. A root that is given again goes on from its checkpoint.
    """
    spark, path = rows.sparkSession, root or scratch(rows.sparkSession)
    counted = rows.withWatermark(time, late).groupBy(kind, F.window(time, every).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    out = counted.select(kind, F.col("w.start").alias("start"), "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    found = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/rows")
    return found.groupBy(kind, "start").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def advanced(old: DataFrame, new: DataFrame, key: str, *, complete_at: int) -> DataFrame:
    """Progress after a run: counts add up, the first start stays, what has enough is complete."""
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in ("done", "last_id", "started_at")))
    rows = old.join(n, key, "full_outer")
    done = F.coalesce("done", F.lit(0)) + F.coalesce("__done", F.lit(0))
    return rows.select(key, done.alias("done"), F.greatest("last_id", "__last_id").alias("last_id"), F.coalesce("started_at", "__started_at").alias("started_at"), F.when(done >= complete_at, "complete").otherwise("active").alias("status"))
