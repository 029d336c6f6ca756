"""Upserts by micro-batch into a versioned table that a restart continues.

The table is hash buckets of the key. A batch reads and writes only the buckets that its keys fall into, under its own
number, and then publishes a manifest: for each bucket, the batch that wrote it last. A batch whose manifest is there has been
applied and is skipped, so one that is repeated after a loss changes nothing, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.merge import upsert_checked

MANIFEST = "bucket int, written bigint, through bigint"


class UpsertTable:
    """A table under root with one row per key. schema: its columns, the key among them."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        # the first manifest is empty; where there is one already, nothing happens
        spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{self.root}/manifests/batch=-1")
        spark.createDataFrame([], "outcome string, n bigint").coalesce(1).write.mode("ignore").parquet(f"{self.root}/counters/batch=-1")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The last batch that is whole, and which batch wrote each bucket (a row a bucket)."""
        rows = self.spark.read.schema(f"{MANIFEST}, batch bigint").parquet(f"{self.root}/manifests").filter("bucket is not null")
        found = rows.join(rows.agg(F.max("batch").alias("batch")), "batch").select("batch", "bucket", "written").collect()
        return (found[0]["batch"] if found else -1), {r["bucket"]: r["written"] for r in found if r["bucket"] >= 0}

    def _buckets(self, which: dict[int, int]) -> DataFrame:
        if not which:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/state/batch={w}/bucket={b}" for b, w in sorted(which.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._buckets(self.manifest()[1])

    def counters(self) -> DataFrame:
        """outcome (inserted, updated, duplicate, invalid) and n of each batch."""
        return self.spark.read.schema("outcome string, n bigint, batch bigint").parquet(f"{self.root}/counters").filter("outcome is not null")

    def apply(self, delta: DataFrame, number: int, valid: Column, order: list[Column]) -> bool:
        """Merges a batch; False if it has been applied before."""
        through, written = self.manifest()
        if number <= through:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        delta = delta.persist()
        try:
            touched = [r[0] for r in delta.filter(F.coalesce(valid, F.lit(False))).select(bucket).distinct().collect()]  # at most the number of buckets
            old = self._buckets({b: w for b, w in written.items() if b in set(touched)})
            merged, rejected = upsert_checked(old, delta, self.key, valid, order)
            path = f"{self.root}/state/batch={number}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            outcomes = self.spark.read.parquet(path).filter("action <> 'kept'").select(F.col("action").alias("outcome")) if touched else self.spark.createDataFrame([], "outcome string")
            counts = outcomes.unionByName(rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
            counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counters/batch={number}")
        finally:
            delta.unpersist()
        now = {**written, **dict.fromkeys(touched, number)}
        lines = [(b, w, number) for b, w in now.items()] or [(-1, number, number)]
        # the manifest comes last: until it is whole, readers have the batch before
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/batch={number}")
        return True


def upsert_stream(stream: DataFrame, table: UpsertTable, valid: Column, order: list[Column], *, after: Callable[[int], None] | None = None) -> UpsertTable:
    """All that the stream has now, batch by batch; null values never overwrite known ones, of a key's valid rows in a batch the
    first in order counts. The checkpoint is beside the table, so calling this again goes on where it ended."""

    def merge(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, valid, order)
        if after:
            after(number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{table.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table
