"""What the operators share: scratch tables, checked broadcasts, and bounded slices of Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond this the same join runs as a shuffle join.
BROADCAST_ROWS = 50_000
#: The same for tables of one number a row.
BROADCAST_IDS = 1_000_000
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def workers_can_import(spark: SparkSession) -> None:
    """Python workers find this package even where the driver found it through its working folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and all
    runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text: Column, apart: str) -> Column:
    """The non-empty pieces of a text between matches of a Java pattern; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), apart), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    whole_ascii = F.octet_length(text) == F.length(text)
    return F.when(whole_ascii, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about so many bytes of text at most; a longer text is alone in its slice."""
    for batch in batches:
        column = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]
