"""Reading and writing tables: line lists, payloads, snapshots, guarded CSV, versioned publishing, scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.rules import csv_guarded


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where none is set and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per line: keys, pos (from 0), line."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))


def carry_section(df: DataFrame, keys: list[str], pos: str, header: Column) -> DataFrame:
    """section: the last header at or before each line of its document."""
    return df.withColumn("section", F.last(header, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(pos)))


def read_snapshot(spark: SparkSession, index: DataFrame, path: str, key: str, schema: str, records: str) -> DataFrame:
    """index with the records of its entities' JSON documents; a missing document has none."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    kind = docs.schema[records].dataType.simpleString()
    return index.join(docs, key, "left").withColumn(records, F.coalesce(records, F.array().cast(kind)))


POINTER = "version string, number bigint, at bigint"


def _pointer(spark: SparkSession, root: str) -> tuple[str | None, int]:
    """The version that readers follow, and its number (0 where nothing is published)."""
    path = f"{root.rstrip('/')}/CURRENT"
    # the folder is made by the first publisher; a line without a version is no pointer
    spark.createDataFrame([], POINTER).coalesce(1).write.mode("ignore").json(path)
    lines = spark.read.schema(POINTER).json(path).filter("version is not null")
    last = lines.agg(F.max_by(F.struct("version", "number"), F.struct(F.coalesce("number", F.lit(0)), "at")).alias("p")).first()["p"]
    return (None, 0) if last is None else (last["version"], last["number"] or 0)


def publish(df: DataFrame, root: str, version: str, by: str, projections: dict[str, list[str]] | None = None) -> str:
    """Writes one JSON folder per value of a column under a new version, then adds a line to CURRENT that points at it.

    With projections (name: columns, the one of by among them) the same rows are written once for each, in a folder of that name;
    df is worked out once. Readers follow the line of the largest number, so the old version stays theirs until all of the new one
    is there, and there is a pointer at any time: a line is added by one commit and none is taken away. Numbers grow
    by one, whatever the clock says; of two publishers at once that take the same number the later one counts.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{version}"
    if projections is None:
        df.write.partitionBy(by).json(path)
    else:
        rows = saved(df)
        for name, columns in projections.items():
            rows.select(*columns).write.partitionBy(by).json(f"{path}/{name}")
    _, number = _pointer(spark, root)
    line = spark.createDataFrame([(version, number + 1)], "version string, number bigint").withColumn("at", F.unix_micros(F.current_timestamp()))
    line.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/CURRENT")
    return path


def current(spark: SparkSession, root: str, schema: str, projection: str | None = None) -> DataFrame:
    """The rows of the version (of one of its projections) that is published now; none where nothing is."""
    version, _ = _pointer(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json("/".join(filter(None, [root.rstrip("/"), version, projection])))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes and guarded cells."""
    df.select(*(csv_guarded(F.col(c).cast("string")).alias(c) for c in df.columns)).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def fitting(df: DataFrame, target: DataFrame) -> DataFrame:
    """Only the columns that the target has."""
    return df.select(*(c for c in df.columns if c in target.columns))
