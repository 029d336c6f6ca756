"""Progress and failure streaks with keyed state: the streaming twins of progress_advance and failure_streaks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.sources.tables import scratch
from gleanery.streaming.streams import source

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Fixed value: keys are dealt into so many buckets, whose states are read and written whole. A checkpoint holds for the number it was made with.
BUCKETS = 256


class Buckets(StatefulProcessor):
    """States of width whole numbers for each key of a bucket, as one value: a call of the state store is a round trip to the JVM, which is little
    for a bucket and much for a key. Keys are the texts of key__ (JSON, so they hold no line break)."""

    width = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("states", "keys binary, numbers binary")

    def load(self) -> tuple[list[str], np.ndarray]:
        """Keys, and a row of numbers for each."""
        if not self.state.exists():
            return [], np.zeros((0, self.width), dtype=np.int64)
        keys, numbers = self.state.get()
        return bytes(keys).decode().split("\n"), np.frombuffer(bytes(numbers), dtype="<i8").reshape(-1, self.width).copy()

    def store(self, keys: list[str], numbers: np.ndarray) -> None:
        if keys:
            self.state.update(("\n".join(keys).encode(), numbers.astype("<i8").tobytes()))
        elif self.state.exists():
            self.state.clear()

    def merged(self, names: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """All keys, those of names included; their numbers (new ones all zero); the place of each name; places that are new."""
        keys, numbers = self.load()
        codes, found = pd.factorize(names)
        at = {k: n for n, k in enumerate(keys)}
        place = np.array([at.setdefault(k, len(at)) for k in found], dtype=np.int64)
        new = len(at) - len(keys)
        numbers = np.concatenate([numbers, np.zeros((new, self.width), dtype=np.int64)])
        return list(at), numbers, place[codes], np.arange(len(at)) >= len(at) - new

    def alarm(self, ends: np.ndarray) -> None:
        """One timer for the first of these times (microseconds), in place of the one before."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if len(ends):
            self.handle.registerTimer(int(ends.min()) // 1000 + 1)

    def close(self) -> None:
        pass


def by_key(place: np.ndarray, *order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place that occurs, with its rows in the order of the columns (the first counts most)."""
    rows = np.lexsort((*reversed(order), place))
    starts = np.flatnonzero(np.diff(place[rows], prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield int(place[rows[start]]), rows[start:end]


def column(parts: list[pd.DataFrame], name: str, kind: type | None = None) -> np.ndarray:
    return np.concatenate([p[name].to_numpy(dtype=kind) for p in parts])


class Streaks(Buckets):
    """Per key: requests, failures and skipped rows so far, the streak, and whether it has been cut off.

    Rows of a micro-batch are taken in order of (micros, event_id); a later batch is later.
    """

    width = 4

    def __init__(self, most: int) -> None:
        self.most = most

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        times, number, failed = column(parts, "micros", np.int64), column(parts, "event_id", np.int64), column(parts, "failed", bool)
        keys, numbers, place, _ = self.merged(column(parts, "key__", object))
        touched = []
        for k, own in by_key(place, times, number):
            ok, errors, skipped, streak = (int(x) for x in numbers[k])
            for bad in failed[own].tolist():
                if streak >= self.most:
                    skipped += 1
                elif bad:
                    errors, streak = errors + 1, streak + 1
                else:
                    ok, streak = ok + 1, 0
            numbers[k] = ok, errors, skipped, streak
            touched.append(k)
        self.store(keys, numbers)
        yield pd.DataFrame({"key__": [keys[k] for k in touched], **{c: numbers[touched, n] for n, c in enumerate(("ok", "errors", "skipped"))}})


class Progress(Buckets):
    """Per key: rows done, the last one, and the start, which stays that of the first batch. Times are microseconds."""

    width = 3

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        keys, numbers, place, new = self.merged(column(parts, "key__", object))
        numbers[new] = 0, -1, np.iinfo(np.int64).max
        numbers[:, 0] += np.bincount(place, minlength=len(keys))
        np.maximum.at(numbers[:, 1], place, column(parts, "event_id", np.int64))
        first = new[place]
        np.minimum.at(numbers[:, 2], place[first], column(parts, "micros", np.int64)[first])
        self.store(keys, numbers)
        touched = np.unique(place)
        yield pd.DataFrame({"key__": [keys[k] for k in touched], **{c: numbers[touched, n] for n, c in enumerate(("done", "last_id", "started"))}})


def keyed_stream(rows: DataFrame, processor: Buckets, schema: str, *, keys: list[str], time_mode: str = "None", mode: str = "Update", root: str | None = None, progress: list | None = None) -> DataFrame:
    """What the processor gives for the keys of a stream (simple types), after all that there is now, with the number of the batch.

    The processor sees buckets of keys, and each row's key in key__. Each batch is a table of its own number, so that a repeated batch takes the place
    of its first try. A root that is given again goes on from its checkpoint, and all batches so far come back. progress gets what Spark tells of
    each batch.
    """
    spark = rows.sparkSession
    package = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if package not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), package]))
    out, before = (root or scratch(spark)).rstrip("/"), spark.conf.get(PROVIDER, None)
    rows = rows.withColumn("key__", F.to_json(F.array(*(F.col(k).cast("string") for k in keys))))
    rows = rows.withColumn("bucket__", F.pmod(F.xxhash64("key__"), F.lit(BUCKETS)))
    spark.conf.set(PROVIDER, ROCKS)
    try:
        states = rows.groupBy("bucket__").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

        query = states.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode(mode.lower()).trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{out}/rows")


def latest_states(rows: DataFrame, processor: Buckets, schema: str, *, key: str = "user_id", time_mode: str = "None", root: str | None = None) -> DataFrame:
    """The key and the last state (schema) that the processor gives for each key of a stream; the column seq, if there is one, orders rows of a batch."""
    found = keyed_stream(rows, processor, f"key__ string, {schema}", keys=[key], time_mode=time_mode, root=root)
    order = F.struct(*(c for c in ("batch", "seq") if c in found.columns))
    states = [c for c in found.columns if c not in ("key__", "batch")]
    last = found.groupBy("key__").agg(F.max_by(F.struct(*states), order).alias("s"))
    return last.select(F.from_json("key__", "array<string>")[0].cast(rows.schema[key].dataType).alias(key), "s.*")


def streak_stream(spark: SparkSession, path: str, most: int) -> DataFrame:
    """ok, errors and skipped rows of each user."""
    rows = source(spark, path).select("user_id", F.unix_micros("ts").alias("micros"), "event_id", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"))
    return latest_states(rows, Streaks(most), "ok bigint, errors bigint, skipped bigint")


def progress_stream(rows: DataFrame, complete_at: int, *, root: str | None = None) -> DataFrame:
    """done, last_id, started_at (of the first batch that has the user) and status of each user_id of a stream."""
    slim = rows.select("user_id", "event_id", F.unix_micros("ts").alias("micros"))
    states = latest_states(slim, Progress(), "done bigint, last_id bigint, started bigint", root=root)
    return states.select("user_id", "done", "last_id", F.timestamp_micros("started").cast("timestamp_ntz").alias("started_at"), F.when(F.col("done") >= complete_at, "complete").otherwise("active").alias("status"))
