"""The first row of each key wins for a time, with state that ends: later rows of the key go, until the time is over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.streaming.stateful import Buckets, by_key, column, keyed_stream


def admitted(times: np.ndarray, until: int, within: int) -> tuple[list[int], int]:
    """Places of the rows that win among rows in order of time, and the time until which the last of them does."""
    won, at = [], int(np.searchsorted(times, until, side="left")) if until else 0
    while at < len(times):
        won.append(at)
        until = int(times[at]) + within
        at = int(np.searchsorted(times, until, side="left"))
    return won, until


class FirstWins(Buckets):
    """A row wins if no row of its key has won less than within (microseconds) before it. A timer drops states when the
    watermark passes their end, so state is that of the keys of the last while, not of all keys ever seen."""

    def __init__(self, within: int, columns: list[str]) -> None:
        self.within, self.columns = within, columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        times, number = column(parts, "micros__", np.int64), column(parts, "number__", np.int64)
        keys, numbers, place, _ = self.merged(column(parts, "key__", object))
        keep = []
        for k, own in by_key(place, times, number):
            won, until = admitted(times[own], int(numbers[k, 0]), self.within)
            numbers[k, 0] = until
            keep.append(own[won])
        self.store(keys, numbers)
        self.alarm(numbers[:, 0])
        keep, start = np.sort(np.concatenate(keep)), 0
        for p in parts:
            own = keep[np.searchsorted(keep, start) : np.searchsorted(keep, start + len(p))] - start
            if len(own):
                yield p.iloc[own][self.columns]
            start += len(p)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        keys, numbers = self.load()
        open_ = numbers[:, 0] // 1000 + 1 > now
        self.store([k for k, lasts in zip(keys, open_, strict=True) if lasts], numbers[open_])
        self.alarm(numbers[open_, 0])
        return iter(())


def first_wins(rows: DataFrame, keys: list[str], time: str, number: str, *, within: int, late: str = "0 seconds", root: str | None = None, progress: list | None = None) -> DataFrame:
    """Rows of a stream that win (all of its columns), after all that there is now, from the first batch on.

    number breaks ties of time. Rows later than the watermark are dropped. within is microseconds. Timestamps come back as
    instants. A root that is given again goes on from its checkpoint.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # names must not start with an underscore: rows reach Python by name
    marked = rows.withWatermark(time, late).withColumn("micros__", F.unix_micros(time)).withColumn("number__", F.col(number).cast("bigint"))
    out = keyed_stream(marked, FirstWins(within, rows.columns), schema, keys=keys, time_mode="EventTime", mode="Append", root=root, progress=progress)
    return out.drop("batch")
