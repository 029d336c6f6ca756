"""Breakers with a cool-down, as keyed state of a stream: what a key does after too many failures in a row, and when it may try again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.streaming.stateful import Buckets, by_key, column, latest_states

COUNTERS = ("ok", "errors", "skipped", "opened")
SCHEMA = "ok bigint, errors bigint, skipped bigint, opened bigint, open boolean, expired boolean, seq bigint"


def walk(times: np.ndarray, failed: np.ndarray, streak: int, until: int, most: int, cool_down: int) -> tuple[int, int, int, int, int, int]:
    """(ok, errors, skipped, opened, streak, until) after rows in order of time, from the state (streak, until) before them.

    until: rows before that time are skipped (0: closed). The most-th failure in a row opens the breaker until cool_down after it;
    the first row from then on goes through and starts a new streak. Work is by array, with a step for each opening.
    """
    n = len(times)
    ok = errors = skipped = opened = at = 0
    if until:
        at = int(np.searchsorted(times, until, side="left"))
        skipped += at
        if at == n:
            return ok, errors, skipped, opened, streak, until
        streak, until = 0, 0
    # failures in a row that end at each place, counted from the start of these rows
    last_ok = np.maximum.accumulate(np.where(failed, -1, np.arange(n)))
    run = np.where(failed, np.arange(n) - last_ok, 0)
    full = np.flatnonzero(run >= most)
    sums = np.concatenate([[0], np.cumsum(failed)])
    while at < n:
        # the run goes on from the streak before, if rows from here on start with failures
        lead = int(np.searchsorted(last_ok, at, side="left"))  # first place with an ok at or after at
        breach = n
        if streak and at + most - streak - 1 < lead:
            breach = at + most - streak - 1
        else:
            k = int(np.searchsorted(full, at + most - 1, side="left"))
            if k < len(full):
                breach = int(full[k])
        end = min(breach + 1, n)
        bad = int(sums[end] - sums[at])
        errors, ok = errors + bad, ok + end - at - bad
        if breach >= n:
            tail = int(n - 1 - last_ok[n - 1]) if last_ok[n - 1] >= at else streak + n - at
            return ok, errors, skipped, opened, tail, 0
        opened += 1
        until, streak = int(times[breach]) + cool_down, 0
        again = int(np.searchsorted(times, until, side="left"))
        skipped += max(again - end, 0)
        at = max(again, end)
        if at < n:
            until = 0
    return ok, errors, skipped, opened, streak, until


class Breakers(Buckets):
    """Per key: counts of ok, failed and skipped rows and of openings. Times are microseconds.

    A timer closes open breakers when the watermark passes the end of their cool-down, so that their states say so without a new
    row; it also drops the states of keys without rows for idle (0: never), which then start anew.
    """

    #: ok, errors, skipped, opened, streak, until, last, seq
    width = 8

    def __init__(self, most: int, cool_down: int, idle: int = 0) -> None:
        self.most, self.cool_down, self.idle = most, cool_down, idle

    def _rows(self, keys: list[str], numbers: np.ndarray, expired: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key__": keys, **{c: numbers[:, k] for k, c in enumerate(COUNTERS)}, "open": numbers[:, 5] != 0, "expired": expired, "seq": numbers[:, 7]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        times, n, failed = column(parts, "micros", np.int64), column(parts, "n", np.int64), column(parts, "failed", bool)
        keys, numbers, place, _ = self.merged(column(parts, "key__", object))
        touched = []
        for k, own in by_key(place, times, n):
            before = numbers[k].tolist()
            *counts, streak, until = walk(times[own], failed[own], before[4], before[5], self.most, self.cool_down)
            numbers[k] = (*(a + b for a, b in zip(before[:4], counts, strict=True)), streak, until, max(before[6], int(times[own[-1]])), before[7] + 1)
            touched.append(k)
        self.store(keys, numbers)
        self._alarm(numbers)
        yield self._rows([keys[k] for k in touched], numbers[touched], np.zeros(len(touched), dtype=bool))

    def _alarm(self, numbers: np.ndarray) -> None:
        ends = numbers[numbers[:, 5] != 0, 5]
        self.alarm(np.concatenate([ends, numbers[:, 6] + self.idle]) if self.idle else ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        keys, numbers = self.load()
        over = (numbers[:, 5] != 0) & (numbers[:, 5] // 1000 + 1 <= now)
        gone = (numbers[:, 6] + self.idle) // 1000 + 1 <= now if self.idle else np.zeros(len(keys), dtype=bool)
        numbers[over, 4:6] = 0
        told = np.flatnonzero(over | gone)
        numbers[told, 7] += 1
        self.store([k for k, g in zip(keys, gone, strict=True) if not g], numbers[~gone])
        self._alarm(numbers[~gone])
        if len(told):
            yield self._rows([keys[k] for k in told], numbers[told], gone[told])


def breaker_stream(rows: DataFrame, key: str, time: str, number: str, failed: Column, *, most: int, cool_down: int, idle: int = 0, late: str = "0 seconds", root: str | None = None) -> DataFrame:
    """The last state of each key of a stream after all that there is now; see Breakers.

    rows: a stream; failed: a Column (null counts as ok). Rows of a micro-batch are taken in order of time and number; a later
    batch goes on from the state before. Rows later than the watermark are dropped. cool_down and idle are microseconds. A root
    that is given again goes on from its checkpoint.
    """
    slim = rows.withWatermark(time, late).select(key, F.unix_micros(time).alias("micros"), F.col(number).cast("bigint").alias("n"), F.coalesce(failed, F.lit(False)).alias("failed"), time)
    return latest_states(slim, Breakers(most, cool_down, idle), SCHEMA, key=key, time_mode="EventTime", root=root)
