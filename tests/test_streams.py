"""Streams with state against loops, over several batches and restarts."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.session import instants
from gleanery.streaming import streams
from gleanery.streaming.breakers import breaker_stream, walk
from gleanery.streaming.first_wins import admitted, first_wins
from gleanery.streaming.upserts import UpsertTable, upsert_stream

SECOND = 1_000_000
START = datetime.datetime(2026, 1, 1)


def plain_walk(rows, streak, until, most, cool_down):
    ok = errors = skipped = opened = 0
    for time, bad in rows:
        if until and time < until:
            skipped += 1
            continue
        if until:
            streak, until = 0, 0
        if not bad:
            ok, streak = ok + 1, 0
            continue
        errors, streak = errors + 1, streak + 1
        if streak >= most:
            opened, streak, until = opened + 1, 0, time + cool_down
    return ok, errors, skipped, opened, streak, until


def test_walk_is_the_loop():
    rng = random.Random(17)
    for _ in range(6000):
        n, most, cool = rng.randrange(1, 30), rng.randrange(1, 5), rng.choice([0, 1, 5, 20])
        times = sorted(rng.randrange(1, 60) for _ in range(n))
        bad = [rng.random() < rng.choice([0.3, 0.8]) for _ in range(n)]
        cut = rng.randrange(n + 1)
        state, total = (0, 0), np.zeros(4, dtype=int)
        for lo, hi in ((0, cut), (cut, n)):  # two batches
            if hi > lo:
                got = walk(np.array(times[lo:hi]), np.array(bad[lo:hi]), *state, most, cool)
                assert tuple(map(int, got)) == plain_walk(list(zip(times[lo:hi], bad[lo:hi], strict=True)), *state, most, cool)
                state, total = got[4:], total + np.array(got[:4])
        assert (*total, *state) == plain_walk(list(zip(times, bad, strict=True)), 0, 0, most, cool)


def files(spark, tmp_path, name, schema):
    """A folder, a function that adds a file of rows to it, and a stream of it, a file at a time."""
    path = str(tmp_path / name)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return instants(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))

    return add, stream


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_a_breaker_opens_cools_down_and_goes_on_after_a_restart(spark, tmp_path):
    add, stream = files(spark, tmp_path, "log", "k string, ts timestamp_ntz, n bigint, bad boolean")
    root = str(tmp_path / "state")

    def run():
        found = breaker_stream(stream(), "k", "ts", "n", F.col("bad"), most=2, cool_down=60 * SECOND, root=root)
        return {r["k"]: tuple(r[c] for c in ("ok", "errors", "skipped", "opened", "open")) for r in found.collect()}

    add([("a", at(0), 1, True), ("b", at(0), 2, True), ("b", at(1), 3, None)])
    add([("a", at(2), 4, True), ("a", at(5), 5, False), ("b", at(3), 6, True)])
    assert run() == {"a": (0, 2, 1, 1, True), "b": (1, 2, 0, 0, False)}
    # after the cool-down it goes through, fails again twice and opens again; b's streak of one goes on
    add([("a", at(61), 7, False), ("a", at(62), 8, True), ("b", at(62), 9, True)])
    assert run() == {"a": (0, 3, 2, 1, False), "b": (1, 3, 0, 1, True)}
    add([("a", at(63), 10, True), ("a", at(64), 11, True), ("a", at(65), 12, True)])
    assert run() == {"a": (0, 4, 4, 2, True), "b": (1, 3, 0, 1, True)}
    # time passes for another key only: timers close both
    add([("c", at(1000), 13, False)])
    assert run() == {"a": (0, 4, 4, 2, False), "b": (1, 3, 0, 1, False), "c": (1, 0, 0, 0, False)}


def test_idle_keys_are_dropped_and_start_anew(spark, tmp_path):
    add, stream = files(spark, tmp_path, "log", "k string, ts timestamp_ntz, n bigint, bad boolean")
    root = str(tmp_path / "state")

    def run():
        found = breaker_stream(stream(), "k", "ts", "n", F.col("bad"), most=3, cool_down=SECOND, idle=100 * SECOND, root=root)
        return {r["k"]: (r["errors"], r["expired"]) for r in found.collect()}

    add([("a", at(0), 1, True), ("a", at(1), 2, True)])
    assert run() == {"a": (2, False)}
    add([("b", at(500), 3, False)])
    assert run() == {"a": (2, True), "b": (0, False)}
    add([("a", at(501), 4, True)])
    assert run()["a"] == (1, False)


def test_first_wins_until_the_state_ends(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(6), at(s), n, f"v{n}") for n, s in enumerate(sorted(rng.randrange(0, 3000) for _ in range(240)))]
    add, stream = files(spark, tmp_path, "rows", "k int, ts timestamp_ntz, n bigint, v string")
    for k in range(4):
        add(rng.sample(rows[60 * k : 60 * k + 60], 60))
    add([(99, at(90_000), 1000, "last")])
    progress = []
    won = first_wins(stream(), ["k"], "ts", "n", within=200 * SECOND, root=str(tmp_path / "state"), progress=progress)
    until, want = {}, ["last"]
    for k, ts, _, v in rows:
        if k not in until or ts >= until[k]:
            until[k] = ts + datetime.timedelta(seconds=200)
            want.append(v)
    assert sorted(r["v"] for r in won.collect()) == sorted(want)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # six keys have state while they last; at the end all but the last one are gone
    assert max(kept) > kept[-1]


def test_admitted_is_the_loop():
    rng = random.Random(6)
    for _ in range(500):
        times, within, until = sorted(rng.randrange(1, 99) for _ in range(rng.randrange(1, 20))), rng.randrange(1, 30), rng.choice([0, 5, 50])
        end, want = until, []
        for n, t in enumerate(times):
            if t >= end:
                want.append(n)
                end = t + within
        assert admitted(np.array(times), until, within) == (want, end)


@pytest.fixture
def upserts(spark, tmp_path):
    add, stream = files(spark, tmp_path, "delta", "k bigint, a string, b int, ord int")
    table = lambda: UpsertTable(spark, str(tmp_path / "table"), "k bigint, a string, b int", "k", buckets=8)
    valid, order = F.col("k").isNotNull() & F.coalesce(F.col("b") >= 0, F.lit(True)), [F.col("ord")]
    return add, stream, table, valid, order


def test_upserts_go_on_after_a_restart(spark, upserts):
    add, stream, table, valid, order = upserts
    add([(1, "x", 1, 1), (1, "y", 2, 0), (2, None, 5, 1), (None, "n", 1, 1), (3, "bad", -1, 1)])
    assert sorted(map(tuple, upsert_stream(stream(), table(), valid, order).rows().collect())) == [(1, "y", 2), (2, None, 5)]
    add([(2, "z", None, 1), (3, "c", 3, 1)])
    add([(1, None, 9, 1)])
    # a new table object over the same folder: the stream goes on from its checkpoint
    out = upsert_stream(stream(), table(), valid, order)
    assert sorted(map(tuple, out.rows().collect())) == [(1, "y", 9), (2, "z", 5), (3, "c", 3)]
    counts = {(r["batch"], r["outcome"]): r["n"] for r in out.counters().collect()}
    assert counts == {(0, "inserted"): 2, (0, "duplicate"): 1, (0, "invalid"): 2, (1, "updated"): 1, (1, "inserted"): 1, (2, "updated"): 1}
    # nothing new: nothing changes
    assert sorted(map(tuple, upsert_stream(stream(), table(), valid, order).rows().collect())) == [(1, "y", 9), (2, "z", 5), (3, "c", 3)]


def test_a_repeated_batch_changes_nothing(spark, upserts):
    _, _, table, valid, order = upserts
    delta = spark.createDataFrame([(1, "x", 1, 1)], "k bigint, a string, b int, ord int")
    assert table().apply(delta, 0, valid, order)
    assert not table().apply(delta.withColumn("a", F.lit("other")), 0, valid, order)
    assert [tuple(r) for r in table().rows().collect()] == [(1, "x", 1)]


def test_a_batch_lost_before_its_manifest_is_written_again(spark, upserts, tmp_path):
    """What a batch wrote counts for nothing until its manifest is there."""
    _, _, table, valid, order = upserts
    first = spark.createDataFrame([(1, "x", 1, 1), (2, "y", 2, 1)], "k bigint, a string, b int, ord int")
    table().apply(first, 0, valid, order)
    (tmp_path / "table" / "state" / "batch=1" / "bucket=0").mkdir(parents=True)  # half a batch
    assert sorted(r["k"] for r in table().rows().collect()) == [1, 2]
    assert table().apply(first.limit(0), 1, valid, order)  # an empty batch
    assert sorted(r["k"] for r in table().rows().collect()) == [1, 2]


def test_only_touched_buckets_are_written(spark, upserts, tmp_path):
    _, _, table, valid, order = upserts
    many = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("a"), F.lit(1).alias("b"), F.lit(1).alias("ord"))
    table().apply(many, 0, valid, order)
    table().apply(many.filter("k = 7").withColumn("b", F.lit(2)), 1, valid, order)
    through, written = table().manifest()
    assert through == 1 and sorted(written.values()) == [0] * 7 + [1]
    assert len(list((tmp_path / "table" / "state" / "batch=1").glob("bucket=*"))) == 1
    assert table().rows().filter("b = 2").count() == 1 and table().rows().count() == 200


def test_slices_come_in_order(spark):
    rows = spark.createDataFrame([(k, k * k) for k in range(10)], "k int, v int")
    assert streams.run(streams.in_slices(rows, "k", 3), "append").count() == 10
    assert streams.run(streams.in_slices(rows.limit(0), "k", 3), "append").count() == 0


def test_a_slice_is_a_batch_of_several_files(spark):
    """The second slice has no rows and the last but one, and all have as many files."""
    rows = spark.createDataFrame([(k, f"v{k}") for k in [*range(20), 89]], "k int, v string")
    seen = []
    stream = streams.in_slices(rows, "k", 3, rows_per_file=2)
    assert stream.columns == ["k", "v"]
    stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["k"] for r in b.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(20)), [], [89]]


def test_states_are_called_for_buckets_of_keys(spark):
    """The number of calls of the state store must not grow with the keys."""
    from gleanery.streaming.stateful import BUCKETS

    rows = spark.range(4000).select("id", F.concat(F.lit("k\n"), F.col("id") % 2000).alias("k"), F.timestamp_seconds(F.col("id") + 86_400).alias("ts"))
    progress = []
    won = first_wins(streams.in_slices(rows, "id", 2), ["k"], "ts", "id", within=10_000 * SECOND, progress=progress)
    assert sorted(r["id"] for r in won.collect()) == list(range(2000))
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= BUCKETS
