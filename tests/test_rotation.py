"""Rotation and filling of a list against the rules as loops."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import choose
from gleanery.operators.rotation import discover, kind_targets, priority_quota, rotate

LISTED = "kind string, {} string, pos int, id string, title string"


def test_quotas():
    assert [priority_quota(n, 3) for n in (-1, 0, 2, 3, 5, 6, 100)] == [0, 0, 1, 1, 2, 3, 3]
    assert [priority_quota(1, 3, c) for c in range(5)] == [1, 1, 1, 0, 1] and priority_quota(9, 0) == 0
    assert kind_targets(10, 20) == {"series": 2, "single": 8} and kind_targets(1, 20) == {"series": 1, "single": 0}
    assert kind_targets(1, 20, series_kept=2) == {"series": 0, "single": 1} and kind_targets(1, 20, series_kept=2, others_kept=1) == {"series": 1, "single": 0}
    assert kind_targets(1, 1) == {"series": 0, "single": 1} and kind_targets(0, 9) == {"series": 0, "single": 0}
    assert kind_targets(13, 20, series=False) == {"series": 0, "single": 13} and kind_targets(13, 20, others=False) == {"series": 13, "single": 0}
    assert kind_targets(13, 20, most_series=4, series_kept=3) == {"series": 1, "single": 12}


def plain_discover(focus, general, targets, strata, catalogs, cursor, seen):
    """Walks over whole lists, picking whatever may be picked."""
    ids, titles, out = set(seen["id"]), set(seen["title"]), {k: [] for k in targets}
    listed = lambda rows, kind, name: [r for r in rows if r[0] == kind and r[1] == name and r[3] is not None]

    def pick(kind, row, stratum):
        if row[3] in ids or (row[4] is not None and row[4] in titles):
            return False
        ids.add(row[3])
        titles.add(row[4])
        out[kind].append((row[3], kind, stratum))
        return True

    order = lambda rows: sorted(rows, key=lambda r: (r[2], r[3], r[4] is not None, r[4] or ""))
    picks = []
    for kind, target in targets.items():
        quota = priority_quota(target, len(strata), cursor)
        for g in range(len(strata)):
            if len(out[kind]) >= quota:
                break
            name = strata[(cursor + g) % len(strata)]
            for row in order(listed(focus, kind, name)):
                if pick(kind, row, name):
                    break
    picks = [x for kind in targets for x in out[kind]]
    for kind, target in targets.items():
        need = target - len(out[kind])
        if need <= 0:
            continue
        cap = need if need <= 3 else max(2, -(-need // 6))
        asked = len(catalogs) if need <= 3 else min(len(catalogs), max(10, -(-need // cap) + 4))
        spare, before = [], len(out[kind])
        for k in range(asked):
            if len(out[kind]) >= target:
                break
            here = 0
            for row in order(listed(general, kind, catalogs[(cursor + k) % len(catalogs)])):
                if here < cap and len(out[kind]) < target:
                    here += pick(kind, row, None)
                else:
                    spare.append(row)
        for row in spare:
            if len(out[kind]) < target:
                pick(kind, row, None)
        picks += out[kind][before:]
    return picks


def candidates(rng, n, names, column):
    return [(rng.choice(["series", "single", "single"]), rng.choice(names), rng.randrange(30), rng.choice([None, *(f"p{rng.randrange(n // 2)}" for _ in range(9))]), rng.choice([None, f"title {rng.randrange(n // 3)}"])) for _ in range(n)]


@pytest.mark.parametrize("case", range(5))
def test_discovery_is_the_walk(spark, case):
    rng = random.Random(case)
    strata, catalogs = ["s1", "s2", "s3", "s4"], [f"c{k}" for k in range(14)]
    n = (40, 400, 900, 60, 300)[case]
    focus, general = candidates(rng, n // 2, [*strata, "other"], "stratum"), candidates(rng, n, [*catalogs, "other"], "catalog")
    seen = {"id": [f"p{k}" for k in range(0, n, 5)], "title": [f"title {k}" for k in range(0, n, 7)]}
    targets = kind_targets((3, 30, 200, 1, 45)[case], 200)
    tables = [spark.createDataFrame(focus, LISTED.format("stratum")).repartition(3), spark.createDataFrame(general, LISTED.format("catalog")).repartition(3)]
    known = spark.createDataFrame([(k, v) for k, vs in seen.items() for v in vs], "kind string, value string")
    got = discover(*tables, targets, strata, catalogs, cursor=case * 3, seen=known)
    assert [(r["id"], r["kind"], r["stratum"]) for r in got] == plain_discover(focus, general, targets, strata, catalogs, case * 3, seen)


def test_discovery_fetches_more_where_rows_are_used_up(spark):
    """The first 500 rows of a catalog have one title; the batch needs those behind them."""
    rows = [("single", "c", k, f"p{k:04d}", "same" if k < 500 else f"t{k}") for k in range(700)]
    general = spark.createDataFrame(rows, LISTED.format("catalog"))
    got = discover(spark.createDataFrame([], LISTED.format("stratum")), general, {"single": 3}, [], ["c"])
    assert [r["id"] for r in got] == ["p0000", "p0500", "p0501"]


@pytest.mark.parametrize("replace_all", [False, True])
def test_rotation_is_the_walk(spark, replace_all):
    rng = random.Random(31 + replace_all)
    rows = [(k, f"c{rng.randrange(40)}", rng.choice(["series", "single"]), rng.choice([None, f"title {rng.randrange(25)}"]), rng.choice([None, None, 1, 2]), rng.random() < 0.15) for k in range(120)]
    seen = {"id": {f"c{k}" for k in range(0, 40, 4)}, "key": {f"c{k}:1" for k in range(0, 40, 3)}, "title": {f"title {k}" for k in range(0, 25, 6)}}
    resumed = [("c1", "one"), ("c999", "late"), ("c998", None), ("c999", "again"), (None, "x")]
    general = candidates(rng, 300, ["a", "b", "c"], "catalog")
    keys, ids, titles, kept, removed = set(), set(), set(), [], {}
    for k, i, kind, title, major, keep in rows:
        key = i if major is None else f"{i}:{major}"
        again = key in keys or (major is None and (i in ids or (title is not None and title in titles)))
        known = replace_all or key in seen["key"] or (major is None and (i in seen["id"] or title in seen["title"]))
        if again or (known and not keep):
            removed[k] = "seen" if known and not keep else "duplicate"
            continue
        keys.add(key)
        if major is None:
            ids.add(i)
            if title is not None:
                titles.add(title)
        kept.append((k, i, "series" if keep else kind, title))
    back = [(i, t) for i, t in (("c1", "one"), ("c998", None), ("c999", "again")) if i not in {x[1] for x in kept}]
    needed = 100 - len(kept) - len(back)
    targets = kind_targets(needed, 100, series_kept=len({x[1] for x in kept if rows[x[0]][2] == "series"}) + len(back), others_kept=sum(rows[x[0]][2] != "series" for x in kept))
    taken = {"id": seen["id"] | {x[1] for x in kept} | {i for i, _ in back}, "title": seen["title"] | {x[3] for x in kept}}
    added = plain_discover([], general, targets, [], ["a", "b", "c"], 2, taken)
    current = spark.createDataFrame(rows, "ord int, id string, kind string, title string, major int, urgent boolean").repartition(4)
    known = spark.createDataFrame([(k, v) for k, vs in seen.items() for v in vs], "kind string, value string")
    out, gone = rotate(
        current, known, spark.createDataFrame([], LISTED.format("stratum")), spark.createDataFrame(general, LISTED.format("catalog")), size=100, strata=[], catalogs=["a", "b", "c"],
        protected=F.col("urgent"), cursor=2, replace_all=replace_all, resumed=spark.createDataFrame(resumed, "id string, title string"),
    )
    got = [(r["action"], r["id"], r["kind"]) for r in sorted(out.collect(), key=lambda r: r["place"])]
    assert got == [("resumed", i, "series") for i, _ in back] + [("kept", i, kind) for _, i, kind, _ in kept] + [("added", i, kind) for i, kind, _ in added]
    assert {r["ord"]: r["reason"] for r in gone.collect()} == removed


def test_tiers_keep_the_first_place(spark):
    rng = random.Random(3)
    tiers = [[(rng.choice([None, *range(12)]), rng.randrange(50), f"{n}") for _ in range(14)] for n in range(6)]
    want = {}
    for n, rows in enumerate(tiers, 1):
        for k, o, label in sorted(rows, key=lambda r: (r[1], r[2])):
            if k is not None:
                want.setdefault(k, (n, o, label))
    tables = [spark.createDataFrame(rows, "k int, o int, label string") for rows in tiers]
    assert {r["k"]: (r["tier"], r["o"], r["label"]) for r in choose.priority_union(tables, "k", "o", ["label"]).collect()} == want
