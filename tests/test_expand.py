"""Expansion of requests against the rules as a loop over requests in order."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gleanery.operators.expand import expand_requests

NOW = datetime.datetime(2026, 3, 1)
REQUEST = "ord int, entity string, kind string, major int, minor int, label string"
ENTITY = "entity string, kind string, name string, year int, year_end int"
MEMBER = "entity string, major int, minor int, title string, released timestamp_ntz, pos int"


def label_of(show, major, minor, title):
    return f"{show} S{major:02d}E{minor:02d}" + (f" – {title}" if title is not None else "")


def plain(requests, entities, members, fallback, done, most=None, focus=None, single=False):
    known, gone = {e[0]: e for e in entities}, set(done)

    def out(rows, entity):
        found = {}
        for e, major, minor, title, released, _ in sorted(rows, key=lambda m: m[5]):
            if e == entity and (released is None or released <= NOW + datetime.timedelta(days=1)):
                found.setdefault((major, minor), title)
        return found

    fixed, expanded, warnings = [], [], []
    for ord_, entity, kind, major, minor, label in sorted(requests, key=lambda r: r[0]):
        meta = known.get(entity)
        is_, name, year, end = (meta[1], meta[2], meta[3], meta[4]) if meta else (None,) * 4
        named = None if name is None else name + (f" ({year})" if year is not None else "")
        if kind == "group" and is_ == "single":
            warnings.append(("type_conflict", entity, named or entity, ord_))
            continue
        whole = major is None if kind == "group" else is_ == "group"
        if not whole and kind != "group":
            y = int(label[-5:-1]) if label and label.endswith(")") else None
            if y is not None and year is not None and not year - 1 <= y <= (year if end is None else end) + 1:
                warnings.append(("label_mismatch", entity, named or entity, ord_))
            fixed.append(("single", entity, None, None, label if label is not None else named, ord_))
            continue
        show = label.split(" (")[0].split(" S0")[0] if label else None
        show = show or name or entity
        if not whole and minor is not None:
            title = out(members, entity).get((major, minor))
            fixed.append(("group", entity, major, minor, label if label is not None else label_of(show, major, minor, title), ord_))
            continue
        asked = lambda rows: {k: t for k, t in out(rows, entity).items() if (k[0] >= 1 if whole else k[0] == major)}
        found = asked(members) or asked(fallback)
        left = {k: t for k, t in found.items() if (entity, *k) not in gone}
        if not found:
            warnings.append(("no_members", entity, "not known" if is_ is None else "none available", ord_))
        elif not left:
            warnings.append(("all_done", entity, named or entity, ord_))
        elif whole and kind != "group" and len(left) == len(found):
            warnings.append(("expanded", entity, f"{len({k[0] for k in left})} majors, {len(left)} members", ord_))
        expanded += [("group", entity, *k, label_of(show, *k, t), ord_) for k, t in sorted(left.items())]
    queues = {}
    for row in expanded:
        queues.setdefault(row[1], []).append(row)
    if focus is not None or single:
        kept = (queues.get(focus) or next(iter(queues.values()), []))[:most]
    elif most is None:
        kept = expanded
    else:
        kept, turn = [], 0
        while len(kept) < min(most, len(expanded)):
            for q in queues.values():
                if turn < len(q) and len(kept) < most:
                    kept.append(q[turn])
            turn += 1
    before, after = Counter((r[5], r[1]) for r in expanded), Counter(r[5] for r in kept)
    warnings += [("capped", e, f"{n - after[o]} of {n}", o) for (o, e), n in before.items() if n > after[o]]
    once = {}
    for row in sorted([*fixed, *kept], key=lambda r: r[5]):
        have = once.setdefault(row[:4], list(row[4:]))
        if (have[0] in (None, "", row[1])) and row[4] not in (None, "", row[1]):
            have[0] = row[4]
    return sorted(((*k, *v) for k, v in once.items()), key=str), sorted(warnings)


def made(seed):
    rng = random.Random(seed)
    ids = [f"tt{1000000 + k}" for k in range(24)]
    entities = [(e, rng.choice(["group", "group", "single"]), rng.choice([None, f"Name {e}"]), rng.choice([None, 1990 + k % 9]), rng.choice([None, None, 1999])) for k, e in enumerate(ids) if k % 5]
    date = lambda: rng.choice([None, datetime.datetime(2026, 1, 1), NOW + datetime.timedelta(hours=20), datetime.datetime(2027, 1, 1)])
    some = lambda n, of: [(rng.choice(of), rng.randrange(0, 4), rng.randrange(1, 4), rng.choice([None, "t", "u"]), date(), k) for k in range(n)]
    members, fallback = some(140, ids[:18]), some(60, ids[10:])
    done = [(e, a, b) for e, a, b, *_ in members if rng.random() < 0.4] + [(e, a, b) for e, a, b, *_ in fallback if rng.random() < 0.3]
    requests = []
    for o in range(60):
        kind, major = rng.choice(["group", "group", "single"]), rng.choice([None, 0, 1, 2, 3])
        e = rng.choice(ids)
        label = rng.choice([None, None, f"Own {e[2:]}a", f"Own {e[2:]}a S02E01", f"Own {e[2:]}a ({rng.choice([1991, 1996, 2020])})", e, ""])
        requests.append((o, e, kind, *((None, None) if kind == "single" else (major, rng.choice([None, 1, 2]) if major is not None else None)), label))
    return requests, entities, members, fallback, done


@pytest.mark.parametrize("limits", [{}, {"most": 5}, {"most": 17}, {"most": 10_000}, {"focus": "tt1000001"}, {"focus": "nothing", "most": 4}, {"single": True}, {"most": 0}])
def test_expansion_is_the_loop(spark, limits):
    requests, entities, members, fallback, done = made(len(str(limits)))
    rng = random.Random(1)
    tables = [spark.createDataFrame(rng.sample(rows, len(rows)), s).repartition(3) for rows, s in ((requests, REQUEST), (entities, ENTITY), (members, MEMBER), (fallback, MEMBER), (done, "entity string, major int, minor int"))]
    seen = Observation("expansion")
    got, warned = expand_requests(*tables[:3], now=F.lit(NOW).cast("timestamp_ntz"), fallback=tables[3], done=tables[4], observation=seen, **limits)
    want, warnings = plain(requests, entities, members, fallback, done, **limits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sorted((r["reason"], r["entity"], r["detail"], r["ord"]) for r in warned.collect()) == warnings
    counts = Counter(w[0] for w in warnings)
    assert seen.get == {"members": len(want), **{r: counts[r] for r in ("type_conflict", "no_members", "all_done", "expanded", "label_mismatch", "capped")}}


def test_nothing_to_expand(spark):
    empty = [spark.createDataFrame([], s) for s in (REQUEST, ENTITY, MEMBER)]
    got, warned = expand_requests(*empty, now=F.lit(NOW).cast("timestamp_ntz"))
    assert got.count() == warned.count() == 0
    asked = spark.createDataFrame([(1, None, "group", None, None, None), (2, "tt1", "group", None, None, None), (3, "tt2", None, None, None, None)], REQUEST)
    got, warned = expand_requests(asked, *empty[1:], now=F.lit(NOW).cast("timestamp_ntz"))
    assert [tuple(r) for r in warned.collect()] == [("expand", "tt1", "no_members", "not known", 2)]
    assert [r["entity"] for r in got.collect()] == ["tt2"]
