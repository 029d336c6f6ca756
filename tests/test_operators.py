"""Order-sensitive operators against plain Python, small fixtures for sinks and sources."""

import random

from pyspark.sql import functions as F

from gleanery.functions import rules as R
from gleanery.operators import choose, merge, streaks
from gleanery.operators.components import connected_components
from gleanery.operators.rank import ranked
from gleanery.sources import tables


def test_survivorship_is_the_fold(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), i, rng.choice([None, *range(6)]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, ord int, rnk int, quality string, idx int").repartition(7)
    got = {r["k"]: (r["rnk"], r["ord"], r["quality"], r["idx"]) for r in merge.survivorship_merge(df, ["k"], [F.col("ord")], "rnk", ["ord"], ["quality"], ["idx"]).collect()}
    want = {}
    for k, ord_, rnk, quality, idx in rows:
        if k not in want:
            want[k] = [rnk, ord_, quality, idx]
            continue
        state = want[k]
        if (-1 if rnk is None else rnk) > (-1 if state[0] is None else state[0]):
            state[0], state[1] = rnk, ord_
            state[2] = quality if quality is not None else state[2]
        state[2] = quality if state[2] is None else state[2]
        state[3] = idx if state[3] is None else state[3]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == {k: tuple(v) for k, v in want.items()}


def test_greedy_unique_is_the_walk(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(25), rng.randrange(25)) for i in range(300)]
    a, b, want = set(), set(), []
    for i, x, y in rows:
        if x not in a and y not in b:
            a.add(x), b.add(y), want.append(i)
    df = spark.createDataFrame(rows, "i int, x int, y int").repartition(5)
    assert sorted(r["i"] for r in choose.greedy_unique(df, ["x", "y"], [F.col("i")]).collect()) == want


def walked(rows):
    used, out = [set(), set(), set()], []
    for i, *keys in rows:
        if not any(k is not None and k in u for k, u in zip(keys, used, strict=False)):
            out.append(i)
            for k, u in zip(keys, used, strict=False):
                u.add(k)
    return out


def test_greedy_unique_walks_long_chains(spark):
    """10,000 rows of which each shares a key with the next one, in an order that no round decides, and others beside them."""
    rng = random.Random(16)
    chain = [(i, f"x{(i + 1) // 2}", f"y{i // 2}", None) for i in range(10_000)]
    others = [(10_000 + i, rng.choice([None, f"a{rng.randrange(40)}"]), rng.choice([None, f"b{rng.randrange(40)}"]), rng.choice([None, f"c{rng.randrange(90)}"])) for i in range(400)]
    rows = [*chain, *others, (20_000, None, None, None), (20_001, None, None, None)]
    df = spark.createDataFrame(rows, "i int, x string, y string, z string").repartition(5)
    assert sorted(r["i"] for r in choose.greedy_unique(df, ["x", "y", "z"], [F.col("i")]).collect()) == walked(rows)
    assert choose.greedy_unique(df.limit(0), ["x", "y"], [F.col("i")]).count() == 0


def test_components_are_those_of_the_graph(spark):
    rng = random.Random(18)
    edges = [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 6), (7, None)]
    rng.shuffle(edges)
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            leader[high] = low
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int").repartition(4), "a", "b").collect()}
    assert got == {x: find(x) for x in leader}


def test_ranks_are_places(spark):
    rng = random.Random(19)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, i int").repartition(7)
    got = [(r["a"], r["i"]) for r in sorted(ranked(df, [F.desc_nulls_last("a"), F.asc("i")]).collect(), key=lambda r: r["place"])]
    assert got == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(r["place"] for r in ranked(df, [F.col("i")]).collect()) == list(range(1, 701))
    assert ranked(df.limit(0), [F.col("i")]).count() == 0


def test_failure_streaks_are_the_loop(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(20), i, rng.random() < 0.5) for i in range(600)]
    state, want = {}, {}
    for k, i, bad in rows:
        streak, open_ = state.get(k, (0, False))
        want[i] = open_
        streak = streak + 1 if bad else 0
        state[k] = (streak, open_ or streak >= 3)
    df = spark.createDataFrame(rows, "k int, i int, bad boolean").repartition(6)
    assert {r["i"]: r["skipped"] for r in streaks.failure_streaks(df, ["k"], [F.col("i")], F.col("bad"), 3).collect()} == want


def test_breaker_streaks_are_the_loop(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(12), rng.randrange(3), i, rng.choice(["ok", "error", "limited", "limited", "limited", None])) for i in range(900)]
    errors, open_, strikes, want = {}, set(), {}, {}
    for s, k, i, x in rows:
        want[i] = (s, k) in open_
        if want[i]:
            continue
        if x == "error":
            errors[s, k] = errors.get((s, k), 0) + 1
            if errors[s, k] >= 2:
                open_.add((s, k))
        elif x == "limited":
            strikes[s] = strikes.get(s, 0) + 1
            if strikes[s] >= 6:
                open_.add((s, k))
        else:
            errors[s, k] = strikes[s] = 0
    df = spark.createDataFrame(rows, "s int, k int, i int, x string").repartition(6)
    assert {r["i"]: r["skipped"] for r in streaks.breaker_streaks(df, "s", "k", [F.col("i")], "x", 2).collect()} == want
    assert streaks.breaker_streaks(df.limit(0), "s", "k", [F.col("i")], "x", 2).count() == 0


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, s string, n int")
    new = spark.createDataFrame([(1, None, 7), (3, "c", 1)], "k int, s string, n int")
    assert sorted(map(tuple, merge.upsert(old, new, "k").collect())) == [(1, "a", 7, "updated"), (2, "b", None, "kept"), (3, "c", 1, "inserted")]


def test_publish_swaps_at_the_end(spark, tmp_path):
    root = str(tmp_path / "pub")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n int")
    tables.publish(df, root, "v1", "kind")
    tables.publish(df.filter("n = 2"), root, "v2", "kind")
    assert [tuple(r) for r in tables.current(spark, root, "n int, kind string").collect()] == [(2, "b")]


def test_snapshot_and_csv(spark, tmp_path):
    path = tmp_path / "docs"
    path.mkdir()
    (path / "a.json").write_text('{"id": "a",\n "rows": [{"x": 1}, {"x": 2}]}')
    index = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r["id"]: len(r["rows"]) for r in tables.read_snapshot(spark, index, str(path), "id", "id string, rows array<struct<x:int>>", "rows").collect()}
    assert got == {"a": 2, "b": 0}
    tables.write_csv(spark.createDataFrame([("=1+1", 'say "x"')], "a string, b string").coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert "'=1+1" in text and '"say ""x"""' in text


def test_sizes_and_keys(spark):
    row = spark.sql("select '1,5 GB' a, '700MiB' b, 'none' c, concat('  ', upper(sha1('x'))) k, repeat('0', 40) z").select(R.size_bytes(F.col("a")), R.size_bytes(F.col("b")), R.size_bytes(F.col("c")), R.valid_key(F.col("k")), R.valid_key(F.col("z"))).first()
    assert row[0] == int(1.5 * 1024**3) and row[1] == 700 * 1024**2 and row[2] is None and len(row[3]) == 40 and row[4] is None


def test_upsert_takes_the_first_valid_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "c", 1), (3, "d", 2), (4, None, 1), (None, "e", 1)], "k int, s string, ord int")
    merged, rejected = merge.upsert_checked(old, new, "k", F.col("k").isNotNull() & F.col("s").isNotNull(), [F.col("ord")])
    assert sorted(map(tuple, merged.collect())) == [(1, "y", "updated"), (2, "b", "kept"), (3, "c", "inserted")]
    assert sorted((r["s"] or "", r["reason"]) for r in rejected.collect()) == [("", "invalid"), ("d", "duplicate"), ("e", "invalid"), ("x", "duplicate")]


def test_sizes_and_targets(spark):
    rows = [("700 B",), ("1,5 KB",), ("2MiB x",), ("9 boxes",), ("nothing",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(R.size_bytes(F.col("t"))).collect()]
    assert got == [700, 1536, 2 << 20, None, None]
    texts = [("tt0123456",), (" tt0123456 label",), ("tt0123456:2:11",), ("https://a.b/title/tt0123456/?x",), ("xtt0123456",), ("",), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(texts, "t string").coalesce(1).select(R.target(F.col("t"))).collect()]
    assert got == [("tt0123456", None, None, None), ("tt0123456", None, None, "label"), ("tt0123456", 2, 11, None), ("tt0123456", None, None, None)] + [(None,) * 4] * 3
    texts = [("TT0123456:S2:e11 A  name ",), ("tt0123456:s2",), ("tt0123456:s2x",), ("tt012345",), ("http://x/tt0123456#a",)]
    got = [tuple(r[0]) for r in spark.createDataFrame(texts, "t string").coalesce(1).select(R.target(F.col("t"))).collect()]
    assert got == [("tt0123456", 2, 11, "A  name"), ("tt0123456", 2, None, None), (None,) * 4, (None,) * 4, ("tt0123456", None, None, None)]
    sizes = [(None,), (0,), (512,), (1536,), (100 << 20,), (102350,), (1 << 50,)]
    assert [r[0] for r in spark.createDataFrame(sizes, "n bigint").coalesce(1).select(R.size_text(F.col("n"))).collect()] == [None, None, "512 B", "1.5 KB", "100 MB", "100.0 KB", "1024 TB"]


def test_publishing_again_moves_the_pointer(spark, tmp_path):
    root = str(tmp_path / "out")
    for version in ("v2", "v1"):
        tables.publish(spark.createDataFrame([("a", version)], "k string, v string"), root, version, "k")
        assert [r["v"] for r in tables.current(spark, root, "v string, k string").collect()] == [version]


def test_the_pointer_does_not_follow_the_clock(spark, tmp_path):
    """A publisher whose clock is ahead does not hold back those after it; two projections of the same rows go out together."""
    root = str(tmp_path / "out")
    assert tables.current(spark, root, "v string, k string").count() == 0
    df = spark.createDataFrame([("a", "old", 1)], "k string, v string, secret int")
    tables.publish(df, root, "v1", "k")
    ahead = spark.createDataFrame([("v1", 1, 2**60)], tables.POINTER)
    ahead.coalesce(1).write.mode("append").json(f"{root}/CURRENT")
    tables.publish(df.withColumn("v", F.lit("new")), root, "v2", "k", {"full": ["k", "v", "secret"], "public": ["k", "v"]})
    assert [tuple(r) for r in tables.current(spark, root, "v string, secret int, k string", "full").collect()] == [("new", 1, "a")]
    assert [tuple(r) for r in tables.current(spark, root, "v string, secret int, k string", "public").collect()] == [("new", None, "a")]


def test_fitting_keeps_the_target_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert tables.fitting(df, df.select("c", "a")).columns == ["a", "c"]


def test_titles_are_folded_in_any_script(spark):
    """Against unicodedata: ligatures, full width, marks of several kinds, tags and years; ASCII does not go to Python."""
    import re
    import unicodedata

    from gleanery.functions import titles

    def plain(text):
        if text is None:
            return None
        t = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text))
        t = re.sub(titles.YEARS, " ", t)
        t = re.sub(titles.TAG.replace(r"\b", titles._EDGE), " ", t, count=1)
        t = re.sub("[^a-z0-9]+", " ", t.lower()).strip()
        return t if t and not re.fullmatch("tt[0-9]{7,10}", t) else None

    rng = random.Random(23)
    parts = ["Ábc", "\ufb01n", "\uff21\uff22", "e\u0301", "\u01d6", "\u2460", "\u212b", "x", "S01E02", "s3", "Season 2", "1x02", "(1999)", "( 2001 \u2013 2004 )", "\u00df", "\u0416", " ", "-", "tt1234567", "\u1e69", "Temporada 4"]
    texts = [None, "", "tt1234567", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 7))) for _ in range(800))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: (r["k"], r["w"]) for r in df.select("i", titles.title_key(F.col("t")).alias("k"), titles.significant_words(F.col("t"), ["fin"]).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == plain(t), t
        if t is not None:
            words = re.findall("[a-z0-9]+", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t)).lower())
            assert got[i][1] == [w for w in dict.fromkeys(words) if re.fullmatch("[a-z]{3,}", w) and w != "fin"], t


def test_states_and_their_gate(spark):
    import pytest

    from gleanery.operators import checks

    rows = [(1, True, True, 5, "error"), (0, True, True, 5, "skipped"), (None, None, True, 5, "saved"), (0, False, True, 0, "empty"), (0, False, None, 5, "unknown"), (0, False, True, None, "unknown"), (0, False, True, -1, "unknown")]
    df = spark.createDataFrame(rows, "failures int, skipped boolean, confirmed boolean, saved int, want string").withColumn("state", checks.write_state(*(F.col(c) for c in ("failures", "skipped", "confirmed", "saved"))))
    assert df.filter("state <> want or state is null").count() == 0
    checks.gate(df.filter("state not in ('error', 'unknown')"))
    with pytest.raises(RuntimeError, match="error 1, unknown 3"):
        checks.gate(df)


def test_seen_keys_are_skipped_before_repeats(spark):
    delta = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (3, 5), (None, 6)], "k int, ord int")
    seen = spark.createDataFrame([(3,), (3,), (None,)], "k int")
    got = {r["ord"]: r["reason"] for r in merge.prepared(delta, "k", F.col("k").isNotNull(), [F.col("ord")], seen).collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "seen", 5: "seen", 6: "invalid"}


def test_metadata_of_odd_records(spark):
    from gleanery.functions import metadata

    video = "array<struct<season:string,episode:string,number:string,name:string,title:string,released:string,first:string>>"
    v = ("1", None, "2", " Pilot ", "x", None, "2020")
    rows = [("a", "group", None, "One", "2008–2013", [v, ("x", "1", None, None, None, None, None), ("1", "0", None, None, None, None, None)]), ("b", "odd", "group", " Two ", "2011–", None), ("c", None, "single", "Three", "1999", [v]), ("d", "single", None, " ", "1999", None), ("e", None, None, "Five", None, [])]
    df = spark.createDataFrame(rows, f"id string, kind string, requested string, name string, year string, videos {video}")
    got = {r["id"]: (r["kind"], r["name"], r["year"], r["year_end"], None if r["members"] is None else [tuple(m) for m in r["members"]]) for r in metadata.metadata_records(df).collect()}
    assert got == {"a": ("group", "One", 2008, 2013, [(1, 2, "Pilot", "2020")]), "b": ("group", "Two", 2011, None, None), "c": ("single", "Three", 1999, 1999, None), "e": (None, "Five", None, None, None)}


def test_state_is_made_sound(spark):
    from gleanery.operators.state import sound_pointer, sound_state

    names = ["entity", "name", "status", "done", "total", "last_major", "last_minor", "next_major", "next_minor", "updated_at"]
    row = lambda e, status, at, **more: tuple({"entity": e, "status": status, "updated_at": at, **more}.get(n) for n in names)
    rows = [row(" TT1 ", "complete", "2020", done="3"), row("tt2", "odd", None, done="x", total="-1", last_major="2.0"), row("tt3", "complete", None), row("tt4", "complete", "2021", name="n"), row("tt4", "in", "2019"), row("", "open", "2022"), row(None, "open", "2022")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r["entity"]: (r["name"], r["status"], r["done"], r["total"], r["last_major"]) for r in sound_state(df, keep_complete=2).collect()}
    assert got == {"tt1": ("tt1", "complete", 3, 0, None), "tt2": ("tt2", "open", 0, -1, None), "tt4": ("n", "complete", 0, 0, None)}
    state = sound_state(df)
    assert [sound_pointer(state, p) for p in (" TT2", "tt4", "tt9", "", None)] == ["tt2", None, "tt9", None, None]
    assert sound_state(df.limit(0)).count() == 0
