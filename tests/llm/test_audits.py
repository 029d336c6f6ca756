"""Centroid clustering, positive-unlabelled quality and the filter audit against plain Python."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from gleanery.llm import centroids, filter_audit, pu_quality  # noqa: E402

VECTORS = "vec_id bigint, embedding array<double>, label int, i bigint, v string, planes string, cluster int, c int"


def plain_clusters(rows, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = [[] for _ in means]
        for _, v in kept:
            own[near(v)[1]].append(v)
        means = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else m for vs, m in zip(own, means, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], means


def test_clusters_by_brute_force(spark):
    """Short, long, null and non-finite vectors, ties, repeated rows, rows without an id, components of many sizes."""
    rng = random.Random(4)
    rows = [(k, [rng.gauss(k % 5, 0.4) for _ in range(64)]) for k in range(150)]
    rows += [(200 + k, [float(k % 3)] * 64) for k in range(9)] + [(300, [1e5] * 64), (301, [-1e5] + [0.0] * 63), (302, [-0.001] * 64), (303, [0.0] * 64)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [None] + [0.5] * 63), (405, [float("nan")] + [0.5] * 63), (406, [float("-inf")] + [0.5] * 63)]
    df = spark.createDataFrame([(i, v, 1, 2, "v", "p", 3, 4) for i, v in rows], VECTORS).repartition(4)
    for k, rounds in ((7, 3), (40, 2), (500, 1)):
        found, means = centroids.centroid_clusters(df, k=k, rounds=rounds)
        want, plain = plain_clusters(rows, k, rounds, 256, 2)
        assert means.tolist() == plain
        got = centroids.with_inertia(found, means).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(want, key=str)
        total = sum(d for _, _, d in want)
        for r in got:
            assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    found, means = centroids.centroid_clusters(none)
    assert centroids.with_inertia(found, means).count() == 0 and len(means) == 0
    one = spark.createDataFrame([(None, [0.5] * 64, 1, 2, "v", "p", 3, 4)], VECTORS)
    found, means = centroids.centroid_clusters(one)
    assert [(r["vec_id"], r["cluster"], r["inertia"]) for r in centroids.with_inertia(found, means).collect()] == [(None, None, None)]


def test_bit_planes():
    rng = np.random.default_rng(3)
    for most in (1, 2, 100, 1 << 20, 1 << 27):
        x, c = rng.integers(-most, most + 1, (60, 64)), rng.integers(-most, most + 1, (5, 64))
        planes, of_c = centroids.packed(x, int(centroids.bits_of(x).max())), centroids.packed(c, int(centroids.bits_of(c).max()))
        assert (centroids.unpacked(planes) == x).all() and (centroids.dots(planes, of_c) == x @ c.T).all()
        assert (centroids.squares(planes) == (x * x).sum(axis=1)).all()
    with pytest.raises(ValueError, match="64 bits"):
        centroids.scaled(__import__("pyarrow").array([[1e30] * 64]), 256)


def made_texts(rng, n):
    """Prose, and junk of three kinds for one in four."""
    out = []
    for k in range(n):
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 90))]
        good = k % 4 != 0
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + " |" for w in words], [w + "$$$" for w in words]])
        out.append((k, " ".join(words), int(good)))
    return out


def test_pu_quality_learns_from_good_texts_alone(spark, docs, rows):
    rng = random.Random(8)
    made = made_texts(rng, 900)
    df = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made if k % 3 and y] + [(1, 1), (None, 1), (5000, 1)], "doc_id bigint, quality int")
    models = pu_quality.fit_quality(df.filter("doc_id % 3 > 0"), labels)
    assert abs(models[0].prior - 0.75) < 0.08
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in pu_quality.score_quality(df.filter("doc_id % 3 = 0"), models).collect()]
    assert sum(right) >= 0.95 * len(right)
    scored = pu_quality.score_quality(docs, models).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    by_text = {}
    texts = dict(rows)
    for r in scored:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_pu_quality_without_labels_or_texts(spark, docs, empty, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id bigint, quality int")
    for models in (pu_quality.fit_quality(docs, labels.limit(0)), pu_quality.fit_quality(empty, labels)):
        assert {r["score"] for r in pu_quality.score_quality(docs, models).collect()} == {0.5}
    assert pu_quality.score_quality(empty, models).count() == 0
    few = pu_quality.fit_quality(docs, labels)  # one trusted text
    assert all(0 <= r["score"] <= 1 for r in pu_quality.score_quality(docs, few).collect())


def test_the_risk_stays_above_zero():
    """With far more units than texts a plain unbiased risk runs to minus infinity; the scores stay of use."""
    rng = np.random.default_rng(2)
    P, N = rng.normal(1, 0.6, (60, pu_quality.N_FEATURES)), rng.normal(-1, 0.6, (60, pu_quality.N_FEATURES))
    U = np.concatenate([rng.normal(1, 0.6, (40, pu_quality.N_FEATURES)), N])
    models = pu_quality.train(P, U, prior=0.4)
    assert (pu_quality.scores(models, N) < 0.5).mean() > 0.9


def plain_audit(rows, labels):
    words = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    good, toxic = ({i for i, *y in labels if i is not None and y[n] == 1} for n in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        failed = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        judged.append((lang or "", {f for f, x in failed.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in itertools.permutations("ABCDE"):
            alive = [x for x in judged if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in alive if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                alive, gone = [x for x in alive if f not in x[1]], gone + now
                unique = sum(x[1] == {f} for x in judged if x[0] == part)
                out[part, "".join(order), step] = [len(alive), len(now), redundant, unique, sum(x[2] for x in now), sum(x[3] for x in now)]
                shapley[part, f] += len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filter_audit.filter_audit(df, labels).collect()}


def test_filter_audit_by_brute_force(spark, rows):
    rng = random.Random(12)
    more = []
    for k in range(120):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 9) + (str(k) if rng.random() < 0.9 else "") for _ in range(rng.choice((20, 120, 130)))]
        words = [w.upper() if rng.random() < rng.choice((0, 0.3)) else w for w in words] + rng.choice(([], ["#"], ["|", "é"]))
        more.append((1000 + k, " ".join(words), rng.choice(("en", "de", None, ""))))
        if rng.random() < 0.3:
            more.append((rng.choice((2000 + k, 900 + k, None, 1000 + k)), more[-1][1], "de"))
    every = [(i, t, ("en", None)[(i or 0) % 2]) for i, t in rows] + more
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i, *_ in every for _ in range(rng.choice((0, 1, 2)))]
    # names that the operator uses inside, beside those that it reads
    df = spark.createDataFrame([(i, t, lang, 1, "p", "A", "h") for i, t, lang in every], "doc_id bigint, text string, lang string, row bigint, part string, A string, before string").repartition(5)
    got = audited(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got == plain_audit(every, labels)


def test_filter_audit_of_little(spark):
    schema = "doc_id bigint, text string, lang string"
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(spark.createDataFrame([], schema), labels) == {}
    clean = " ".join(f"w{k}" for k in range(120))
    got = audited(spark.createDataFrame([(1, clean, "x"), (2, clean, "y"), (None, None, None)], schema), labels)
    assert len(got) == 3 * 120 * 5
    assert got["x", "ABCDE", 5] == (1, 0, 0, 0, 0, 0, 0) and got["y", "EDCBA", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
