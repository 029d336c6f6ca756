"""The stages keep what they must, return the columns of documents, and give defined results for odd rows."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns)
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    leaked = next(r["text"] for r in rows.collect() if r["text"] and len(r["text"].split()) > 200)
    spark.createDataFrame([(1, " ".join(leaked.split()[-30:]))], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    ids = [r["doc_id"] for r in rows.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, root)
        out.write.parquet(f"{root}/{k}")
        rows = spark.read.parquet(f"{root}/{k}")
        now = [r["doc_id"] for r in rows.collect()]
        assert set(now) <= set(ids)
        if name in ("toxicity", "line_dedup"):
            assert len(now) == len(ids)  # no labels, so no one is toxic; lines go, rows stay
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == columns
    assert "n_tokens" in rows.columns and None in now


def test_texts_are_not_shuffled_to_leave_out_few_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id bigint, text string")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline._without(docs, spark.createDataFrame([(2,), (2,), (None,), (7,)], "doc_id bigint"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a"), (3, None), (None, "d")]


def plain_score(model, text):
    """The network by loops over places and filters."""
    import math
    import re

    from gleanery.llm.toxicity import FILTERS, WIDTHS, bucket

    ids = [int(model.bucket_ids[bucket(w)]) for w in re.findall(r"\w+", (text or "").lower())] or [0]
    ids += [0] * (max(WIDTHS) - 1)
    z = model.out_bias
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            best = max(sum(float(model.taps[width][j][ids[at + j], f]) for j in range(width)) for at in range(len(ids) - max(WIDTHS) + 1))
            z += max(best + model.bias[k * FILTERS + f], 0) * model.out[k * FILTERS + f]
    return 1 / (1 + math.exp(-z))


def test_run_is_the_plain_version(spark, tmp_path):
    """Toxic texts, near copies, repeated lines and leaked passages, through run() and through plain Python."""
    import hashlib
    import random
    import struct

    import public_tokenizers
    import tiktoken
    from test_llm import bench_words, classes_of, earlier_matches, lower, shingles, words

    from gleanery.llm import bpe, toxicity

    rng = random.Random(12)
    text = lambda n: " ".join(f"{rng.choice(['le', 'wort', 'stone', 'été'])}{rng.randrange(400)}" for _ in range(n))
    rows = [(i, text(30) + ("" if i % 4 else f" {rng.choice(['nastyword', 'viletalk'])} ") + text(9), "en" if i % 2 else "de") for i in range(400)]
    base, item, line = text(90), text(24), text(12)
    for k in range(25):
        w = base.split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((500 + k, " ".join(w), "en"))
    rows += [(600 + k, text(20) + "\n" + line + "\n" + text(15), "de") for k in range(6)]
    rows += [(700, text(10) + " " + " ".join(item.split()[3:16]) + " " + text(5), "en"), (701, text(8) + " " + " ".join(item.split()[3:12]), None), (702, None, "en"), (703, "", "en"), (704, "  \n ", "de")]
    root = str(tmp_path)
    labels = [(i, int(i % 4 == 0)) for i in range(300)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(30))], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, root).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    model = toxicity.fit_toxicity(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    left = {i: t for i, t, lang in rows if plain_score(model, t) < model.thresholds.get(lang, model.default_threshold)}
    assert 80 < len(rows) - len(left) < 130
    gone = earlier_matches(left.items())
    assert {(600 + k, 1) for k in range(1, 6)} <= gone
    left = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in left.items()}
    named = classes_of({i: shingles(words(lower(t)), 5) for i, t in left.items()}, 80)
    left = {i: t for i, t in left.items() if named[i] == i}
    windows = {tuple(bench_words(item)[k : k + 10]) for k in range(15)}
    left = {i: t for i, t in left.items() if not any(tuple(bench_words(t)[k : k + 10]) in windows for k in range(len(bench_words(t))))}
    assert 700 not in left and 701 in left
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = []
    for i, t in left.items():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
