"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

Words are hashed into buckets with embeddings; filters of several widths run over the whole text, each is max-pooled,
and a logistic layer scores the pooled features. All labelled rows take part, their texts whole: blocks of rows are trained in numpy
from common parameters, which are averaged after each round. The driver sees the parameters, the words' buckets and the rows of
the start, at most 2 * START_ROWS of START_WORDS words in all, which give the first round parameters that agree. Scoring runs over
every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import BROADCAST_IDS, checked_broadcast, saved, slices, texts_of, workers_can_import

WORD = re.compile(r"\w+")
PAD, RARE = 0, 1
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 8, 1 << 18
CACHE_WORDS = 1 << 19
#: Words of a text whose filters are worked out at a time.
PIECE = 1 << 15
#: The filter bank and the offset of each matrix of weights.
TAPS = [(k, j) for k, width in enumerate(WIDTHS) for j in range(width)]
#: Rows of a class and words of the start; rows and words of a block, about; rounds over all blocks; size of a step.
START_ROWS, START_WORDS, BLOCK_ROWS, BLOCK_WORDS, ROUNDS, STEP = 4000, 1 << 23, 4000, 1 << 21, 4, 0.1
#: Cutoffs that a threshold is chosen from.
CUTS = np.linspace(0.02, 0.98, 97)
_BANK = [slice(k * FILTERS, (k + 1) * FILTERS) for k in range(len(WIDTHS))]


@dataclass
class ToxicityModel:
    """bucket_ids: embedding row of each hash bucket; taps[width][offset]: embedding rows through the filter taps."""

    bucket_ids: np.ndarray
    taps: dict[int, list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]
    default_threshold: float


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def buckets_of(text: str, cache: dict[str, int]) -> np.ndarray:
    found = WORD.findall(text.lower())
    for w in set(found):
        if w not in cache:
            cache[w] = bucket(w)
    return np.fromiter(map(cache.__getitem__, found), dtype=np.int32, count=len(found))


def network(words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters to begin with: embeddings E, weights W of each tap, biases b, the layer v with c."""
    widths = np.array([WIDTHS[k] for k, _ in TAPS])[:, None, None]
    E = rng.normal(0, 0.3, (words + 2, DIM))
    E[PAD] = 0
    bank = len(WIDTHS) * FILTERS
    return {"E": E, "W": rng.normal(0, 1, (len(TAPS), DIM, FILTERS)) / np.sqrt(DIM * widths), "b": np.zeros(bank), "v": rng.normal(0, 0.3, bank), "c": np.array([-2.0])}


def _best(E: np.ndarray, W: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each filter over the places of a text, and the words at that place."""
    n, wide, bank = max(len(doc), 1), max(WIDTHS) - 1, len(WIDTHS) * FILTERS
    words = np.zeros(n + wide, dtype=np.int64)
    words[: len(doc)] = doc
    best, at = np.full(bank, -np.inf, dtype=np.float32), np.zeros(bank, dtype=np.int64)
    for start in range(0, n, PIECE):
        m = min(PIECE, n - start)
        through = E[words[start : start + m + wide]] @ W
        conv = np.empty((m, bank), dtype=np.float32)
        for t, (k, j) in enumerate(TAPS):
            part = through[j : j + m, t * FILTERS : (t + 1) * FILTERS]
            if j:
                conv[:, _BANK[k]] += part
            else:
                conv[:, _BANK[k]] = part
        here = conv.argmax(axis=0)
        value = conv[here, np.arange(bank)]
        at = np.where(value > best, here + start, at)
        best = np.maximum(value, best)
    return best, words[at[:, None] + np.arange(wide + 1)]


def _gradients(params: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, weight: float, rng: np.random.Generator, word_dropout: float) -> dict[str, np.ndarray]:
    """Of the mean loss of these texts; some words are taken for rare ones."""
    E, W = params["E"], params["W"]
    small, flat = E.astype(np.float32), W.transpose(1, 0, 2).reshape(DIM, -1).astype(np.float32)
    found = [_best(small, flat, np.where(rng.random(len(d)) < word_dropout, RARE, d)) for d in docs]
    words = np.stack([w for _, w in found])
    pooled = np.maximum(np.stack([v for v, _ in found]) + params["b"], 0)
    z = np.clip(pooled @ params["v"] + params["c"][0], -30, 30)
    dz = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, weight, 1.0) / len(y)
    g = dz[:, None] * params["v"] * (pooled > 0)
    grads = {"E": np.zeros_like(E), "W": np.zeros_like(W), "b": g.sum(axis=0), "v": pooled.T @ dz, "c": np.array([dz.sum()])}
    for t, (k, j) in enumerate(TAPS):
        own, at = g[:, _BANK[k]], words[:, _BANK[k], j]
        grads["W"][t] = np.einsum("bf,bfd->df", own, E[at])
        np.add.at(grads["E"], at, own[:, :, None] * W[t].T[None])
    grads["E"][PAD] = 0
    return grads


def _batches(docs: list[np.ndarray], size: int = 32) -> list[np.ndarray]:
    """Places of texts of like length."""
    by_length = np.argsort([len(d) for d in docs], kind="stable")
    return [by_length[i : i + size] for i in range(0, len(by_length), size)]


def learn(params: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, weight: float, rng: np.random.Generator, *, epochs: int = 8, word_dropout: float = 0.15, decay: float = 3e-3) -> None:
    """Trains new params in place (Adam) on texts given as embedding rows; toxic ones count weight times."""
    batches = _batches(docs)
    first, second = ({n: np.zeros_like(p) for n, p in params.items()} for _ in range(2))
    step = 0
    for _ in range(max(epochs, -(-400 // max(1, len(batches))))):  # a small sample gets as many steps
        for i in rng.permutation(len(batches)):
            pick = batches[i]
            grads = _gradients(params, [docs[k] for k in pick], y[pick], weight, rng, word_dropout)
            step += 1
            for n, p in params.items():
                grad = grads[n] + (decay if n == "E" else 1e-4) * p
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad**2
                p -= 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)


def refine(params: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, weight: float, rng: np.random.Generator, *, word_dropout: float = 0.15) -> None:
    """Goes over a block in place, by plain steps along the gradient, its norm at most 1: rare words move little, so that blocks stay near each other.

    A block of few rows and words is gone over again, for 100 steps or the words of a large block.
    """
    batches = _batches(docs)
    passes = min(-(-100 // max(1, len(batches))), BLOCK_WORDS // max(1, sum(map(len, docs))))
    for i in (i for _ in range(max(1, passes)) for i in rng.permutation(len(batches))):
        pick = batches[i]
        grads = _gradients(params, [docs[k] for k in pick], y[pick], weight, rng, word_dropout)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        for n, p in params.items():
            p -= STEP / max(1.0, norm) * grads[n]


def _weight(clean: float, toxic: float) -> float:
    return min(max(clean / max(toxic, 1), 1), 5)


def _model(params: dict[str, np.ndarray], bucket_ids: np.ndarray, prior: float, odds: float) -> ToxicityModel:
    """The network for scoring; training saw toxic rows at these odds, scores are for the share of prior."""
    taps = {width: [(params["E"] @ params["W"][t]).astype(np.float32) for t, (k2, _) in enumerate(TAPS) if k2 == k] for k, width in enumerate(WIDTHS)}
    prior = min(max(prior, 1e-4), 0.5)
    return ToxicityModel(bucket_ids, taps, params["b"], params["v"], float(params["c"][0] + np.log(prior / (1 - prior)) - np.log(odds)), {}, 0.5)


def _of_one_class(share: float | None) -> ToxicityModel:
    """Every score is that class's prior, and nothing reaches a threshold of 2."""
    prior = 0.01 if share is None else float(np.clip(share, 1e-3, 0.5))
    flat = {w: [np.zeros((2, FILTERS), dtype=np.float32)] * w for w in WIDTHS}
    return ToxicityModel(np.full(BUCKETS, RARE, dtype=np.int32), flat, np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), float(np.log(prior / (1 - prior))), {}, 2.0)


def _numbered(kept: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, RARE, dtype=np.int32)
    out[kept] = np.arange(len(kept)) + 2
    return out


def train(texts: list[str], toxic: list[int], langs: list[str | None], *, prior: float | None = None, epochs: int = 8, word_dropout: float = 0.15, decay: float = 3e-3, seed: int = 7) -> ToxicityModel:
    """Fits the network on four fifths of these rows, here, and calibrates thresholds on the rest: for rows that one machine holds.

    prior is the share of toxic rows that scores shall assume (default: that of the rows).
    With one class only, or no rows, every score is that class's prior and nothing reaches a threshold of 2.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return _of_one_class(y.mean() if len(y) else None)
    cache = {}
    hashed = [buckets_of(t, cache) for t in texts]
    seen = np.bincount(np.concatenate([np.unique(h) for h in hashed]), minlength=BUCKETS)
    # words of few documents share one row: nothing is learnt by heart from a single text
    bucket_ids = _numbered(np.flatnonzero(seen >= max(3, len(y) // 600)))
    docs = [bucket_ids[h] for h in hashed]
    params = network(int(bucket_ids.max()) - 1, rng)
    order = rng.permutation(len(y))
    # each class is split alike, so that few rows still have both in the part that calibrates
    check = np.concatenate([order[y[order] == c][::5] for c in (0, 1)])
    fit = np.setdiff1d(order, check)
    weight = _weight((y == 0).sum(), y.sum())
    learn(params, [docs[i] for i in fit], y[fit], weight, rng, epochs=epochs, word_dropout=word_dropout, decay=decay)
    model = _model(params, bucket_ids, y.mean() if prior is None else prior, y.sum() * weight / (1 - y).sum())
    scores = score_ids(model, [docs[i] for i in check])
    model.default_threshold = calibrated(binned(scores, y[check]), 0.5)
    for lang in {langs[i] for i in check if langs[i] is not None}:
        own = np.array([langs[i] == lang for i in check])
        if y[check][own].sum() >= 10 and (1 - y[check][own]).sum() >= 10:
            model.thresholds[lang] = calibrated(binned(scores[own], y[check][own]), model.default_threshold)
    return model


def binned(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts [class, number of cutoffs that a score reaches]."""
    out = np.zeros((2, len(CUTS) + 1), dtype=np.int64)
    np.add.at(out, (y.astype(np.int64), np.searchsorted(CUTS, scores, side="right")), 1)
    return out


def calibrated(bins: np.ndarray, otherwise: float) -> float:
    """The middle of the cutoffs with the best F1 on held-out rows, kept within 0.3 to 0.9."""
    toxic = bins[1].sum()
    if not toxic:
        return otherwise
    reach = bins[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    f1 = 2 * reach[1] / np.maximum(reach.sum(axis=0) + toxic, 1)
    return float(np.clip(np.median(CUTS[f1 >= f1.max() - 1e-12]), 0.3, 0.9))


def score_ids(model: ToxicityModel, docs: list[np.ndarray]) -> np.ndarray:
    """Scores of whole documents given as embedding rows."""
    tail = np.zeros(max(WIDTHS) - 1, dtype=np.int32)
    flat = np.concatenate([x for d in docs for x in ((d, tail) if len(d) else (tail[:1], tail))])
    lengths = np.array([max(len(d), 1) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths + len(tail))[:-1]])
    real = np.ones(len(flat), dtype=bool)
    for j in range(len(tail)):
        real[starts + lengths + j] = False
    pooled = []
    steps = len(flat) - len(tail)
    for width in WIDTHS:
        conv = model.taps[width][0][flat[:steps]]
        for j in range(1, width):
            conv = conv + model.taps[width][j][flat[j : steps + j]]
        conv[~real[:steps]] = -np.inf
        pooled.append(np.maximum.reduceat(conv, starts, axis=0))
    z = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lang: str | None) -> DataFrame:
    """h (of id and text), held (a fifth of the ids), y, l and codes (the words' buckets) of each row of docs with a label."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y")).filter("y in (0, 1)")
    known = checked_broadcast(saved(known, "labelled"), BROADCAST_IDS)
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l")).filter("t is not null")
    rows = texts.join(known, "i").select(F.xxhash64("i", "t").alias("h"), (F.pmod(F.xxhash64("i", F.lit("held")), F.lit(5)) == 0).alias("held"), "y", "l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = {}
        for batch in slices(batches, "t"):
            codes = pa.array([buckets_of(t, cache).tobytes() for t in texts_of(batch, "t")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "h held y l".split()), codes], names="h held y l codes".split())
            if len(cache) > CACHE_WORDS:
                cache.clear()

    return saved(rows.mapInArrow(run, "h bigint, held boolean, y int, l string, codes binary"), "coded")


def _blocks(coded: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt into blocks by hash, a block in a row of its own."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("l", "ascending")])
        codes = rows.column("codes").to_pylist()
        as_bytes = lambda name, kind: np.array(rows.column(name).to_pylist(), dtype=kind).tobytes()
        lengths = np.array([len(c) // 4 for c in codes], dtype=np.int32).tobytes()
        one = {"block": rows.column("block")[0].as_py(), "codes": b"".join(codes), "lengths": lengths, "y": as_bytes("y", np.int8), "held": as_bytes("held", np.bool_), "langs": rows.column("l").to_pylist()}
        return pa.Table.from_pylist([one], pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("codes", "lengths", "y", "held")), ("langs", pa.list_(pa.string()))]))

    dealt = coded.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks)).cast("int"))
    return saved(dealt.groupBy("block").applyInArrow(pack, "block int, codes binary, lengths binary, y binary, held binary, langs array<string>"), "blocks")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]]:
    """block, the words of its texts, y, held and languages."""
    for batch in batches:
        for k in range(batch.num_rows):
            (r,) = batch.slice(k, 1).to_pylist()
            ends = np.cumsum(np.frombuffer(r["lengths"], dtype=np.int32))
            yield r["block"], np.split(np.frombuffer(r["codes"], dtype=np.int32), ends[:-1]), np.frombuffer(r["y"], dtype=np.int8), np.frombuffer(r["held"], dtype=np.bool_), r["langs"]


def _start(coded: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """y and words of START_ROWS rows of each class that are not held, in the order of their hashes; a text for which there are too few words left is passed over."""
    fit = coded.filter(~F.col("held")).select("y", "h", "codes")
    first = [fit.filter(F.col("y") == c).select("y", "h", (F.octet_length("codes") / 4).cast("bigint").alias("n")).orderBy("h").limit(START_ROWS) for c in (0, 1)]
    taken, left = [], START_WORDS
    for r in sorted(first[0].unionByName(first[1]).collect(), key=lambda r: (r["h"], r["y"])):
        if r["n"] <= left:
            taken.append((r["h"],))
            left -= r["n"]
    picked = fit.sparkSession.createDataFrame(taken, "h bigint").distinct()
    rows = fit.join(F.broadcast(picked), "h").dropDuplicates(["h"]).toPandas().sort_values("h")
    return rows["y"].to_numpy(dtype=np.float64), [np.frombuffer(c, dtype=np.int32) for c in rows["codes"]]


def _vocabulary(blocks: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """The buckets that enough texts have, both classes counted alike: nothing is learnt by heart from a single text. At most 600 times as many as a text has on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, y, _, _ in _unpacked(batches):
            seen = np.zeros((2, BUCKETS), dtype=np.int64)
            for d, label in zip(docs, y, strict=True):
                seen[label, np.unique(d)] += 1
            at = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    seen = blocks.mapInArrow(run, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = seen.filter((F.col("clean") / clean + F.col("toxic") / toxic >= 2 / 600) & (F.col("clean") + F.col("toxic") >= 3)).select("bucket").toPandas()
    return np.sort(kept["bucket"].to_numpy(dtype=np.int64))


def _round(blocks: DataFrame, n_blocks: int, params: dict[str, np.ndarray], bucket_ids: np.ndarray, weight: float, seed: list[int]) -> dict[str, np.ndarray]:
    """Each block refines params by its own rows that are not held; the mean of what they get, by rows.

    Sums of about the root of the number of blocks reach the driver.
    """
    sent, names = blocks.sparkSession.sparkContext.broadcast((params, bucket_ids)), sorted(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, ids = sent.value
        for block, docs, y, held, _ in _unpacked(batches):
            fit, own = np.flatnonzero(~held), {n: p.copy() for n, p in start.items()}
            refine(own, [ids[docs[k]] for k in fit], y[fit].astype(np.float64), weight, np.random.default_rng([*seed, block]))
            moved = np.concatenate([(own[n] - start[n]).ravel() for n in names]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(fit)]), pa.array([moved], pa.binary())], names=["block", "n", "moved"])

    def add(rows: pa.Table) -> pa.Table:
        rows, total = rows.sort_by("block"), 0.0
        for n, moved in zip(rows.column("n"), rows.column("moved"), strict=True):
            total = total + n.as_py() * np.frombuffer(moved.as_py(), dtype=np.float32).astype(np.float64)
        return pa.table({"part": rows.column("part")[:1], "n": [sum(rows.column("n").to_pylist())], "moved": pa.array([total.tobytes()], pa.binary())})

    moves = blocks.mapInArrow(run, "block int, n bigint, moved binary").withColumn("part", F.col("block") % int(np.ceil(np.sqrt(n_blocks))))
    sums = sorted(moves.groupBy("part").applyInArrow(add, "part int, n bigint, moved binary").collect())
    sent.destroy()
    moved, out, start = sum(np.frombuffer(r["moved"]) for r in sums) / max(1, sum(r["n"] for r in sums)), {}, 0
    for n in names:
        out[n] = params[n] + moved[start : start + params[n].size].reshape(params[n].shape)
        start += params[n].size
    return out


def _calibrate(blocks: DataFrame, model: ToxicityModel) -> None:
    """Thresholds from the rows that were held; languages with ten of each class there have their own."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = sent.value.bucket_ids, ["l", "y", "bin", "n"]
        for _, docs, y, held, langs in _unpacked(batches):
            found = {}
            for k in np.flatnonzero(held):
                score = score_ids(sent.value, [ids[docs[k]]])
                found[langs[k]] = found.get(langs[k], 0) + binned(score, y[k : k + 1])
            rows = [(lang, int(c), int(b), int(n[c, b])) for lang, n in found.items() for c, b in zip(*n.nonzero(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([("l", pa.string()), ("y", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))

    counts = saved(blocks.mapInArrow(run, "l string, y int, bin int, n bigint").groupBy("l", "y", "bin").agg(F.sum("n").alias("n")), "bins")
    sent.destroy()
    enough = counts.filter("l is not null").groupBy("l").agg(F.sum(F.col("n") * F.col("y")).alias("toxic"), F.sum("n").alias("n")).filter("toxic >= 10 and n - toxic >= 10").select("l")
    bins = {}
    for r in [*counts.groupBy("y", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).alias("l"), "y", "bin", "n").collect(), *counts.join(enough, "l", "left_semi").select("l", "y", "bin", "n").collect()]:
        bins.setdefault(r["l"], np.zeros((2, len(CUTS) + 1), dtype=np.int64))[r["y"], r["bin"]] = r["n"]
    model.default_threshold = calibrated(bins.pop(None, np.zeros((2, len(CUTS) + 1), dtype=np.int64)), 0.5)
    model.thresholds = {lang: calibrated(n, model.default_threshold) for lang, n in bins.items()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str | None = "lang", rows_per_class: int | None = None, max_chars: int = 10_000, seed: int = 7) -> ToxicityModel:
    """Trains on all rows of docs that have a label, whole texts, but for a fifth of the ids (by hash), on which thresholds are calibrated.

    Null labels, ids and texts are left out, and labels other than 0 and 1; an id labelled twice counts as toxic if any of its labels
    does; rows that repeat an id all take part. Without labels or docs nothing is ever rejected. The same tables give the same model.
    With rows_per_class there are no rounds over the tables: the driver trains on so many labelled ids of docs of each class by hash
    order, then id, whose texts have at most max_chars characters.
    """
    if rows_per_class is not None:
        return _fit_on_sample(docs, labels, text, doc_id, label, lang, rows_per_class, max_chars)
    workers_can_import(docs.sparkSession)
    coded = _labelled(docs, labels, text, doc_id, label, lang)
    n, toxic, words = coded.agg(F.count("*"), F.sum("y"), F.sum(F.octet_length("codes")) / 4).first()
    if not n or toxic in (0, n):
        return _of_one_class(toxic / n if n else None)
    n_blocks = max(1, -(-n // BLOCK_ROWS), int(-(-words // BLOCK_WORDS)))
    blocks = _blocks(coded, n_blocks)
    rng, bucket_ids = np.random.default_rng(seed), _numbered(_vocabulary(blocks, n - toxic, toxic))
    params = network(int((bucket_ids != RARE).sum()), rng)
    y, first = _start(coded)
    weight = _weight((y == 0).sum(), y.sum())
    learn(params, [bucket_ids[d] for d in first], y, weight, rng)
    # the rounds see other odds than the start did
    odds = max(y.sum(), 1) * weight / max((y == 0).sum(), 1)
    weight = _weight(n - toxic, toxic)
    params["c"] += np.log(toxic * weight / (n - toxic)) - np.log(odds)
    for k in range(ROUNDS):
        params = _round(blocks, n_blocks, params, bucket_ids, weight, [seed, k])
    model = _model(params, bucket_ids, toxic / n, toxic * weight / (n - toxic))
    _calibrate(blocks, model)
    return model


def _fit_on_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lang: str | None, rows_per_class: int, max_chars: int) -> ToxicityModel:
    """As fit_toxicity says; ids without a text in docs don't count."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("l")).filter(F.length("t") <= max_chars)
    known = saved(known.join(texts.select("i"), "i", "left_semi"), "labelled")
    prior = known.agg(F.avg("y")).first()[0]
    by_hash = (F.xxhash64("i"), F.col("i"))
    sample = known.filter("y = 1").orderBy(*by_hash).limit(rows_per_class).unionByName(known.filter("y = 0").orderBy(*by_hash).limit(rows_per_class))
    # at most 2 * rows_per_class ids, so this broadcast is bounded
    rows = texts.join(F.broadcast(sample), "i").orderBy("i", "t").toPandas()
    return train(rows["t"].tolist(), rows["y"].tolist(), [x if isinstance(x, str) else None for x in rows["l"]], prior=prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", doc_id: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """doc_id, score (0 to 1, from the whole text only), threshold (that of the row's language), rejected.

    One row for each input row, repeated ids included; equal texts have equal scores. A null text scores as the empty text; a null or unknown
    language has the threshold calibrated over all languages. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    sent = spark.sparkContext.broadcast(model)  # fixed size: hash buckets, embeddings of the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        ids_of = model.bucket_ids
        for batch in slices(batches, "t"):
            coded = []
            for t in texts_of(batch, "t"):
                found = WORD.findall(t.lower())
                try:
                    coded.append(np.fromiter(map(cache.__getitem__, found), dtype=np.int32, count=len(found)))
                except KeyError:
                    for w in set(found):
                        if w not in cache:
                            cache[w] = int(ids_of[bucket(w)])
                    coded.append(np.fromiter(map(cache.__getitem__, found), dtype=np.int32, count=len(found)))
            if len(cache) > CACHE_WORDS:
                cache.clear()
            scores = score_ids(model, coded)
            cut = np.array([model.thresholds.get(x, model.default_threshold) for x in batch.column("l").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(scores), pa.array(cut), pa.array(scores >= cut)], names=[doc_id, "score", "threshold", "rejected"])

    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l"))
    kind = picked.schema["i"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{doc_id}` {kind}, score double, threshold double, rejected boolean")
