"""Quality from trusted good texts and unlabelled web text: positive-unlabelled learning.

A small network is trained in numpy with the non-negative unbiased risk: with prior p, the risk of calling texts bad is
that of the unlabelled ones minus p times that of the trusted ones, which an unbiased estimate lets fall below zero when
the network learns the trusted texts by heart; where it does, the step goes the other way. Nobody has to label bad texts.

The prior is estimated as well: whatever is scored, the share of unlabelled texts above a cutoff is at least p times that
of trusted ones, with equality where no bad text reaches, so p is the least ratio over cutoffs, on texts that took no part
in the fit of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import saved, slices, texts_of, workers_can_import

#: Characters of each class of the outline of a text; bytes from 128 on are letters.
CLASSES = [b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:", b"!?", b"'\"()-", b"|", b"#*$%&<>", b"@/\\_=+~^`[]{}"]
N_CLASSES = len(CLASSES) + 1
_CLASS_OF = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[[*range(9), *range(14, 32), 127]] = N_CLASSES - 1
GRAMS = N_CLASSES**3
DENSE = ("length", "word_length", "distinct", "same_as_before", "repeated_lines", "upper", "digits", "punctuation", "marks", "bars", "symbols", "other")
N_FEATURES = len(DENSE) + GRAMS


def features(texts: list[str]) -> np.ndarray:
    """[texts, N_FEATURES]: shares of words, lines and characters, and shares of the outline's trigrams, of whole texts.

    The outline is the text's characters by class, runs of one class as one, so a trigram is a turn such as letters,
    symbols, blank. An empty text has zeros.
    """
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    n = len(DENSE)
    for r, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        if not raw:
            continue
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        kinds = _CLASS_OF[np.frombuffer(raw, dtype=np.uint8)]
        share = np.bincount(kinds, minlength=N_CLASSES) / len(raw)
        w = max(len(words), 1)
        same = sum(map(eq, words, islice(words, 1, None)))
        out[r, :n] = (np.log1p(len(words)) / 10, len(raw) / w / 20, len(set(words)) / w, same / w, 1 - len(set(lines)) / max(len(lines), 1), share[1], share[2], share[5], share[6], share[8], share[9], share[7] + share[10] + share[11])
        turns = kinds[np.flatnonzero(np.diff(kinds, prepend=-1))]
        if len(turns) > 2:
            grams = (turns[:-2] * N_CLASSES + turns[1:-1]) * N_CLASSES + turns[2:]
            out[r, n:] = np.bincount(grams, minlength=GRAMS) / len(grams)
    return out


@dataclass
class QualityModel:
    """used: features that vary in the sample; a network of one hidden layer over them, centred and scaled."""

    used: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float


def _logits(model: QualityModel, X: np.ndarray) -> np.ndarray:
    Z = np.clip((X[:, model.used] - model.mean) / model.scale, -8, 8)
    return np.tanh(Z @ model.hidden + model.hidden_bias) @ model.out + model.out_bias


def scores(models: list[QualityModel], X: np.ndarray) -> np.ndarray:
    """0 to 1, by the mean logit of the networks."""
    return 1 / (1 + np.exp(-np.clip(np.mean([_logits(m, X) for m in models], axis=0), -30, 30)))


def _constant(prior: float) -> QualityModel:
    none = np.zeros(0, dtype=np.int64)
    return QualityModel(none, np.zeros(0), np.ones(0), np.zeros((0, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))), prior)


def fit(P: np.ndarray, U: np.ndarray, prior: float, *, plain: bool = False, units: int = 12, epochs: int = 60, size: int = 256, rate: float = 0.005, decay: float = 0.02, seed: int = 12) -> QualityModel:
    """Minimises the non-negative risk with the logistic loss, or with plain the usual risk of telling P from U."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([P, U])
    used = np.flatnonzero((both != 0).sum(axis=0) >= max(5, len(both) // 400))
    mean, scale = both[:, used].mean(axis=0), both[:, used].std(axis=0) + 1e-4
    model = QualityModel(used, mean, scale, rng.normal(0, 1 / np.sqrt(max(len(used), 1)), (len(used), units)), np.zeros(units), rng.normal(0, 0.3, units), 0.0, prior)
    ZP, ZU = (np.clip((X[:, used] - mean) / scale, -8, 8) for X in (P, U))
    names = ("hidden", "hidden_bias", "out", "out_bias")
    first, second, step = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    parts = max(1, min(len(P), len(U)) // size)
    epochs = max(epochs, -(-600 // parts))  # a small sample gets as many steps
    for _ in range(epochs):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(len(P)), parts), np.array_split(rng.permutation(len(U)), parts), strict=True):
            Z = np.concatenate([ZP[p_rows], ZU[u_rows]])
            h = np.tanh(Z @ model.hidden + model.hidden_bias)
            g = h @ model.out + model.out_bias
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            n_p, n_u = len(p_rows), len(u_rows)
            loss_bad = np.logaddexp(0, g)  # of calling a text bad
            # derivatives of the mean losses: of good on P, of bad on U and on P
            good_p = np.concatenate([(s[:n_p] - 1) / n_p, np.zeros(n_u)])
            bad_u = np.concatenate([np.zeros(n_p), s[n_p:] / n_u])
            bad_p = np.concatenate([s[:n_p] / n_p, np.zeros(n_u)])
            if plain:
                dg = good_p + bad_u
            elif loss_bad[n_p:].mean() - prior * loss_bad[:n_p].mean() >= 0:
                dg = prior * good_p + bad_u - prior * bad_p
            else:
                dg = prior * bad_p - bad_u
            back = np.outer(dg, model.out) * (1 - h * h)
            grads = {"hidden": Z.T @ back + decay * model.hidden, "hidden_bias": back.sum(axis=0), "out": h.T @ dg + decay * model.out, "out_bias": dg.sum()}
            step += 1
            for k, d in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                setattr(model, k, getattr(model, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return model


def estimated_prior(P: np.ndarray, U: np.ndarray, *, error: float = 0.1, least: int = 50) -> float:
    """Share of good texts among the unlabelled ones U, from trusted good ones P.

    Two networks tell P from U, each on a half; on the other half, the least ratio over cutoffs of the shares of U and P above
    is taken, of cutoffs by the upper bound for sampling error that holds with probability 1 - error.
    """
    found = []
    for half in (0, 1):
        p_fit, p_rest, u_fit, u_rest = P[half::2], P[1 - half :: 2], U[half::2], U[1 - half :: 2]
        if min(len(p_rest), len(u_rest)) < least or not min(len(p_fit), len(u_fit)):
            continue
        model = fit(p_fit, u_fit, 0.5, plain=True, epochs=15, decay=2e-3)
        p, u = np.sort(_logits(model, p_rest))[::-1], np.sort(_logits(model, u_rest))[::-1]
        cuts = np.unique(p)[::-1]
        q_p, q_u = np.searchsorted(-p, -cuts, side="right") / len(p), np.searchsorted(-u, -cuts, side="right") / len(u)
        margin = np.sqrt(np.log(4 / error) / (2 * len(u))) + np.sqrt(np.log(4 / error) / (2 * len(p)))
        best = np.argmin((q_u + margin) / q_p)
        found.append(q_u[best] / q_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def train(P: np.ndarray, U: np.ndarray, *, prior: float | None = None, networks: int = 3) -> list[QualityModel]:
    """Networks of several starts with the same prior (default: estimated). Without trusted or unlabelled texts every
    score is the prior, 0.5 where it can't be estimated."""
    prior = estimated_prior(P, U) if prior is None else prior
    if not len(P) or not len(U):
        return [_constant(prior)]
    return [fit(P, U, prior, seed=k) for k in range(networks)]


def text_features(docs: DataFrame, *, text: str = "text", keep: str = "i") -> DataFrame:
    """The column keep and x, the features of the whole text as 32-bit floats; null texts are empty."""
    workers_can_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            X = features(texts_of(batch, "t"))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([x.tobytes() for x in X], pa.binary())], names=["k", "x"])

    picked = docs.select(F.col(keep).alias("k"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"k {picked.schema['k'].dataType.simpleString()}, x binary").withColumnRenamed("k", keep)


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", trusted_rows: int = 6000, unlabelled_rows: int = 6000) -> list[QualityModel]:
    """Trains on bounded, repeatable samples by hash order of ids: trusted_rows ids labelled good, and unlabelled_rows ids of docs,
    whatever their label. Only good labels are read: an id is trusted if none of its labels is 0 and one is 1.

    Texts count whole, whatever their length; the driver gets their features only. Null ids and labels are left out; rows
    that repeat an id come with it, so a sample may be larger by those. Ids without a text in docs don't count.
    """
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter("i is not null")
    good = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).dropna().groupBy("i").agg(F.min("y").alias("y")).filter("y = 1")
    ids = texts.select("i").distinct()
    by_hash = (F.xxhash64("i"), F.col("i"))
    trusted = good.join(ids, "i", "left_semi").select("i", F.lit(True).alias("p")).orderBy(*by_hash).limit(trusted_rows)
    other = ids.select("i", F.lit(False).alias("p")).orderBy(*by_hash).limit(unlabelled_rows)
    sample = saved(trusted.unionByName(other).groupBy("i").agg(F.bool_or("p").alias("p"), F.bool_or(~F.col("p")).alias("u")), "pu-sample")
    # at most trusted_rows + unlabelled_rows ids, so this broadcast is bounded
    rows = text_features(texts.join(F.broadcast(sample.select("i")), "i"), text="t").join(F.broadcast(sample), "i").toPandas().sort_values(["i", "x"])
    X = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), N_FEATURES)
    return train(X[rows["p"].to_numpy(dtype=bool)], X[rows["u"].to_numpy(dtype=bool)])


def score_quality(docs: DataFrame, models: list[QualityModel], *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1, likelier good when higher) of each row, from the whole text only.

    One row for each input row, repeated ids included; equal texts have equal scores; a null text scores as the empty
    text. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    sent = spark.sparkContext.broadcast(models)  # fixed size: a few networks over N_FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(scores(models, features(texts_of(batch, "t"))))], names=[doc_id, "score"])

    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"`{doc_id}` {picked.schema['i'].dataType.simpleString()}, score double")
