"""Quality rules with risk-controlled cutoffs.

Features are counted over whole texts. A rule rejects a text whose feature is above a cutoff. Cutoffs come from a
labelled holdout: for each stratum and rule, cutoffs are tested from the loosest to the strictest; a cutoff stands if
the exact binomial test shows, at the corrected level, that it rejects at most its share of good texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import slices, texts_of, workers_can_import

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_upper bigint, n_marks bigint"
#: Features of the rules, each a share of the text.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
}
GRID = 50
_SPACE = bytes([32, 9, 10, 11, 12, 13])


def count_features(texts: list[str]) -> list[list[int]]:
    """The columns of COUNTS for each text. Words are runs of anything but blank, tab, \\n, \\v, \\f and \\r."""
    rows, flat = [], []
    code: dict[bytes, int] = {}
    for t in texts:
        raw = t.encode()
        words = raw.split()  # bytes split at ASCII white space only, which are these six
        flat.append(np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=len(words)))
        spaces = len(raw) - len(raw.translate(None, _SPACE))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
        upper = len(raw) - len(raw.translate(None, _UPPER))
        marks = len(raw) - len(raw.translate(None, b"!"))
        rows.append([len(words), len(t) - spaces, symbols, _dup_lines(raw), 0, upper, marks])
    sizes = np.array([len(x) for x in flat], dtype=np.int64)
    if sizes.sum():
        ids = np.concatenate(flat)
        n, docs = len(ids), np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.flatnonzero(place < np.repeat(sizes, sizes) - 2)
        # equal (text, first word, second word, third word): each step replaces a pair of numbers by a smaller one
        pair = _dense(ids[starts] * len(code) + ids[starts + 1])
        same = _dense(_dense(pair * len(code) + ids[starts + 2]) * len(texts) + docs[starts])
        twice = starts[np.bincount(same)[same] > 1] if len(starts) else starts
        covered = np.zeros(n, dtype=bool)
        for j in range(3):
            covered[twice + j] = True
        for i, k in enumerate(np.bincount(docs[covered], minlength=len(texts))):
            rows[i][4] = int(k)
    return rows


_UPPER = bytes(range(65, 91))


def _dup_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def quality_features(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", strata: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, stratum (the strata columns joined by '/', null as '?'), and COUNTS, for each row; null texts are empty. Rows that repeat a
    doc_id, or have none, are counted each; other columns are not read."""
    workers_can_import(docs.sparkSession)
    columns = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            counts = np.array(count_features(texts_of(batch, "t")), dtype=np.int64).reshape(-1, len(columns))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("s"), *(pa.array(counts[:, k]) for k in range(len(columns)))], names=[doc_id, "stratum", *columns])

    stratum = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in strata)) if strata else F.lit("all")
    picked = docs.select(F.col(doc_id).alias("i"), stratum.alias("s"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"`{doc_id}` {picked.schema['i'].dataType.simpleString()}, stratum string, {COUNTS}")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def share(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x < (a + 1) / (a + b + 2):
        return _beta(a, b, x)
    return 1 - _beta(b, a, 1 - x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
            c = 1 + term / c if abs(1 + term / c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def certified_cutoffs(features: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", false_rejects: float = 0.02, error: float = 0.05, max_strata: int = 1000) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, with probability 1 - error so that in every stratum the rules together reject at
    most false_rejects of the good texts.

    Rules share the risk equally, and strata and rules share the error (Bonferroni). Along the grid the order of tests
    is fixed, so testing stops at the first cutoff that fails and needs no further correction. Of the cutoffs that
    stand, the loosest is taken that rejects most bad texts. A stratum or rule without enough labels has no cutoff; tables without
    rows or labels have none at all. Null ids and labels are left out, an id labelled twice is good if all of its labels say so,
    and rows that repeat an id count each.
    The driver gets one row per stratum, rule and cutoff; more than max_strata labelled strata raise an error.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("good")).dropna().groupBy("i").agg(F.min("good").alias("good"))
    rows = features.filter(~base_failed()).withColumnRenamed(doc_id, "i").join(known, "i")
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.least(F.ceil(share(r) * GRID), F.lit(GRID)).cast("int").alias("bin")) for r in RULES))
    # a text in bin b is above the cutoffs 0 .. b - 1 (in steps of 1 / GRID)
    counts = rows.select("stratum", "good", F.explode(pairs).alias("p")).groupBy("stratum", "p.rule", "p.bin").agg(F.sum((F.col("good") == 1).cast("long")).alias("n_good"), F.sum((F.col("good") == 0).cast("long")).alias("n_bad"))
    found = counts.limit(max_strata * len(RULES) * (GRID + 1) + 1).collect()
    strata = sorted({r["stratum"] for r in found})
    if len(strata) > max_strata:
        raise ValueError(f"more than {max_strata} labelled strata")
    level = error / max(1, len(strata) * len(RULES))
    out = {}
    for stratum in strata:
        for rule in RULES:
            good, bad = np.zeros(GRID + 2, dtype=np.int64), np.zeros(GRID + 2, dtype=np.int64)
            for r in found:
                if r["stratum"] == stratum and r["rule"] == rule:
                    good[r["bin"]], bad[r["bin"]] = r["n_good"], r["n_bad"]
            best = (0, None)
            for cut in range(GRID - 1, -1, -1):
                if binomial_tail(int(good[cut + 1 :].sum()), int(good.sum()), false_rejects / len(RULES)) > level:
                    break
                gain = int(bad[cut + 1 :].sum()) - int(good[cut + 1 :].sum())
                if gain > best[0]:
                    best = (gain, cut / GRID)
            if best[1] is not None:
                out[stratum, rule] = best[1]
    return out


def judge_quality(features: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """features with base_failed, certified_rules and failed_rules (arrays) and kept: no base failure and no share above its cutoff.

    certified_rules are those that have a cutoff in the row's stratum. A share is above a cutoff if its step on the grid is, so a
    share on the cutoff's own step stays; strata without cutoffs keep what the base keeps.
    """
    by_stratum: dict[str, dict[str, int]] = {}
    for (stratum, rule), cut in cutoffs.items():
        by_stratum.setdefault(stratum, {})[rule] = round(cut * GRID)
    schema = "stratum string, " + ", ".join(f"`__cut_{r}` int" for r in RULES)
    side = features.sparkSession.createDataFrame([(s, *(rules.get(r) for r in RULES)) for s, rules in by_stratum.items()], schema)
    rows = features.join(F.broadcast(side), "stratum", "left")  # one row a stratum, and max_strata bounds those
    cut = {r: F.col(f"__cut_{r}") for r in RULES}
    certified = F.array_compact(F.array(*(F.when(cut[r].isNotNull(), F.lit(r)) for r in RULES)))
    failed = F.array_compact(F.array(*(F.when(F.ceil(share(r) * GRID) > cut[r], F.lit(r)) for r in RULES)))
    rows = rows.withColumns({"base_failed": base_failed(), "certified_rules": certified, "failed_rules": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(*features.columns, "base_failed", "certified_rules", "failed_rules", "kept")
