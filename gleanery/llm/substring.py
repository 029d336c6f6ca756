"""Removal of repeated passages by difference-cover anchors.

Anchors are runs of ANCHOR words at positions p with p mod PERIOD in COVER. COVER is a difference cover: whatever the
two places of a repeated run of words, at some offset below PERIOD both places are cover positions. A run of at least
PERIOD - 1 + ANCHOR words therefore shares an aligned anchor. Anchors that occur in two texts are extended to the whole
windows around them, and windows are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import BROADCAST_IDS, checked_broadcast, saved, slices, texts_of, workers_can_import
from gleanery.llm.shingles import WordHasher, windows

PERIOD, COVER = 7, (0, 1, 3)


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, for windows of width words."""
    length = width - PERIOD + 1
    found = windows(hashes, length, seed=1)
    at = np.flatnonzero(np.isin(np.arange(len(found)) % PERIOD, COVER))
    return at, found[at]


def candidate_windows(hashes: np.ndarray, width: int, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor with one of the shared hashes at an offset below PERIOD."""
    at, found = anchors(hashes, width)
    at = at[np.isin(found, shared)]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: len(hashes) - width + 1] > 0)


def _joined(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_passages(docs: DataFrame, *, width: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and removed (array of first words and ends of the removed runs).

    Removed is every word inside a window of width words whose word sequence also starts in a row of smaller doc_id;
    windows are judged on the input. kept_sha256 is over the kept words joined by one blank. Words are runs of
    non-blanks, unchanged. A null text has no words; a row without a doc_id is kept whole and removes nothing; rows
    that repeat a doc_id do not remove each other's words, and a run of theirs counts for both only if each has it.
    Other columns are not read. width must be at least PERIOD + 1.
    """
    workers_can_import(docs.sparkSession)
    picked = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            cut = [t.encode().split() for t in texts_of(batch, "t")]
            whole = [b" ".join(w) for w in cut]
            prints = [xxhash.xxh3_128_intdigest(x) for x in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.array([len(w) for w in cut], pa.int64()), pa.array([(f >> 64) - (1 << 63) for f in prints], pa.int64()), pa.array([(f & (2**64 - 1)) - (1 << 63) for f in prints], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in whole])],
                names=["i", "n", "f", "g", "sha"],
            )

    table = saved(picked.mapInArrow(read, "i bigint, n bigint, f bigint, g bigint, sha string"), "texts")
    # a text that is equal to one of smaller doc_id is repeated from end to end: it needs no anchors
    firsts = table.filter(f"i is not null and n >= {width}").groupBy("f", "g").agg(F.min("i").alias("first"))
    copies = saved(table.filter(f"i is not null and n >= {width}").join(firsts, ["f", "g"]).filter("i <> first").select("i").distinct(), "copies")
    # an id that stands for several texts goes the long way unless all of them are copies
    several = table.groupBy("i").count().filter("count > 1").select("i")
    copies = copies.join(several, "i", "left_anti")
    single = picked.filter("i is not null").join(checked_broadcast(copies, BROADCAST_IDS), "i", "left_anti")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for batch in slices(batches, "t"):
            ids = batch.column("i").to_numpy()
            found = [np.unique(anchors(h, width)[1]) if len(h) >= width else np.zeros(0, dtype=np.uint64) for h in (hasher.hashes(hasher.words(t)) for t in texts_of(batch, "t"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in found]))], names=["h", "i"])

    # a text has one row for an anchor, however often it repeats it
    whole = Window.partitionBy("h")
    hits = single.mapInArrow(anchored, "h bigint, i bigint").withColumn("least", F.min("i").over(whole)).withColumn("most", F.max("i").over(whole)).filter("least <> most")
    hits = saved(hits.groupBy("i").agg(F.collect_list("h").alias("hs")), "hits")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for batch in slices(batches, "t"):
            ids, shared = batch.column("i").to_pylist(), batch.column("hs")
            for i, t, k in zip(ids, texts_of(batch, "t"), range(batch.num_rows), strict=True):
                h = hasher.hashes(hasher.words(t))
                if len(h) < width:
                    continue
                at = candidate_windows(h, width, shared[k].values.to_numpy().view(np.uint64))
                a, b = (windows(h, width, seed=s)[at].view(np.int64) for s in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(at), i)), pa.array(at, pa.int32())], names=["a", "b", "i", "at"])

    # a passage of very many texts is one row of an aggregate, and a key of a join that Spark can split
    passages = saved(single.join(hits, "i").mapInArrow(extended, "a bigint, b bigint, i bigint, at int"), "passages")
    least = saved(passages.groupBy("a", "b").agg(F.min("i").alias("least"), F.max("i").alias("most")).filter("least < most").select("a", "b", "least"), "least")
    later = passages.join(least, ["a", "b"]).filter("i > least")
    starts = saved(later.groupBy("i").agg(F.collect_set("at").alias("starts")), "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            rows = []
            for i, t, k in zip(batch.column("i").to_pylist(), texts_of(batch, "t"), range(batch.num_rows), strict=True):
                words = t.encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                at = batch.column("starts")[k].values.to_numpy()
                at = at[at + width <= len(words)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                rows.append((i, int(gone.sum()), _joined([w for w, g in zip(words, gone, strict=True) if not g]), edges.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["i", "n_removed", "kept", "removed"])

    cuts = single.join(starts, "i").mapInArrow(cut, "i bigint, n_removed bigint, kept string, removed array<int>")
    gone = copies.select("i", F.lit(True).alias("copy"))
    out = table.join(gone, "i", "left").join(cuts, "i", "left")
    copy = F.coalesce("copy", F.lit(False))
    return out.select(
        F.col("i").alias(doc_id),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.lit(_joined([]))).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n").cast("int"))).otherwise(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
    )
