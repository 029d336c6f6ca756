"""N-gram Jaccard join by parity sketches.

Each distinct shingle of a text flips bits of one chunk of a sketch (its hash is added to the chunk by exclusive or), so
two sketches differ in at most as many chunks as their sets have elements that only one of them holds. Sets of similar
size (a size band and the next) that reach the threshold differ in at most D elements; with D + 1 + s chunks at least
1 + s chunks are equal. Texts meet in equal chunks, but for the s of each text that fewest shingles fell into: of
1 + s equal chunks both texts keep the last in that order. What meets is compared by a second sketch of one bit for
each shingle, whose Hamming distance is at most the symmetric difference, and then exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.links import classes, components
from gleanery.llm.shared import BROADCAST_IDS, checked_broadcast, saved, slices, texts_of, workers_can_import
from gleanery.llm.shingles import WordHasher, fingerprint, mix, shingle_set


def bands(percent: int, largest: int) -> list[int]:
    """Least sizes of the size bands: a set and any set that it can be similar to are in one band or in neighbours."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return out


def bit_sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The parity of the shingles at each bit, as longs: a power of two of them, with about four bits for each element
    that a similar set may differ in. The lower half of a sketch xor its upper half is the sketch of half the size."""
    differ = 2 * len(shingles) * (100 - percent) / (100 + percent)
    longs = 1 << max(0, int(np.ceil(np.log2(max(differ, 1) / 16))))
    parity = np.bincount((shingles & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def apart(a: str, b: str) -> Column:
    """Hamming distance of two bit sketches, folded to one size; null where that takes more than one fold."""
    half = lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, F.size(s)), lambda x, y: x.bitwiseXOR(y))
    x, y = F.when(F.size(a) > F.size(b), half(a)).otherwise(F.col(a)), F.when(F.size(b) > F.size(a), half(b)).otherwise(F.col(b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda sum_, k: sum_ + k)


def sketch_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: the chunks of each set at the level of its own band and of the next."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.array(bands(percent, int(sizes.max() * (100 / percent) ** 2) + 2), dtype=np.int64)
    ratio = (100 - percent) / (100 + percent)
    flat = np.concatenate([sets[i] for i in rows])
    own = np.searchsorted(starts, sizes[rows], side="right") - 1
    out_rows, out_keys = [], []
    for level in (own, own + 1):
        differ = np.floor(2 * ratio * (starts[level + 1] - 1) + 1e-9).astype(np.int64)
        spare = np.where(differ > 0, 1 + differ // 6, 0)
        chunks = differ + 1 + spare
        first = np.cumsum(chunks) - chunks
        each = np.repeat(np.arange(len(rows)), sizes[rows])
        at = first[each] + ((flat >> np.uint64(32)) * chunks[each].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        slots, begin = np.unique(at[order], return_index=True)
        value = np.zeros(int(chunks.sum()), dtype=np.uint64)
        value[slots] = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x9E3779B97F4A7C15))[order], begin)
        fell = np.bincount(at, minlength=len(value)).astype(np.uint64)
        owner = np.repeat(np.arange(len(rows)), chunks)
        with np.errstate(over="ignore"):
            place = (level[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(value)) - first[owner]).astype(np.uint64)
            keys = mix(value + mix(place + np.uint64(1)))
        # the chunks of each set from the least filled on, in an order that equal chunks have in common
        ordered = np.lexsort(((np.minimum(fell, np.uint64(255)) << np.uint64(56)) | (keys >> np.uint64(8)), owner))
        # sets of this level that may differ in nothing are equal sets, which need no sketch
        use = ordered[(np.arange(len(value)) - first[owner] >= spare[owner]) & (differ > 0)[owner]]
        out_rows.append(rows[owner[use]])
        out_keys.append(keys[use].view(np.int64))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts)))


def _mapped(docs: DataFrame, made, schema: str) -> DataFrame:
    """docs (i, t) through made(ids, texts) -> arrays of the schema's columns."""
    workers_can_import(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays(made(hasher, batch.column("i"), texts_of(batch, "t")), names=names)

    return docs.mapInArrow(run, schema)


def ngram_classes(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links; itself if none), one row per row of docs.

    Two rows link if the Jaccard similarity of their sets of distinct word shingles is at least so many per cent. Words
    are lower-cased (A-Z) runs of non-blanks; a text of fewer words is one shingle. Null, empty and wordless texts have
    no shingles and link with nothing; rows without a doc_id have their count and a null component. Rows that repeat a
    doc_id are linked with each other, whatever their texts. Shingles and sets are known by 64-bit hashes. Ties have no
    say: a component is named by its least doc_id. Other columns are not read. Jobs run while the result is made.
    """
    picked = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t"))

    def sets(hasher, texts):
        return [shingle_set(hasher.hashes(hasher.words(t)), width) for t in texts]

    def sized(hasher, ids, texts):
        made = sets(hasher, texts)
        return [ids, pa.array([len(s) for s in made], pa.int64()), pa.array([fingerprint(s) for s in made], pa.int64()), lists([bit_sketch(s, percent) for s in made])]

    def keyed(hasher, ids, texts):
        made = sets(hasher, texts)
        rows, keys = sketch_keys(made, percent)
        return [pa.array(keys, pa.int64()), pa.array(np.array([fingerprint(s) for s in made], dtype=np.int64)[rows])]

    def tokens(hasher, ids, texts):
        made = sets(hasher, texts)
        return [pa.array([fingerprint(s) for s in made], pa.int64()), lists([s.view(np.int64) for s in made])]

    table = saved(_mapped(picked, sized, "i bigint, n bigint, f bigint, s array<bigint>"), "sizes")
    # equal sets are one node from the start; the text of its least doc_id stands for it
    known = table.filter("i is not null and n > 0")
    nodes = saved(known.groupBy("f").agg(F.min("i").alias("i"), F.count("*").alias("weight"), F.min("n").alias("n"), F.first("s").alias("s")), "nodes")
    copies = known.join(nodes.select("f", F.col("i").alias("least")), "f").filter("i <> least").select("i").distinct().join(nodes.select("i"), "i", "left_anti")
    single = picked.filter("i is not null").join(checked_broadcast(saved(copies, "copies"), BROADCAST_IDS), "i", "left_anti")
    rows = _mapped(single, keyed, "key bigint, id bigint")
    whole = Window.partitionBy("key")
    met = rows.withColumn("least", F.min("id").over(whole)).withColumn("most", F.max("id").over(whole)).filter("least <> most").select("key", "id")
    buckets = met.join(nodes.select(F.col("f").alias("id"), "weight"), "id")

    def sets_of(asked: DataFrame) -> DataFrame:
        ids = asked.join(nodes.select(F.col("f").alias("id"), "i"), "id").select("i").distinct()
        found = _mapped(picked.join(checked_broadcast(ids, BROADCAST_IDS), "i", "left_semi"), tokens, "id bigint, tokens array<bigint>")
        return asked.join(found.dropDuplicates(["id"]), "id")

    def near(pairs: DataFrame) -> DataFrame:
        sketches = nodes.select("f", "n", "s")
        both = pairs.join(sketches.toDF("a", "n_a", "s_a"), "a").join(sketches.toDF("b", "n_b", "s_b"), "b")
        most = (F.col("n_a") + F.col("n_b")) * ((100 - percent) / (100 + percent)) + 1e-6
        return both.filter((F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")) & (F.coalesce(apart("s_a", "s_b"), F.lit(0)) <= most)).select("a", "b")

    found = classes(buckets, sets_of, percent, near)
    classed = known.select("i", "f").join(found.withColumnRenamed("node", "f"), "f", "left").select("i", F.coalesce("component", "f").alias("c"))
    classed = saved(classed.distinct(), "classed")
    # an id of several rows joins their classes
    several = classed.groupBy("i").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("i", "a")
    joined = saved(classed.join(several, "i").select("a", F.col("c").alias("b")), "joined")
    if not joined.isEmpty():
        classed = classed.join(components(joined).toDF("c", "whole"), "c", "left").select("i", F.coalesce("whole", "c").alias("c"))
    # a table of its own, so that Spark can split a component of very many members, or send the table around
    least = saved(classed.groupBy("c").agg(F.min("i").alias("least")), "least")
    member = classed.join(least, "c").select("i", "least").distinct()
    return table.join(member, "i", "left").select(F.col("i").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("least", "i").alias("component_id"))
