"""Centroid clustering on whole numbers: vectors of 64 components as bit planes, dot products by counting bits.

Bit i of all 64 components of a vector is one unsigned 64-bit number, its plane i. With x = sum(w_i * bit_i), where the
highest plane of a two's complement has a negative weight, x . c is the sum over pairs of planes of
w_i * w_j * popcount(x_i & c_j). All of it is whole numbers, so distances are exact and do not depend on the order of
summation, the number of tasks or a task that runs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import saved, workers_can_import

COMPONENTS = 64
#: Components after scaling are within 2 ** LIMIT_BITS, so that no squared distance leaves 64 bits.
LIMIT_BITS = 27
#: Vectors whose distances a task works out at a time: the arrays of a pair of planes stay in the cache.
BLOCK = 1024


def scaled(batch: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists that have 64 finite components, and their floor(scale * x)."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(batch), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == COMPONENTS)
    rows = batch.take(pa.array(at))
    values = pa.compute.fill_null(rows.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
    whole = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        found = np.floor(scale * values[whole])
    if found.size and np.abs(found).max() > 1 << LIMIT_BITS:
        raise ValueError(f"a component is beyond {(1 << LIMIT_BITS) / scale:g}: squared distances would not fit 64 bits")
    return at[whole], found.astype(np.int64)


def bits_of(v: np.ndarray) -> np.ndarray:
    """Planes that each row needs: bits of its largest component and one for the sign."""
    return np.frexp(np.maximum(v.max(axis=1), -1 - v.min(axis=1)).astype(np.float64))[1] + 1


def packed(v: np.ndarray, planes: int) -> np.ndarray:
    """[rows, planes]: the bit planes of whole numbers [rows, 64]."""
    bits = (v[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpacked(planes: np.ndarray) -> np.ndarray:
    """Whole numbers [rows, 64] from their planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes, dtype="<u8").view(np.uint8).reshape(len(planes), -1, 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits.astype(np.int64), weights(planes.shape[1]))


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[rows, centroids]: exact dot products of rows and centroids, both given as planes."""
    a, b = x.shape[1], c.shape[1]
    by_weight = np.zeros((a + b - 1, len(x), len(c)), dtype=np.int16)  # at most 28 pairs of planes of 64 bits each
    both = np.empty((len(x), len(c)), dtype=np.uint64)
    ones = np.empty((len(x), len(c)), dtype=np.uint8)
    for i in range(a):
        for j in range(b):
            np.bitwise_and(x[:, i, None], c[None, :, j], out=both)
            np.bitwise_count(both, out=ones)
            if (i == a - 1) != (j == b - 1):
                by_weight[i + j] -= ones
            else:
                by_weight[i + j] += ones
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for power in range(a + b - 1):
        out += by_weight[power].astype(np.int64) << power
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """[rows]: the dot product of each row with itself, by its planes."""
    w = weights(x.shape[1])
    return sum(w[i] * w[j] * np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64) for i in range(x.shape[1]) for j in range(x.shape[1]))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance, for rows given as planes."""
    c = packed(centroids, int(bits_of(centroids).max()))
    length = squares(c)
    cluster, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for s in range(0, len(x), BLOCK):
        part = x[s : s + BLOCK]
        d = length[None, :] - 2 * dots(part, c)
        best = d.argmin(axis=1)
        cluster[s : s + BLOCK] = best
        distance[s : s + BLOCK] = d[np.arange(len(part)), best] + squares(part)
    return cluster, distance


def planes_table(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """i, planes: the vectors with exactly 64 components, none of them null or non-finite, as planes of 8 bytes each.

    A row has as many planes as its components need. Null vectors and all others go; repeated rows stay.
    """
    workers_can_import(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = scaled(batch.column("v"), scale)
            bits = bits_of(v) if len(v) else np.zeros(0, dtype=np.int64)
            for n in np.unique(bits):
                own = np.flatnonzero(bits == n)
                raw = packed(v[own], int(n)).tobytes()
                cells = [raw[k : k + 8 * n] for k in range(0, len(raw), 8 * n)]
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at[own])), pa.array(cells, pa.binary())], names=["i", "planes"])

    picked = vectors.select(F.col(vec_id).alias("i"), F.col(embedding).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, f"i {picked.schema['i'].dataType.simpleString()}, planes binary")


def _by_planes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and planes of the rows of a batch, those of equal numbers of planes together."""
    cells = batch.column("planes").to_pylist()
    sizes = np.fromiter(map(len, cells), dtype=np.int64, count=len(cells))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer(b"".join([cells[k] for k in at]), dtype="<u8").reshape(len(at), -1)


def first_centroids(planes: DataFrame, k: int, seed: int) -> np.ndarray:
    """[at most k, 64]: the vectors of smallest sha256 of '<seed>:<id>', in that order; equal ids by their planes.

    A vector without an id is no centroid.
    """
    rows = planes.filter("i is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), 256).alias("h"), "planes")
    found = rows.orderBy("h", "planes").limit(k).collect()  # k rows
    cells = [np.frombuffer(bytes(r["planes"]), dtype="<u8")[None, :] for r in found]
    return np.concatenate([unpacked(c) for c in cells]) if cells else np.zeros((0, COMPONENTS), dtype=np.int64)


def moved(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the exact floor of the mean of the vectors that are nearest; empty ones stay.

    Each task adds up its own vectors, so k * 64 sums leave it and as many reach the driver, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, x in _by_planes(batch):
                cluster, _ = nearest(x, centroids)
                order = np.argsort(cluster, kind="stable")
                own, starts = np.unique(cluster[order], return_index=True)
                sums[own] += np.add.reduceat(unpacked(x)[order], starts)
                counts += np.bincount(cluster, minlength=len(counts))
        own = np.flatnonzero(counts)
        if len(own):
            c, p = np.repeat(own, COMPONENTS), np.tile(np.arange(COMPONENTS), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(sums[own].ravel()), pa.array(counts[c])], names=["c", "p", "s", "n"])

    found = planes.select("planes").mapInArrow(run, "c int, p int, s bigint, n bigint").groupBy("c", "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in found:
        out[r["c"], r["p"]] = r["s"] // r["n"]  # Python's // rounds down
    return out


def centroid_clusters(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector after so many rounds, and the centroids.

    Kept are vectors of exactly 64 components, none null or non-finite; others have no row. A component x becomes
    floor(scale * x). The first centroids are the k kept vectors of smallest sha256 of '<seed>:<id>' (fewer if there are
    fewer; never one without an id). Ties of distance go to the smaller number. Repeated rows each count and each have a
    row, those without an id too. Where no vector has an id, cluster and distance are null. Other columns are not read.
    The planes are one table in the shared folder, read in each round.
    """
    planes = saved(planes_table(vectors, vec_id=vec_id, embedding=embedding, scale=scale), "planes")
    centroids = first_centroids(planes, k, seed)
    kind = planes.schema["i"].dataType.simpleString()
    if not len(centroids):
        return planes.select(F.col("i").alias(vec_id), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(planes, centroids)
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_planes(batch):
                cluster, distance = nearest(x, last)
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at)), pa.array(cluster), pa.array(distance)], names=[vec_id, "cluster", "distance"])

    return planes.mapInArrow(run, f"`{vec_id}` {kind}, cluster int, distance bigint"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned (saved, so that it is worked out once) with cluster_inertia, inertia and the digest of the centroid."""
    rows = saved(assigned, "clusters")
    found = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one a cluster
    total = sum(d or 0 for d in found.values())
    digests = [(n, found.get(n), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    side = rows.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster", "left")  # one row a centroid
