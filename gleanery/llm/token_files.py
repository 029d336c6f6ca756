"""Token ids as Parquet: list columns with dictionary or delta encoding, small row groups and pages.

A table of token files has one row per document, sorted by doc_id within and across its shards (range partitions):
doc_id, shard (int), shard_start (ids of the shard before this document), n_tokens, tokens array<int>. Row groups and pages
are small, and the files carry page indexes, so a read of some documents, or of everything but the ids, touches little.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.bpe import CHUNKED_BYTES, ChunkStore, encode_by_chunks
from gleanery.llm.shared import scratch, slices, texts_of, workers_can_import

#: Parquet settings by encoding of the ids. Delta needs the second page format and no dictionary.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
SCHEMA = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, tokens array<int>"


#: A word with what it may carry before and behind: two pieces for the byte-level splitting pattern, which cuts letters
#: from other signs.
WORD = regex.compile(r"( ?\p{L}+)([^\s\p{L}\p{N}]*)").fullmatch


def byte_level_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class LibraryEncoder:
    """A tokenizer of the tokenizers library, with a store of the pieces that this worker has encoded."""

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(data)
        cut = made.get("pre_tokenizer") or {}
        # words go to the library's model as they are where nothing but the byte-level step stands before it
        self.by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("normalizer")
        self.signs, self.model = str.maketrans(byte_level_signs()), self.tokenizer.model
        self.tails: dict[str, list[int]] = {}
        self.store = ChunkStore()

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        signs = piece.replace(" ", self.signs[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.model.tokenize(signs)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        ends = []
        for c in chunks:
            if self.by_word and (c[1:] if c[0] == " " else c).isalpha():
                flat += self._piece(c)
            elif self.by_word and (found := WORD(c)):
                flat += self._piece(found[1])
                flat += self._tail(found[2])
            else:
                flat += self.tokenizer.encode(c, add_special_tokens=False).ids
            ends.append(len(flat))
        return np.array(flat, dtype=np.uint32), np.diff(np.array([0, *ends], dtype=np.int64))

    def _tail(self, tail: str) -> list[int]:
        """Ids of the signs behind a word, which are few; those of late are remembered."""
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._piece(tail) if tail else []
        return self.tails[tail]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has: those of encode(add_special_tokens=False)."""
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return encode_by_chunks(self.store, texts, self._learn)
        # the library cuts texts at its added tokens, wherever they stand
        others = list(texts)
        for k in whole:
            others[k] = ""
        flat, n = encode_by_chunks(self.store, others, self._learn)
        parts = np.split(flat, np.cumsum(n)[:-1])
        for k in whole:
            parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(data: bytes) -> LibraryEncoder:
    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(data)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10, page_rows: int = 512, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes every row of docs and writes token files to path, in ascending doc_id order.

    A null text counts as empty. A text that holds the string of an added token has that token's id there, as the
    library gives it. Rows without a doc_id come first, rows of one doc_id stand together in order of their text. Other columns are not read. The tokenizer must cut its text before a blank that precedes a word (byte-level
    tokenizers do). tokenizer_path is a file of the driver, of fixed size; its contents go to the executors.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    with open(tokenizer_path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = library_encoder(sent.value), 0
        for batch in slices(batches, "t", CHUNKED_BYTES):
            ids, n = enc.encode(texts_of(batch, "t"))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            edges = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], edges]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("shard"), pa.array(before + edges - n), pa.array(n), lists], names=["doc_id", "shard", "shard_start", "n_tokens", "tokens"])
            before += int(edges[-1])

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t")).repartitionByRange("i").sortWithinPartitions("i", "t").withColumn("shard", F.spark_partition_id())
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd"} | ENCODINGS[encoding]
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files. Filters on doc_id and selections without tokens reach the files."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before this one), n_tokens: from the files' metadata columns only."""
    rows = read_token_files(spark, path)
    return _with_start(rows.select("doc_id", "shard", "shard_start", "n_tokens"), spark, path).select("doc_id", "start", "n_tokens")


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # one row per shard: the running sum is over as many rows as there are files
    totals = read_token_files(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    edges = totals.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("edge"))
    return rows.join(F.broadcast(edges), "shard").withColumn("start", F.col("edge") + F.col("shard_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    workers_can_import(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids, edges = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "shard", "shard_start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).mapInArrow(run, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int, encoding: str = "dictionary", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes docs as token files into the shared folder and returns token_digests of what was written."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id=end_id, encoding=encoding, text=text, doc_id=doc_id)
    return token_digests(docs.sparkSession, path)
