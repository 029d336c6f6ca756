"""Byte-level BPE encoding and decoding in numpy.

Texts are cut at single blanks before a word, where the splitting pattern always cuts too, so that equal pieces of a
task, known by 64-bit hashes, are encoded once. Pieces go into padded matrices by length; in each round every row merges its leftmost pair of
least rank, found by a hashed table of pairs, and closes the gap. Ids of whole texts are then gathered by index.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import slices, texts_of, workers_can_import

#: Longer pieces are merged with a heap, in time that grows little faster than their length.
LONGEST_ROW = 128
CACHE_PIECES = 400_000
#: Bytes of text that are cut and hashed at a time.
CHUNKED_BYTES = 2 << 20
NONE = np.int64(1 << 40)


class PairTable:
    """Open addressing over (left id, right id); every split of a token into two tokens is a pair."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 3)
        self.bits = max(int(np.ceil(np.log2(max(len(pairs), 1) * 4))), 4)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int64)
        self.probes = 0
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slots = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            put = np.zeros(len(keys), dtype=bool)
            put[first] = True
            put &= free
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge or a side is padding (-1)."""
        keys = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        flat_keys, flat_found, slots = keys.ravel(), found.ravel(), slots.ravel()
        open_ = np.flatnonzero(((self.keys[slots] != flat_keys) & (self.keys[slots] != -1) & (flat_keys >= 0)))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slots[open_]] == flat_keys[open_]
            flat_found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (self.keys[slots[open_]] != -1)]
        return flat_found.reshape(keys.shape)


class Encoder:
    """Ranks of a tokenizer, made ready for encoding; one lives in each Python worker that needs it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.store = ChunkStore()

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece of the splitting pattern."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.uint32)
            elif len(p) > LONGEST_ROW:
                out[i] = self._long(p)
            elif p:
                by_length.setdefault(-(-len(p) // 4), []).append(i)
            else:
                out[i] = np.zeros(0, dtype=np.uint32)
        for quarter, rows in by_length.items():
            step = max(1, (1 << 18) // quarter)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._rows([pieces[i] for i in part], 4 * quarter), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = np.where(np.arange(width)[None, :] < sizes[:, None], self.byte_ids[raw], -1)
        ranks = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        done_ids, done_rows = [], []
        rows = np.arange(len(pieces))
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            least = ranks[each, at]
            merge = least < NONE
            if not merge.all():
                done_ids += list(ids[~merge])
                done_rows += rows[~merge].tolist()
                ids, ranks, rows, at, least = ids[merge], ranks[merge], rows[merge], at[merge], least[merge]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = least
            # the right part of the pair goes, what follows moves up by one
            take = columns[None, : ids.shape[1] - 1] + (columns[None, : ids.shape[1] - 1] > at[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(take, ranks.shape[1] - 1), axis=1)[:, : ids.shape[1] - 1]
            if not ids.shape[1] - 1:
                done_ids += list(ids)
                done_rows += rows.tolist()
                break
            last = ids.shape[1] - 1
            right = np.minimum(at, last - 1)
            ranks[each, right] = np.where(at < last, self.pairs.lookup(ids[each, right], ids[each, right + 1]), NONE)
            left = np.maximum(at - 1, 0)
            ranks[each, left] = np.where(at > 0, self.pairs.lookup(ids[each, left], ids[each, left + 1]), ranks[each, left])
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(pieces)
        for i, x in zip(done_rows, done_ids, strict=True):
            out[i] = x[x >= 0].astype(np.uint32)
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, position) over a linked list."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        get, end = self.ranks.get, len(parts)
        heap = [(r, i) for i in range(end - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= end or get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
                if (r := get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([self.ranks[p] for p in parts if p is not None], dtype=np.uint32)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.split(c) for c in chunks]
        distinct = list(dict.fromkeys(p for c in cut for p in c))
        ids = dict(zip(distinct, self.pieces([p.encode() for p in distinct]), strict=True))
        parts = [ids[p] for c in cut for p in c]
        each = np.array([len(x) for x in parts], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum([len(c) for c in cut])]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), np.diff(np.concatenate([[0], ends]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        return encode_by_chunks(self.store, texts, self._learn)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class ChunkStore:
    """Ids of the chunks that a worker has met, by 64-bit hashes of the chunks: keys in order, and the row of each."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.starts, self.lengths, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Takes in new keys, which are in order, and the ids of their chunks one after another; returns their rows."""
        rows = len(self.starts) + np.arange(len(keys))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.lengths, self.uses = np.concatenate([self.lengths, sizes]), np.concatenate([self.uses, np.zeros(len(keys), dtype=np.int64)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.used += len(flat)
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after another, and where each row ends."""
        sizes = self.lengths[rows]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends

    def forget(self) -> None:
        """Keeps the chunks of a full store that were met again, if they are at most half of it."""
        kept = self.uses[self.rows] > 1
        keys, rows = self.keys[kept], self.rows[kept]
        flat, sizes = self.gather(rows)[0], self.lengths[rows]
        self.clear()
        if len(keys) <= CACHE_PIECES // 2:
            self.add(keys, flat, sizes)


#: White space but blanks and line ends, and the sign at which texts are cut.
OTHER_SPACE = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: A single blank between words: patterns of this kind always cut there.
CUT = regex.compile(r"(?<=\S)(?= \S)", regex.V1)


def plainly_cut(text: str) -> bool:
    """Whether every blank and every line end stands alone between words, and no other white space is there: then the
    text is cut before each blank and around each line end."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE(text) or text[:1] in (" ", "\n", "") or text[-1] in " \n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BY_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def chunks_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of all texts, where their chunks start, and how many chunks there are up to the end of each text.

    Texts are cut where patterns of this kind always cut: before a single blank between two words, which goes with the
    word after it, and around a single line end between two words.
    """
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    plain = [plainly_cut(t) for t in texts]
    line_end = raw == 10
    first = (raw == 32) | line_end
    first[1:] |= line_end[:-1]
    first &= np.repeat(plain, [len(x) for x in parts])
    begins = ends - [len(x) for x in parts]
    first[begins[begins < ends]] = True
    for k, t in enumerate(texts):
        if t and not plain[k]:
            sizes = [len(c.encode()) for c in CUT.split(t)]
            first[begins[k] + np.cumsum([0, *sizes[:-1]])] = True
    starts = np.flatnonzero(first)
    return raw.tobytes(), starts, np.searchsorted(starts, ends)


def chunk_keys(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk: a sum over its bytes of a number for the byte times one for its place, mixed."""
    sizes = np.diff(np.concatenate([starts, [len(raw)]]))
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    by_place = _mixed(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return _mixed(np.add.reduceat(_BY_BYTE[np.frombuffer(raw, dtype=np.uint8)] * by_place[place], starts) + sizes.astype(np.uint64))


def encode_by_chunks(store: ChunkStore, texts: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Encodes each distinct chunk once for a worker, then gathers the ids of whole texts."""
    if len(store.keys) > CACHE_PIECES:
        store.forget()
    raw, starts, upto = chunks_of(texts)
    if not len(starts):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    keys, where, each, uses = np.unique(chunk_keys(raw, starts), return_index=True, return_inverse=True, return_counts=True)
    rows = store.find(keys)
    new = np.flatnonzero(rows < 0)
    if len(new):
        ends = np.concatenate([starts[1:], [len(raw)]])
        rows[new] = store.add(keys[new], *learn([raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]))
    store.uses[rows] += uses
    flat, ends = store.gather(rows[each])
    edge = np.concatenate([[0], ends])[upto]
    return flat, np.diff(np.concatenate([[0], edge]))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines with a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; kept between tasks."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, token_ids (array of int), for each row of docs; a null or empty text has none. Other columns are not read.

    Rows that repeat a doc_id, or have none, are encoded each. Ranks are unique; of equal pairs in a piece the leftmost merges first.

    ranks_path is a file of the driver, of fixed size; its contents go to the executors.
    """
    return _encoded(docs, ranks_path, pattern, text, doc_id, "token_ids array<int>", lambda enc, ids, n: [_lists(ids, n)])


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what a round trip through the tokenizer gives for each row.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes. A
    null text counts as empty. Rows that repeat a doc_id, or have none, have a row each.
    """

    def digests(enc: Encoder, ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        own = np.split(ids, np.cumsum(n)[:-1])
        return [pa.array(n), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in own])]

    return _encoded(docs, ranks_path, pattern, text, doc_id, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests)


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str, doc_id: str, columns: str, made) -> DataFrame:
    spark = docs.sparkSession
    workers_can_import(spark)
    with open(ranks_path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(sent.value, pattern)
        for batch in slices(batches, "t", CHUNKED_BYTES):
            ids, n = enc.encode(texts_of(batch, "t"))
            arrays = [batch.column("i"), *made(enc, ids, n)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    schema = f"`{doc_id}` {picked.schema['i'].dataType.simpleString()}, {columns}"
    names = [doc_id, *(c.split()[0] for c in columns.split(", "))]
    return picked.mapInArrow(run, schema)
