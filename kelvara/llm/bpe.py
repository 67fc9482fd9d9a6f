"""Corpus encoding with a public byte-level BPE vocabulary (problem 8).

Every distinct pre-token of an Arrow batch is resolved once, in two tiers. A minimal perfect hash over the
vocabulary answers pre-tokens that are themselves tokens; any other pre-token is merged with a heap over a
doubly linked list of its bytes. The batch's ids are then gathered with NumPy, so the per-occurrence work is the
pre-token split and one dictionary code.

The operator is one map over the scan: no shuffle, no state between rows, and only the vocabulary (a fixed
public file, under 1 MB) travels with the task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of this vocabulary family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a rank file (one `base64 rank` pair per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys occupy exactly n slots.

    Buckets are placed largest first; a bucket with several keys searches for a displacement that sends all of
    them to free slots, and a bucket with one key stores its slot directly. A lookup is one 64-bit hash, one
    displacement and one key comparison, so a string outside the key set is always recognised as a miss.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            by_bucket.setdefault(h % self.buckets, []).append((h, k))
        self.displacement = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        single = []
        for bucket, members in sorted(by_bucket.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                single.append((bucket, members[0][1]))
                continue
            d = 1
            while True:
                places = [self._slot(h, d) for h, _ in members]
                if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.displacement[bucket] = d
            for p, (_, k) in zip(places, members):
                self.slots[p], self.values[p] = k, ranks[k]
        free = (i for i, s in enumerate(self.slots) if s is None)
        for bucket, k in single:
            p = next(free)
            self.displacement[bucket] = -p - 1
            self.slots[p], self.values[p] = k, ranks[k]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The rank of `key`, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        p = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[p] if self.slots[p] == key else -1


def merge_bytes(word: bytes, rank_of) -> list[int]:
    """BPE of one pre-token: a heap of adjacent pairs over a linked list of byte parts, lowest rank first and
    leftmost among equals. O(n log n) in the bytes, so a very long pre-token stays cheap."""
    n = len(word)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        if (r := rank_of(word[i : i + 2])) >= 0:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (q := rank_of(word[i : end[k]])) >= 0:
                heapq.heappush(heap, (q, i, end[k]))
        if (p := prv[i]) >= 0 and (q := rank_of(word[p:stop])) >= 0:
            heapq.heappush(heap, (q, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of(word[i : end[i]]))
        i = nxt[i]
    return out


class Encoder:
    """Two-tier encoder; one per Python worker."""

    MEMO = 200_000

    def __init__(self, path: str):
        self.hash = PerfectHash(read_ranks(path))
        self.split = regex.compile(PRE_TOKEN).findall
        self.memo: dict[str, list[int]] = {}

    def word(self, token: str) -> list[int]:
        """Ids of one pre-token; merged results are kept in a bounded memo."""
        known = self.memo.get(token)
        if known is not None:
            return known
        raw = token.encode()
        whole = self.hash.get(raw)
        ids = [whole] if whole >= 0 else merge_bytes(raw, self.hash.get)
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        if len(token) <= 64:
            self.memo[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for t in self.split(text) for i in self.word(t)] if text else []

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the flat ids of a batch."""
        index: dict[str, int] = {}
        codes: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                parts = self.split(text)
                per_text[k] = len(parts)
                codes += [index.setdefault(p, len(index)) for p in parts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not codes:
            return offsets, np.zeros(0, np.int32)
        words = [self.word(t) for t in index]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.fromiter((i for w in words for i in w), np.int32, int(start[-1]))
        code = np.asarray(codes, np.int64)
        length = size[code]
        stop = np.cumsum(length)
        ids = flat[np.arange(int(stop[-1])) + np.repeat(start[code] - (stop - length), length)]
        edges = np.concatenate([[0], np.cumsum(per_text)])
        offsets = np.concatenate([[0], stop])[edges]
        return offsets, ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder; built once per process."""
    return Encoder(path)


#: Rows encoded together; bounds a task's memory whatever the size of an Arrow batch.
SLICE = 2_000


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>): every row's text in the ids of `vocabulary`, without special tokens.

    Null and empty texts give an empty list, strings that look like special tokens are ordinary text, repeated
    rows stay repeated, and a null id stays null. Other columns, whatever their names, are left out. `vocabulary`
    is a path readable on every worker.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                offsets, ids = enc.encode_batch(part.column(1).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, size bigint): tokens of every row's text; null and empty texts have size 0."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                offsets, _ = enc.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64())], names=[id_col, "size"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, size bigint")
