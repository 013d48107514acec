"""Byte-level BPE of whole texts, by a minimal perfect hash and a heap.

A text is cut into pre-tokens. A pre-token that is in the vocabulary as a whole is
resolved by a minimal perfect hash over the vocabulary: one hash, one displacement, one
comparison. Any other is merged from its bytes: a doubly linked list of parts and a heap
of possible merges, lowest rank and leftmost first, which takes n log n steps for n bytes,
so a text without any break costs no more than its length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.pieces import in_batches

# Fixed value: the public pattern of the vocabulary, with the blank class spelled out.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens a worker remembers, and the longest it does.
MEMORY, LONGEST = 200_000, 48
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_broadcasts: dict[tuple[str, str, str, str], Broadcast] = {}


def _shared(spark: SparkSession, kind: str, name: str, folder: str, make: Callable[[dict[bytes, int]], object]) -> Broadcast:
    """What ``make`` builds from a vocabulary, broadcast once for an application."""
    key = (spark.sparkContext.applicationId, kind, name, folder)
    if key not in _broadcasts:
        _broadcasts[key] = spark.sparkContext.broadcast(make(read_ranks(f"{folder}/{name}.tiktoken")))
    return _broadcasts[key]


def shared_ranks(spark: SparkSession, name: str, folder: str) -> Broadcast:
    """The vocabulary itself, broadcast once for an application."""
    return _shared(spark, "ranks", name, folder, dict)


class PerfectHash:
    """A minimal perfect hash from byte strings to their numbers, checked on the key itself."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.n = len(ranks)
        self.n_buckets = max(1, self.n // 4)
        buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(self.n_buckets)]
        for key in ranks:
            hashed = xxhash.xxh3_64_intdigest(key)
            buckets[hashed % self.n_buckets].append((key, hashed))
        self.displacements = np.zeros(self.n_buckets, dtype=np.int64)
        self.keys: list[bytes] = [b""] * self.n
        self.values = np.zeros(self.n, dtype=np.int64)
        taken = bytearray(self.n)
        order = sorted(range(self.n_buckets), key=lambda i: -len(buckets[i]))
        free: Iterator[int] | None = None
        for i in order:
            bucket = buckets[i]
            if len(bucket) > 1:
                displacement = 0
                while True:
                    slots = [self._slot(hashed, displacement) for _, hashed in bucket]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    displacement += 1
            elif bucket:  # a lone key takes any free slot, named directly
                free = free or (s for s in range(self.n) if not taken[s])
                slots = [next(free)]
                displacement = -slots[0] - 1
            else:
                continue
            self.displacements[i] = displacement
            for (key, _), slot in zip(bucket, slots, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = 1, key, ranks[key]
        self.displacements, self.values = self.displacements.tolist(), self.values.tolist()

    def _slot(self, hashed: int, displacement: int) -> int:
        mixed = ((hashed ^ (displacement * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
        return (mixed >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        """The number of ``key``, or None if it is not among the keys."""
        hashed = xxhash.xxh3_64_intdigest(key)
        displacement = self.displacements[hashed % self.n_buckets]
        slot = self._slot(hashed, displacement) if displacement >= 0 else -displacement - 1
        return self.values[slot] if self.keys[slot] == key else None


class Encoder:
    """Token ids of texts by one vocabulary."""

    def __init__(self, lookup: PerfectHash) -> None:
        self.lookup = lookup
        self.split = regex.compile(PRE_TOKENS)
        self.bytes_to_id = [lookup.get(bytes([b])) for b in range(256)]
        # Which two neighbouring tokens join to which: every cut of a token into two tokens.
        ids = dict(zip(lookup.keys, lookup.values, strict=True))
        self.joins = {}
        for token, number in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    self.joins[left << 32 | right] = number
        self.memory: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes that are no token as a whole."""
        parts: list[int] = [self.bytes_to_id[b] for b in data]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joins = self.joins
        heap = []
        for i in range(n - 1):
            joined = joins.get(parts[i] << 32 | parts[i + 1])
            if joined is not None:
                heap.append((joined, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            joined, i, left, right = heapq.heappop(heap)
            j = after[i]
            # A part swallowed since has -1; a part changed since has another id.
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = joins.get(joined << 32 | parts[k])
                if found is not None:
                    heapq.heappush(heap, (found, i, joined, parts[k]))
            h = before[i]
            if h >= 0:
                found = joins.get(parts[h] << 32 | joined)
                if found is not None:
                    heapq.heappush(heap, (found, h, parts[h], joined))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; text that looks like a special token is ordinary text."""
        out: list[int] = []
        memory = self.memory
        for piece in self.split.findall(text):
            found = memory.get(piece)
            if found is None:
                data = piece.encode()
                whole = self.lookup.get(data)
                found = [whole] if whole is not None else self.merge(data)
                if len(piece) <= LONGEST:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[piece] = found
            out += found
        return out


_encoders: dict[str, Encoder] = {}


def _worker(name: str, lookup: object) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(lookup.value)
    return _encoders[name]


def encoding(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable:
    """A function for ``mapInArrow`` from (key, text) to (key, ids).

    What is broadcast, once for an application, is the vocabulary, whose size no data changes.
    """
    lookup = _shared(spark, "hash", name, folder, PerfectHash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(f"{folder}/{name}", lookup)
        for batch in in_batches(batches, 1000):
            flat: list[int] = []
            offsets, missing = [0], []
            for text in batch.column(1).to_pylist():
                missing.append(text is None)
                flat += encoder.encode(text) if text else ()
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)), mask=pa.array(missing, pa.bool_())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "ids"])

    return run


def encode(texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row: token ids without special tokens.

    A null text gives null, an empty text an empty list; repeated rows each give their
    row; an empty table gives an empty result. Texts are encoded whole, however long.
    Columns other than the two named are not read, whatever their names.
    """
    two = texts.select(F.col(key), F.col(text).alias("__text"))
    kind = two.schema[0].dataType.simpleString()
    return two.mapInArrow(encoding(texts.sparkSession, name, folder), f"`{key}` {kind}, ids array<int>")


def decoded_bytes(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Callable:
    """A pandas UDF: how many bytes the tokens of each list of ids stand for; null for null."""
    ranks = shared_ranks(spark, name, folder)

    @F.pandas_udf("long")
    def count(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = np.zeros(len(ranks.value), dtype=np.int64)
        for token, number in ranks.value.items():
            sizes[number] = len(token)
        for ids in lists:
            yield pd.Series([None if x is None else int(sizes[np.asarray(x, dtype=np.int64)].sum()) for x in ids], dtype="Int64")

    return count
