"""Records of one split that occur, exactly or almost, among the records of another.

Similarity is that of the sets of three-character pieces, and so is the filter before it,
which makes it exact. With a and b the numbers of pieces of two records, similarity 0.8
means that at most (a + b) / 9 pieces are in one of the two sets only. That holds for any
texts, whatever their edits, order, alphabet or length. Pieces fall into parts by their
hash, so many that a linked pair differs in one piece at most within some part. Each part
falls into FOURTHS, of which all but one are then the same: a record has a key for each
part and each fourth left out, of all pieces in the other three. Linked records share a key;
records that share boilerplate seldom do, as some seven pieces from all over the text make
a key. The number of parts follows from the size, so records meet by classes of the size
of the training text.

Evaluation records go to shards of bounded size by the number of their pieces, training
texts to files by theirs. A task takes one shard and one class of one file, makes the keys
of both and compares records that share one: first by a sketch of parities, which never
differs in more bits than the sets in pieces, then by all their pieces. So only linked
pairs leave the task. Passages are all runs of
LENGTH characters of the evaluation text; those that the partner also holds are merged
into its coverage.

Shards and texts are tables in the shared folder that the tasks read by themselves. No
text of either side passes through the driver, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.near import comparison_rows
from plumbline.llm.pieces import n_pieces_udf, piece_codes
from plumbline.scratch import Scratch

LENGTH = 6
#: Parts of which one is left out for a key.
FOURTHS = 4
#: Evaluation records of one shard. A training text is taken apart once for each shard it may
#: have a partner in, so few large ones are cheaper than many small; 8 bytes a key, about as many keys as 0.6 times the pieces.
SHARD = 60_000
#: Training texts in one file, of which a task takes those of one class.
SLICE = 40_000
#: Bits of a sketch; cells and pairs that are worked on at once.
SKETCH, CELLS, PAIRS = 512, 500_000, 2_000_000
#: The part of a key's bits that an index keeps.
HALF = np.uint64(0xFFFFFFFF00000000)


class Overlap(NamedTuple):
    """``pairs``: (train_id, evaluation_id, coverage) of linked records; coverage is that of the evaluation record."""

    pairs: DataFrame


def _bounds(most: int) -> np.ndarray:
    """The least size of each class, up to one beyond ``most``."""
    found = [1]
    while found[-1] <= most:
        found.append(max(found[-1] + 1, found[-1] * 6 // 5))
    return np.array(found)


def _parts(largest: int) -> int:
    """So many that one of them holds at most one of the differences of a linked pair, for training texts of up to ``largest`` pieces."""
    return ((largest + 5 * largest // 4) // 9 + 2) // 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _flat(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), _mixed(np.concatenate(pieces))


def _sketches(pieces: list[np.ndarray]) -> np.ndarray:
    """Parities of how many pieces fall to each bit; a row for each 64 bits, a column for each record."""
    rows, hashed = _flat(pieces)
    counts = np.bincount(rows * SKETCH + (hashed >> np.uint64(55)).astype(np.int64), minlength=len(pieces) * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(pieces), SKETCH), axis=1).view(np.uint64).T.copy()


def _keys(pieces: list[np.ndarray], parts: int) -> np.ndarray:
    """Keys of each record, a row each: of every part, the pieces but those of one fourth."""
    rows, hashed = _flat(pieces)
    width = parts * FOURTHS
    cells = rows * width + (hashed % np.uint64(width)).astype(np.int64)
    again, sums = _mixed(hashed), []
    # Halves of the hashes are added up without rounding, so the order of pieces is of no matter.
    for half in (again >> np.uint64(32), again & np.uint64(2**32 - 1)):
        held = np.bincount(cells, weights=half.astype(float), minlength=len(pieces) * width).astype(np.uint64).reshape(-1, parts, FOURTHS)
        sums.append((held.sum(axis=2, keepdims=True) - held).reshape(len(pieces), width))
    return _mixed(_mixed(sums[0] + np.arange(width, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) + sums[1])


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(width, SKETCH))
    yield from (slice(i, i + step) for i in range(0, n, step))


def _open(path: str) -> ds.Dataset:
    """A table of the shared folder, read without the JVM."""
    if path.startswith("file:"):
        return ds.dataset("/" + path[5:].lstrip("/"), format="parquet")
    if "://" not in path:
        return ds.dataset(path, format="parquet")
    system, inner = pfs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return ds.dataset(inner, filesystem=system, format="parquet")


class _Shard:
    """Evaluation records with their texts and sketches."""

    def __init__(self, path: str, number: int) -> None:
        rows = _open(path).to_table(columns=["a", "n_a", "text"], filter=ds.field("shard") == number)
        self.records, self.sizes = rows["a"].to_numpy(), rows["n_a"].to_numpy().astype(np.int64)
        self.texts = rows["text"].combine_chunks()
        every = np.arange(len(self.records))
        self.sketches = np.concatenate([_sketches(self.pieces(every[part])) for part in _chunks(len(every), SKETCH)], axis=1)

    def pieces(self, at: np.ndarray) -> list[np.ndarray]:
        return [piece_codes(text) for text in self.texts.take(pa.array(at)).to_pylist()]


class _Index:
    """The keys of those records of a shard that may be linked with training texts of ``low`` to ``high`` pieces."""

    def __init__(self, shard: _Shard, low: int, high: int) -> None:
        self.shard, self.parts = shard, _parts(high)
        at = np.nonzero((5 * shard.sizes >= 4 * low) & (4 * shard.sizes <= 5 * high))[0]
        width = self.parts * FOURTHS
        # The first half of a key, then the record; halves that are alike by chance cost a comparison.
        self.keys = np.empty(len(at) * width, dtype=np.uint64)
        for part in _chunks(len(at), width):
            rows = at[part]
            keys = _keys(shard.pieces(rows), self.parts) & HALF
            self.keys[part.start * width : part.start * width + keys.size] = (keys | rows.astype(np.uint64)[:, None]).ravel()
        self.keys.sort()
        # Most keys of a text are in no record: bits tell so for most of them.
        width = min(max(10, (4 * len(self.keys)).bit_length()), 25)
        self.shift = np.uint64(64 - width)
        self.bits = np.zeros(1 << width, dtype=bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def pairs(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, record): positions of linked pairs."""
        found: list[np.ndarray] = []
        keys = _keys(pieces, self.parts)
        rows, columns = np.nonzero(self.bits[(keys >> self.shift).astype(np.int64)])
        keys = keys[rows, columns] & HALF
        begin = np.searchsorted(self.keys, keys)
        met = self.keys[np.minimum(begin, len(self.keys) - 1)] & HALF == keys if len(self.keys) else keys != keys
        rows, begin, keys = rows[met], begin[met], keys[met]
        lengths = np.searchsorted(self.keys, keys | ~HALF, "right") - begin
        if not len(rows):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sizes, sketches, n = np.array([len(p) for p in pieces]), _sketches(pieces), len(self.shard.records)
        ends = np.cumsum(lengths)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], PAIRS)[1:]).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if low == high:
                continue
            of = lengths[low:high]
            owners = (self.keys[np.arange(of.sum()) + np.repeat(begin[low:high] - np.cumsum(of) + of, of)] & ~HALF).astype(np.int64)
            text, away = np.repeat(rows[low:high], of), np.zeros(len(owners), dtype=np.uint16)
            # Half of a sketch is enough for nearly all.
            for words in (range(SKETCH // 128), range(SKETCH // 128, SKETCH // 64)):
                for word in words:
                    away += np.bitwise_count(self.shard.sketches[word][owners] ^ sketches[word][text])
                near = 9 * away.astype(np.int64) <= self.shard.sizes[owners] + sizes[text]
                text, owners, away = text[near], owners[near], away[near]
            a, b = self.shard.sizes[owners], sizes[text]
            found.append((text * n + owners)[5 * np.minimum(a, b) >= 4 * np.maximum(a, b)])
        pair = np.unique(np.concatenate(found))
        text, record = pair // n, pair % n
        linked = [_linked(mine, pieces[t]) for part in _chunks(len(pair), SKETCH) for mine, t in zip(self.shard.pieces(record[part]), text[part].tolist(), strict=True)]
        linked = np.array(linked, dtype=bool)
        return text[linked], record[linked]


def _linked(mine: np.ndarray, own: np.ndarray) -> bool:
    """Whether two sets of pieces are similar enough, exactly."""
    place = np.searchsorted(mine, own)
    place[place == len(mine)] = 0
    both = int(np.count_nonzero(mine[place] == own))
    return 5 * both >= 4 * (len(mine) + len(own) - both)


_last: dict[tuple[str, int], _Shard] = {}
_last_index: dict[tuple[str, int, int], _Index] = {}


def _index(path: str, number: int, low: int, high: int) -> _Index:
    """An index, from the worker's memory if it or its shard is the one used last."""
    if (path, number, low) not in _last_index:
        _last_index.clear()
        if (path, number) not in _last:
            _last.clear()
            _last[path, number] = _Shard(path, number)
        _last_index[path, number, low] = _Index(_last[path, number], low, high)
    return _last_index[path, number, low]


def _scanning(shards: str, texts: str, tasks: list[tuple[int, int, int, str]]):
    """(a, b): linked pairs. Each input row is one shard against one class of one file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (n for batch in batches for n in batch.column("id").to_pylist()):
            number, low, high, name = tasks[task]
            fits = (ds.field("n_pieces") >= low) & (ds.field("n_pieces") <= high)
            for batch in _open(f"{texts}/{name}").to_batches(columns=["id", "text"], filter=fits):
                if not batch.num_rows:
                    continue
                index = _index(shards, number, low, high)
                for part in _chunks(batch.num_rows, index.parts * FOURTHS):
                    rows = batch.slice(part.start, part.stop - part.start)
                    text, record = index.pairs([piece_codes(t) for t in rows.column("text").to_pylist()])
                    if len(text):
                        yield _pairs(index.shard.records[record], rows.column("id").to_numpy()[text])

    return scan


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def merged_coverage(text: str, other: str) -> float:
    """Share of ``text`` inside passages that ``other`` holds too, overlapping ones merged."""
    if len(text) <= LENGTH:
        return 1.0 if text in other else 0.0
    held = {other[i : i + LENGTH] for i in range(len(other) - LENGTH + 1)}
    covered = reach = 0
    for i in range(len(text) - LENGTH + 1):
        if text[i : i + LENGTH] in held:
            covered += i + LENGTH - max(i, reach)
            reach = i + LENGTH
    return covered / len(text)


@F.pandas_udf(T.DoubleType())
def _coverage_udf(text: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([merged_coverage(a, b) for a, b in zip(text, other, strict=True)], dtype=float)


def split_overlap(records: DataFrame, id_column: str, dialogue: str, split: str, train: str, evaluation: str, scratch: Scratch) -> Overlap:
    """Pairs of a record of ``train`` and one of ``evaluation`` that are linked, with the latter's coverage.

    ``split`` holds plain labels; rows of other or null splits take no part. Records are
    linked if 0.8 or more of the distinct three-character pieces of either are in both.
    Records with a null id, a null or empty dialogue or fewer than three letters and
    digits are in no pair; a null turn text counts as empty; a record stored twice under one id counts
    once; an empty table or split gives an empty result. Texts are used whole. Equal
    texts are scanned once and expanded last.
    """
    named = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(dialogue).alias("__dialogue"), F.col(split).alias("__split"))
    sides = named.where(F.col("__split").isin(train, evaluation))
    rows = comparison_rows(sides.select(F.struct("__id", "__split").alias("key"), "__dialogue"), "key", "__dialogue")
    rows = scratch.save(rows.select("id.__id", "id.__split", "text", "digest"), "sides")

    distinct = rows.groupBy(F.col("__split").alias("split"), "digest").agg(F.first("text").alias("text"))
    distinct = distinct.select("split", "digest", "text", n_pieces_udf("text").alias("n_pieces"))
    classes = scratch.save(distinct.withColumn("id", F.monotonically_increasing_id()), "texts", SLICE)
    held, known = classes.where(F.col("split") == evaluation), classes.where(F.col("split") == train)

    spark = records.sparkSession
    sizes = {r.split: r for r in classes.groupBy("split").agg(F.count("*").alias("n"), F.max("n_pieces").alias("most")).collect()}
    n_of = {side: sizes[side].n if side in sizes else 0 for side in (train, evaluation)}
    shards = max(1, -(-n_of[evaluation] // SHARD))
    chosen = held.select(F.col("id").alias("a"), F.col("n_pieces").alias("n_a"), "text").repartitionByRange(shards, "n_a", "a").withColumn("shard", F.spark_partition_id())
    chosen = scratch.save(chosen, "shards")
    files = max(2 * spark.sparkContext.defaultParallelism, -(-n_of[train] // SLICE))
    by_size = scratch.save(known.select("id", "n_pieces", "text").repartitionByRange(files, "n_pieces", "id"), "by_size", SLICE)
    spans = chosen.groupBy("shard").agg(F.min("n_a").alias("lo"), F.max("n_a").alias("hi")).collect()
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    held_in = by_size.groupBy(name.alias("name")).agg(F.min("n_pieces").alias("lo"), F.max("n_pieces").alias("hi")).collect()
    bounds = _bounds(max((f.hi for f in held_in), default=1))
    tasks = []
    for f in held_in:
        first, last = np.searchsorted(bounds, [f.lo, f.hi], "right").tolist()
        for low, high in zip(bounds[first - 1 : last].tolist(), (bounds[first : last + 1] - 1).tolist(), strict=True):
            tasks += [(s.shard, low, high, f.name) for s in spans if 5 * s.hi >= 4 * max(low, f.lo) and 5 * min(high, f.hi) >= 4 * s.lo]
    tasks.sort()
    scan = _scanning(chosen._scratch_path, by_size._scratch_path, tasks)  # noqa: SLF001
    pairs = scratch.save(spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(scan, "a long, b long"), "pairs")
    scratch.drop(chosen, by_size)

    of_a = held.select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.col("digest").alias("d_a"))
    of_b = known.select(F.col("id").alias("b"), F.col("text").alias("text_b"), F.col("digest").alias("d_b"))
    linked = pairs.join(of_a, "a").join(of_b, "b")
    linked = scratch.save(linked.select("d_a", "d_b", _coverage_udf("text_a", "text_b").alias("coverage")), "linked")
    ids = scratch.save(rows.select("__id", "__split", "digest").distinct(), "ids")
    scratch.drop(rows, classes, pairs)
    of_train = ids.where(F.col("__split") == train).select(F.col("__id").alias("train_id"), F.col("digest").alias("d_b"))
    of_held = ids.where(F.col("__split") == evaluation).select(F.col("__id").alias("evaluation_id"), F.col("digest").alias("d_a"))
    return Overlap(linked.join(of_train, "d_b").join(of_held, "d_a").select("train_id", "evaluation_id", "coverage"))
