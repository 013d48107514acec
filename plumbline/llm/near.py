"""Groups of records whose texts share most of their pieces.

1. Equal comparison texts become one class each, by a 256-bit digest.
2. Each class gets MinHash values over its pieces. BANDS runs of ROWS values are the
   buckets in which candidates meet; a pair of similarity 0.8 misses all of them with a
   probability of about 5e-6, one of 0.3 meets with about 3 percent. For much larger
   collections raise both together.
3. A second set of MinHash values is folded into an odd sketch: each value flips one of
   512 bits. The number of bits in which two sketches differ estimates how many values
   differ, so one XOR and a population count tell candidates worth an exact check.
4. In every bucket each member is checked against the bucket's first member. That links
   a family of copies with as many checks as members, whatever its size. Then only
   buckets that still hold several groups are searched for the pairs across groups: what
   is outside the largest group against all members, in blocks of bounded size. No pair
   that met in a bucket goes unchecked, and a family that fills a bucket is not compared
   with itself.
5. Sketches only discard: every link is confirmed on the exact pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.pieces import comparison_text_udf, exact_links, in_batches, joined_turns, piece_codes
from plumbline.scratch import Scratch

ROWS, BANDS = 6, 40
SAMPLES, BITS = 128, 512
#: Sketches that differ in more bits are discarded. At similarity 0.8 about 26 of 128 values
#: differ, which leaves 46 differing bits with a standard deviation of 9; the limit is six
#: of those away and stands for an estimated similarity of 0.5.
MOST_BITS = 100
#: Members of one bucket compared in one block.
BLOCK = 2000

_rng = np.random.default_rng(20270727)
_MULTIPLIERS = (_rng.integers(0, 2**32, ROWS * BANDS + SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADDENDS = _rng.integers(0, 2**32, ROWS * BANDS + SAMPLES, dtype=np.uint64).astype(np.uint32)
_SPREAD = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minima(codes: np.ndarray) -> np.ndarray:
    """All MinHash values of one piece set; long sets in chunks, so memory stays bounded."""
    least = np.full(len(_MULTIPLIERS), 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(codes), 4096):
        hashed = (_mixed(codes[start : start + 4096]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (hashed[:, None] * _MULTIPLIERS + _ADDENDS).min(axis=0), out=least)
    return least


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, bucket keys and odd sketch of each text."""
    band_ids = np.arange(BANDS, dtype=np.uint64)
    for batch in in_batches(batches, 2000):
        texts = batch.column("text").to_pylist()
        minima = np.empty((len(texts), len(_MULTIPLIERS)), dtype=np.uint32)
        sizes = np.empty(len(texts), dtype=np.int32)
        for i, text in enumerate(texts):
            codes = piece_codes(text)
            sizes[i], minima[i] = len(codes), _minima(codes)
        values = minima[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = _mixed((values * _SPREAD).sum(axis=2, dtype=np.uint64) ^ _mixed(band_ids + np.uint64(1)))
        # Which bit a value flips depends on the value and on which MinHash it is of.
        sample = minima[:, ROWS * BANDS :].astype(np.uint64)
        bit = (_mixed(sample | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
        flips = np.zeros((len(texts), BITS), dtype=np.int64)
        np.add.at(flips, (np.repeat(np.arange(len(texts)), SAMPLES), bit.ravel()), 1)
        sketch = np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.int64)

        def lists(table: np.ndarray) -> pa.ListArray:
            offsets = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(table).ravel()))

        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("text"), pa.array(sizes), lists(keys.view(np.int64)), lists(sketch)],
            names=["digest", "text", "n_pieces", "buckets", "sketch"],
        )


def _differing(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    total = words[0]
    for word in words[1:]:
        total = total + word
    return total


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a similarity of 0.8; columns n_a, n_b, sk_a, sk_b are used up."""
    sizes = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"
    return pairs.where(sizes).where(_differing("sk_a", "sk_b") <= MOST_BITS).select("a", "b")


def comparison_rows(records: DataFrame, id_column: str, dialogue: str) -> DataFrame:
    """(id, text, digest) of every record with at least one piece."""
    rows = records.select(F.col(id_column).alias("id"), joined_turns(dialogue).alias("raw")).where("raw IS NOT NULL AND id IS NOT NULL")
    rows = rows.select("id", comparison_text_udf("raw").alias("text")).where("length(text) >= 3")
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def near_groups(records: DataFrame, id_column: str, dialogue: str, scratch: Scratch) -> DataFrame:
    """(group_id, id): members of groups of two or more records linked directly or through others.

    Two records are linked if at least 0.8 of the distinct three-character pieces of either
    are found in both. Records with a null id, a null or empty dialogue or fewer than three letters
    and digits have no pieces and are in no group; a null turn text counts as empty. A
    record repeated under the same id counts once; ``group_id`` is the smallest id. An
    empty table gives an empty result. Other columns, whatever their names, are not read.
    Texts are used whole.
    """
    rows = scratch.save(comparison_rows(records, id_column, dialogue), "rows")
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    signed = distinct.mapInArrow(_signed, "digest binary, text string, n_pieces int, buckets array<long>, sketch array<long>")
    classes = scratch.save(signed.withColumn("id", F.monotonically_increasing_id()), "classes")
    sketches = classes.select("id", F.col("n_pieces").alias("n"), F.col("sketch").alias("sk"))
    of_a = sketches.toDF("a", "n_a", "sk_a")
    of_b = sketches.toDF("b", "n_b", "sk_b")
    texts = classes.select("id", "text")

    met = classes.select("id", F.explode("buckets").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n_members"), F.min("id").alias("a"))
    members = scratch.save(met.join(shared.where("n_members > 1").drop("n_members"), "bucket"), "members")

    to_first = members.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    first_links = scratch.save(exact_links(_promising(to_first.join(of_a, "a").join(of_b, "b")), texts), "links")
    grouped = scratch.save(components(first_links, "a", "b", scratch), "grouped")

    # Buckets that still hold several groups, each member with its group.
    labelled = members.join(grouped, "id", "left").select("bucket", "id", F.coalesce("group_id", "id").alias("label"))
    groups = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n_same"))
    open_buckets = groups.groupBy("bucket").agg(
        F.max_by("label", "n_same").alias("main"), F.sum("n_same").alias("n_all"), (F.sum("n_same") - F.max("n_same")).alias("n_rest")
    )
    # A pair across groups has at least one end outside the bucket's largest group, so a
    # family that fills a bucket is compared with what is left there, not with itself.
    left_over = labelled.join(open_buckets.where("n_rest > 0"), "bucket").join(sketches, "id")
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("n_all", "n_rest")]
    left_over = scratch.save(left_over.select("bucket", "id", "label", "main", "n", "sk", *blocks), "open")

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    one = left_over.where("label <> main").select(
        "bucket", own("n_rest").alias("i"), every("n_all").alias("j"), F.col("id").alias("a"), F.col("label").alias("g_a"), F.col("n").alias("n_a"), F.col("sk").alias("sk_a")
    )
    other = left_over.select(
        "bucket", every("n_rest").alias("i"), own("n_all").alias("j"), F.col("id").alias("b"), F.col("label").alias("g_b"), F.col("n").alias("n_b"), F.col("sk").alias("sk_b")
    )
    across = _promising(one.join(other, ["bucket", "i", "j"]).where("g_a <> g_b"))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more_links = exact_links(across, texts)

    # Links across groups tie whole groups together, so only group labels meet here.
    label_of = classes.select("id").join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("label"))
    tied = more_links.join(label_of.toDF("a", "l"), "a").join(label_of.toDF("b", "r"), "b").select("l", "r").distinct()
    merged = components(tied, "l", "r", scratch).select(F.col("id").alias("label"), F.col("group_id").alias("merged"))
    class_of = label_of.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("class_id"))
    class_of = classes.select("id", "digest").join(class_of, "id").select("digest", "class_id")
    ids = rows.select("id", "digest").distinct().join(class_of, "digest")
    ids = scratch.save(ids.select("id", "class_id"), "ids")
    scratch.drop(rows, classes, members, first_links, grouped, left_over)
    sizes = ids.groupBy("class_id").agg(F.min("id").alias("group_id"), F.count("*").alias("n_members")).where("n_members > 1")
    return ids.join(sizes, "class_id").select("group_id", "id")
