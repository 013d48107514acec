"""Lexical edges between records: exact groups as stars, and MinHash candidates confirmed by Jaccard similarity.

A text has two sets: the character trigrams of its compact normal form, and its words and
ideographs with adjacent pairs of them. Each set is signed by MinHash; runs of ROWS values
are the buckets in which candidates meet. A pair at the threshold itself is missed by all
BANDS with a probability below a thousandth: (1 - 0.82^8)^32 for trigrams and
(1 - 0.88^8)^18 for words. All members of a bucket are compared with each other, in blocks
of bounded size, and every edge is confirmed on the sets themselves. Near edges are pairs, so
a family of n texts that are all alike gives n (n - 1) / 2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import normalized
from plumbline.scratch import Scratch

# Thresholds for character trigrams and for tokens.
CHAR_FROM, TOKEN_FROM = 0.82, 0.88
#: Values in a bucket's key, and keys from the trigrams and from the tokens.
ROWS, CHAR_BANDS, TOKEN_BANDS = 8, 32, 18
#: Members of one bucket compared in one block.
BLOCK = 2000
#: Single ideographs, and runs of other letters and digits.
_TOKEN = re.compile("<num>|[㐀-鿿]|(?:(?![㐀-鿿])[^\\W_])+")

_rng = np.random.default_rng(20270728)
_PERMUTATIONS = tuple(
    ((_rng.integers(0, 2**32, ROWS * bands, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), _rng.integers(0, 2**32, ROWS * bands, dtype=np.uint64).astype(np.uint32))
    for bands in (CHAR_BANDS, TOKEN_BANDS)
)
_SPREAD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trigrams(text: str) -> np.ndarray:
    """Distinct character trigrams without blanks, as exact codes in order."""
    points = np.frombuffer(text.replace(" ", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    return np.unique((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:])


def tokens(text: str) -> set[str]:
    """Distinct words and ideographs, and adjacent pairs of them."""
    single = _TOKEN.findall(text)
    return {*single, *(f"{a} {b}" for a, b in zip(single, single[1:], strict=False))}


def _token_codes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens(text)], dtype=np.uint64)


def _keys(codes: np.ndarray, which: int) -> np.ndarray:
    """Bucket keys of a set; none for an empty one."""
    multipliers, addends = _PERMUTATIONS[which]
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(multipliers), 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(codes), 4096):
        hashed = (_mixed(codes[start : start + 4096]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (hashed[:, None] * multipliers + addends).min(axis=0), out=least)
    bands = (least.reshape(-1, ROWS).astype(np.uint64) * _SPREAD).sum(axis=1, dtype=np.uint64)
    return _mixed(bands ^ _mixed(np.arange(len(bands), dtype=np.uint64) * np.uint64(2) + np.uint64(which + 1))).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys = ([], []), []
        for text in batch.column("t").to_pylist():
            sets = trigrams(text), _token_codes(text)
            for side, codes in zip(sizes, sets, strict=True):
                side.append(len(codes))
            keys.append(np.concatenate([_keys(codes, i) for i, codes in enumerate(sets)]).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes[0], pa.int32()), pa.array(sizes[1], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "g", "w", "keys"])


def jaccards(left: str, right: str) -> tuple[float, float]:
    """Similarity of the trigram sets and of the token sets; 0 for two empty ones."""
    a, b = trigrams(left), trigrams(right)
    both = len(np.intersect1d(a, b, assume_unique=True))
    x, y = tokens(left), tokens(right)
    shared = len(x & y)
    return both / max(1, len(a) + len(b) - both), shared / max(1, len(x) + len(y) - shared)


@F.pandas_udf(T.StructType([T.StructField("c", T.DoubleType()), T.StructField("w", T.DoubleType())]))
def _similarities(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jaccards(a, b) for a, b in zip(left, right, strict=True)], columns=["c", "w"], dtype=float)


def _meeting(heads: DataFrame) -> DataFrame:
    """(left_id, right_id), left smaller: pairs of ``heads`` (id, g, w, keys) that meet in a bucket and whose sizes allow a link, each once."""
    buckets = heads.select("id", "g", "w", F.explode(F.array_distinct("keys")).alias("k"))
    shared = buckets.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = buckets.join(shared, "k").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A member meets its own block and, as left side, the later ones, as right side the earlier ones.
    one = members.select("k", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("id", "g", "w")])
    other = members.select("k", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("id", "g", "w")])
    met = one.join(other, ["k", "i", "j"]).where("i < j OR id_a < id_b")
    # Two sets are at most as similar as their sizes; the least size is 0 only for sets without a link.
    alike = [(F.least(f"{c}_a", f"{c}_b") / F.nullif(F.greatest(f"{c}_a", f"{c}_b"), F.lit(0))) >= least for c, least in (("g", CHAR_FROM), ("w", TOKEN_FROM))]
    met = met.where(F.coalesce(alike[0], F.lit(False)) | F.coalesce(alike[1], F.lit(False)))
    return met.select(F.least("id_a", "id_b").alias("left_id"), F.greatest("id_a", "id_b").alias("right_id")).distinct()


def lexical_edges(records: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(left_id, right_id, edge_type, score): edges of three types, left smaller.

    Records with equal normal forms are exact: each to the first of its group. The first
    ones are compared further. Null texts have no edges. A key stored twice counts once. An
    empty table gives an empty result.
    """
    rows = records.select(F.col(key).alias("id"), normalized(F.col(text)).alias("t")).where("t IS NOT NULL AND t <> ''").dropDuplicates(["id"])
    # Read several times below, and its text comes from Python.
    hashed = scratch.save(rows.withColumn("h", F.unhex(F.sha2("t", 256))), "texts")
    firsts = hashed.groupBy("h").agg(F.min("id").alias("first"))
    exact = hashed.select("id", "h").join(firsts, "h").where("id <> first").select(F.col("first").alias("left_id"), F.col("id").alias("right_id"), F.lit("exact_semantic_signature").alias("edge_type"), F.lit(1.0).alias("score"))
    heads = hashed.select("id", "t").join(firsts.select(F.col("first").alias("id")), "id", "left_semi")
    kind = hashed.schema["id"].dataType.simpleString()
    pairs = _meeting(scratch.save(heads.mapInArrow(_signed, f"id {kind}, g int, w int, keys array<long>"), "signed"))
    a, b = (hashed.select(F.col("id").alias(f"{side}_id"), F.col("t").alias(f"t_{side}")) for side in ("left", "right"))
    scored = pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", _similarities("t_left", "t_right").alias("s"))
    options = F.array(
        F.when(F.col("s.c") >= CHAR_FROM, F.struct(F.lit("char_ngram").alias("edge_type"), F.col("s.c").alias("score"))),
        F.when(F.col("s.w") >= TOKEN_FROM, F.struct(F.lit("token_jaccard").alias("edge_type"), F.col("s.w").alias("score"))),
    )
    near = scored.select("left_id", "right_id", F.explode(F.array_compact(options)).alias("o")).select("left_id", "right_id", "o.*")
    return exact.unionAll(near)
