"""Comparison text of dialogues, its three-character pieces, and exact similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python calls alphanumeric: word characters but the low line.
_LETTERS_DIGITS = re.compile(r"[^\W_]+")


def comparison_text(text: str) -> str:
    """Compatibility form, lower case, letters and digits only."""
    return "".join(_LETTERS_DIGITS.findall(unicodedata.normalize("NFKC", text).lower()))


@F.pandas_udf(T.StringType())
def comparison_text_udf(texts: pd.Series) -> pd.Series:
    """``comparison_text`` of every value; null stays null."""
    return texts.map(comparison_text, na_action="ignore")


def joined_turns(dialogue: str) -> Column:
    """Turn texts in order as one string; null for a null or empty dialogue, null texts count as empty."""
    texts = F.transform(F.col(dialogue), lambda t: F.coalesce(t["text"], F.lit("")))
    return F.when(F.size(dialogue) > 0, F.concat_ws("", texts))


def piece_codes(text: str) -> np.ndarray:
    """Distinct three-character pieces as exact 63-bit codes, in order of code."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    codes = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    codes.sort()
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


@F.pandas_udf(T.IntegerType())
def n_pieces_udf(texts: pd.Series) -> pd.Series:
    """Number of distinct pieces of every text."""
    return texts.map(lambda t: len(piece_codes(t))).astype("int32")


def shared_and_union(left: str, right: str) -> tuple[int, int]:
    """Numbers of pieces found in both texts and in either."""
    a, b = piece_codes(left), piece_codes(right)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _linked(left: str | None, right: str | None) -> bool:
    if left is None or right is None:
        return False
    if left == right:
        return len(left) >= 3
    both, either = shared_and_union(left, right)
    # Whole numbers: 5 * both >= 4 * either is similarity >= 0.8 without rounding.
    return either > 0 and 5 * both >= 4 * either


@F.pandas_udf(T.BooleanType())
def linked_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the exact similarity of two comparison texts is at least 0.8."""
    return pd.Series([_linked(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


def exact_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, by ``texts`` (id, text)."""
    of_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(of_a, "a").join(of_b, "b").where(linked_udf("text_a", "text_b")).select("a", "b")


def in_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
