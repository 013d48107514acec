"""One consistent form of texts that look the same but are stored differently."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letters they are shaped like.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏү", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwly", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαιορνυϲ", "ABEZHIKMNOPTYXCjaiopvuc", strict=True))
_ARMENIAN = dict(zip("ՏՍՕօսցհոզ", "SUOoughnq", strict=True))
LOOKALIKES = str.maketrans(_CYRILLIC | _GREEK | _ARMENIAN)

#: Characters that have no width besides those of category Cf: grapheme joiner, Hangul
#: fillers, Mongolian and other variation selectors.
_WIDTHLESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Ids of one stored text that meet another's in one task.
BLOCK = 20_000
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: Code points beyond these ranges have no normalization of their own.
_RANGES = (range(0x30000), range(0xE0000, 0xE1000))


def _second_parts() -> set[str]:
    """Characters that may join the one before them (quick check: maybe)."""
    found = {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for point in range(0x30000):
        parts = unicodedata.decomposition(chr(point))
        if parts and parts[0] != "<" and " " in parts:
            found.add(chr(int(parts.split()[1], 16)))
    return found


def _is_widthless(char: str) -> bool:
    # Cf also holds visible signs of Arabic and other scripts; those have a width.
    return ord(char) in _WIDTHLESS or (
        unicodedata.category(char) == "Cf" and not (0x0600 <= ord(char) <= 0x0605 or ord(char) in (0x06DD, 0x070F, 0x08E2))
    )


def _recomposed(text: str) -> str:
    """``text`` composed again from its parts with Latin shapes."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text).translate(LOOKALIKES))


class _Form:
    """Patterns of the unstable segments, built once for each worker."""

    def __init__(self) -> None:
        seconds, unstable, nothing = _second_parts(), [], []
        for span in _RANGES:
            for point in span:
                char = chr(point)
                if 0xD800 <= point < 0xE000:
                    continue
                if _is_widthless(char):
                    nothing.append(char)
                elif (
                    unicodedata.combining(char)
                    or char in seconds
                    or point in LOOKALIKES
                    or (unicodedata.category(char) == "Zs" and char != " ")
                    # Also tells composed letters whose base letter is one of LOOKALIKES.
                    or _recomposed(char) != char
                ):
                    unstable.append(char)
        # An unstable segment takes the stable character before it along: what follows a
        # segment starts a new one and cannot join it.
        # A class of the basic plane alone is one table lookup a character.
        low = [c for c in unstable + nothing if c <= "\uffff"]
        self.low_segment = re.compile(f".?{_as_class(low)}+", re.DOTALL)
        self.segment = re.compile(f".?{_as_class(unstable + nothing)}+", re.DOTALL)
        self.widthless = re.compile(f"{_as_class(nothing)}+")

    def canonical(self, segment: str) -> str:
        """A segment without widthless characters, composed, with Latin shapes and plain blanks."""
        text = _recomposed(self.widthless.sub("", segment))
        return "".join(" " if unicodedata.category(c) == "Zs" else c for c in text)


def _as_class(chars: list[str]) -> str:
    points, spans = sorted(map(ord, chars)), []
    for point in points:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


@lru_cache(maxsize=1)
def _form() -> _Form:
    return _Form()


@lru_cache(maxsize=200_000)
def _segment(text: str) -> str:
    return _form().canonical(text)


def _spliced(match: re.Match) -> str:
    found = match[0]
    # Only short segments are worth remembering; long ones would fill the memory.
    return _segment(found) if len(found) <= 16 else _form().canonical(found)


def consistent_form(text: str) -> str:
    """``text`` in the one form all equal-looking texts share.

    Compatibility composition; special blanks as the plain blank; letters shaped like
    Latin ones as those; no characters without width. Letter case, punctuation, plain
    blanks and line breaks stay. Only unstable segments are rewritten; a text without
    any is returned as it is.
    """
    if text.isascii():
        return text
    form = _form()
    return (form.segment if _ASTRAL.search(text) else form.low_segment).sub(_spliced, text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def consistent_turns(turns: pd.Series) -> pd.Series:
    """``consistent_form`` of every text of every array; nulls stay null."""
    return turns.map(lambda ts: None if ts is None else [None if t is None else consistent_form(t) for t in ts])


def equal_looking(records: DataFrame, id_column: str, dialogue: str) -> DataFrame:
    """(left_id, right_id), left smaller: dialogues that look the same turn by turn but are stored differently.

    Null ids and null or empty dialogues are in no pair; a null turn text equals only a null one;
    rows repeated under one id count once; an empty table gives an empty result.

    Equal stored texts are one class. Classes of one form meet first, each pair of them
    once, as digests; their ids are joined to a pair of classes last, in blocks of BLOCK
    ids, so the work is that of writing the answer and no key holds more than a block.
    """
    rows = records.select(F.col(id_column).alias("id"), F.col(f"{dialogue}.text").alias("turns")).where("id IS NOT NULL AND size(turns) > 0")

    def digest(column: str) -> Column:
        return F.unhex(F.sha2(F.to_json(F.struct(F.col(column).alias("t")), {"ignoreNullFields": "false"}).cast("binary"), 256))

    rows = rows.withColumn("form", consistent_turns("turns"))
    keyed = rows.select("id", digest("form").alias("form"), digest("turns").alias("raw"))
    keyed = keyed.groupBy("form", "raw", "id").agg(F.count("*").alias("copies")).drop("copies")
    classes = keyed.groupBy("form", "raw").agg(F.count("*").alias("n_ids"))
    varied = classes.groupBy("form").agg(F.count("*").alias("n_raws")).where("n_raws > 1").select("form")
    blocks = F.ceil(F.col("n_ids") / BLOCK).cast("int").alias("blocks")
    classes = classes.join(varied, "form", "left_semi").select("form", "raw", blocks)

    def every(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    pairs = classes.toDF("form", "raw_l", "blocks_l").join(classes.toDF("form", "raw_r", "blocks_r"), "form").where("raw_l < raw_r")
    pairs = pairs.withColumn("block_l", every("blocks_l")).withColumn("block_r", every("blocks_r"))
    members = keyed.join(classes, ["form", "raw"]).select("form", "raw", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    found = pairs.join(members.toDF("form", "raw_l", "block_l", "one"), ["form", "raw_l", "block_l"])
    found = found.join(members.toDF("form", "raw_r", "block_r", "two"), ["form", "raw_r", "block_r"]).where("one <> two")
    return found.select(F.least("one", "two").alias("left_id"), F.greatest("one", "two").alias("right_id")).distinct()
