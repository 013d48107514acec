"""Records that differ only in formatting, collapsed to one each with the number of copies."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pieces import in_batches
from plumbline.scratch import Scratch

# Marks of structure: control characters that are neither whitespace nor punctuation.
_NULL, _TURN, _OPEN, _CLOSE, _NEXT, _TEXT, _OTHER, _POINT, _MINUS, _ESCAPE, _RAW = map(chr, (2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17))
_MARKS = re.compile("[\x02-\x08\x0e-\x11]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_layouts: list[re.Pattern] = []


def _layout() -> list[re.Pattern]:
    """All whitespace and all of Unicode category P, in the basic plane and beyond.

    A class of the basic plane alone is one table lookup a character; beyond it is a list.
    """
    points = [chr(p) for p in range(sys.maxunicode + 1) if chr(p).isspace() or unicodedata.category(chr(p))[0] == "P"]
    planes = ("".join(c for c in points if (c > "\uffff") == beyond) for beyond in (False, True))
    return [re.compile("[" + re.escape(plane) + "]+") for plane in planes]


def _text(value: str) -> str:
    if _MARKS.search(value):
        value = _MARKS.sub(lambda m: _ESCAPE + chr(ord(m[0]) + 64), value)
    return value


def _walk(value: object, out: list[str]) -> None:
    if value is None:
        out.append(_NULL)
    elif isinstance(value, str):
        out += (_TEXT, _text(value))
    elif isinstance(value, dict):
        out.append(_OPEN)
        for key, inner in sorted(value.items(), key=lambda item: (plain(item[0]), item[0])):
            out += (_NEXT, _text(key))
            _walk(inner, out)
        out.append(_CLOSE)
    elif isinstance(value, list):
        out.append(_OPEN)
        for inner in value:
            out.append(_NEXT)
            _walk(inner, out)
        out.append(_CLOSE)
    else:  # numbers and booleans: their point and sign are not punctuation
        out += (_OTHER, json.dumps(value).replace(".", _POINT).replace("-", _MINUS))


def plain(text: str) -> str:
    """Without letter case, whitespace and punctuation marks."""
    if not _layouts:
        _layouts.extend(_layout())
    text = _layouts[0].sub("", text.casefold())
    return _layouts[1].sub("", text) if _ASTRAL.search(text) else text


def canonical_record(roles: list[str | None], texts: list[str | None], state: str | None) -> str:
    """One text that two records share exactly if they differ in formatting only.

    Turns keep their order; JSON fields are sorted; null, absent and every string stay
    apart. A state that is no JSON counts as one string.
    """
    out: list[str] = []
    for role, text in zip(roles, texts, strict=True):
        out.append(_TURN)
        _walk(role, out)
        _walk(text, out)
    out.append(_TURN)
    try:
        _walk(None if state is None else json.loads(state), out)
    except (ValueError, RecursionError):
        out += (_RAW, _text(state))
    return plain("".join(out))


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches, 4000):
        columns = (batch.column(c).to_pylist() for c in ("roles", "texts", "state"))
        found = [canonical_record(*row) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("raw"), batch.column("rep"), batch.column("n"), pa.array(found, pa.string())],
            names=["raw", "rep", "n", "canonical"],
        )


class Collapsed(NamedTuple):
    """``records``: (group_id, n_copies); ``members``: (group_id, id) of groups of two or more."""

    records: DataFrame
    members: DataFrame


def collapse_formatting(records: DataFrame, id_column: str, dialogue: str, state: str, scratch: Scratch) -> Collapsed:
    """One record for all that are equal but for letter case, whitespace, punctuation and JSON layout.

    Byte-identical rows are collapsed first, with counts; only the distinct survivors are
    parsed and brought to canonical text, and the counts are summed over equal canonical
    texts. The record's id is the smallest of its copies'. Null roles, texts and states
    are values of their own. Rows with a null or empty dialogue are compared with nothing:
    each is a record of one copy and no member. Rows without an id are no records. Rows repeated under one id are copies. An
    empty table gives empty results. Columns not named here are not read.
    """
    rows = records.select(F.col(id_column).alias("id"), F.col(dialogue).alias("d"), F.col(state).alias("s")).where("id IS NOT NULL")
    bare = rows.where("d IS NULL OR size(d) = 0")
    rows = rows.where("size(d) > 0")
    # JSON quotes what it holds, so equal digests are equal bytes in equal fields.
    options = {"ignoreNullFields": "false"}
    raw = F.unhex(F.sha2(F.to_json(F.struct("d", "s"), options).cast("binary"), 256)).alias("raw")
    first = F.first(F.struct("d", "s")).alias("first")
    survivors = rows.groupBy(raw).agg(F.min("id").alias("rep"), F.count("*").alias("n"), first)
    survivors = survivors.select(
        "raw", "rep", "n", F.col("first.d.role").alias("roles"), F.col("first.d.text").alias("texts"), F.col("first.s").alias("state")
    )
    canon = survivors.mapInArrow(_canonical, "raw binary, rep string, n long, canonical string")
    canon = scratch.save(canon, "canonical")
    groups = canon.groupBy("canonical").agg(F.min("rep").alias("group_id"), F.sum("n").alias("n_copies"))
    once = bare.select(F.col("id").alias("group_id"), F.lit(1).cast("long").alias("n_copies"))
    # From here on the canonical text is carried as its digest.
    digest = F.unhex(F.sha2(F.col("canonical").cast("binary"), 256)).alias("digest")
    several = groups.where("n_copies > 1").select(digest, "group_id")
    in_group = canon.select("raw", digest).join(several, "digest").select("raw", "group_id")
    members = rows.select("id", raw).join(in_group, "raw").select("group_id", "id").distinct()
    return Collapsed(groups.select("group_id", "n_copies").unionAll(once), members)
