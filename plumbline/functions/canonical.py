"""Canonical JSON, digests, key walks and action parsing."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct_json(column: Column) -> Column:
    """JSON of a struct whose fields are declared in sorted order: no blanks, nulls kept, non-ASCII kept."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def exact_json(text: Column) -> Column:
    """JSON that ``struct_json`` wrote, with the spelling Python gives control characters.

    Only rows that hold an escaped one go through Python.
    """
    return F.coalesce(canonical(F.when(F.contains(text, F.lit("\\u00")), text)), text)


def text_json(text: Column) -> Column:
    """A text as a JSON value; null for null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def object_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object of JSON texts, keys sorted; a null text is a null."""
    parts = []
    for key in sorted(fields):
        parts += [F.lit(("," if parts else "{") + json.dumps(key, ensure_ascii=False) + ":"), F.coalesce(fields[key], F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def canonical_json(text: str) -> str | None:
    """Any JSON text with keys sorted at every level and no blanks; None if it is no JSON."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """``canonical_json`` of each text, for open objects; null for null and for no JSON."""
    return texts.map(canonical_json, na_action="ignore")


def digest(json_text: Column) -> Column:
    """SHA-256 of a canonical JSON text."""
    return F.sha2(json_text.cast("binary"), 256)


def string_digest(text: Column) -> Column:
    """Digest of a string as a JSON value, quotes and escapes included."""
    as_json = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.sha2(F.regexp_extract(as_json, r"(?s)^\{\"v\":(.*)\}$", 1).cast("binary"), 256)


def _keys(value: object, out: set[str]) -> None:
    if isinstance(value, dict):
        for key, inner in value.items():
            out.add(key)
            _keys(inner, out)
    elif isinstance(value, list):
        for inner in value:
            _keys(inner, out)


def all_keys(text: str) -> list[str]:
    """Every key at any depth, sorted; none for what is no JSON."""
    found: set[str] = set()
    try:
        _keys(json.loads(text), found)
    except (ValueError, RecursionError):
        return []
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_keys(texts: pd.Series) -> pd.Series:
    """``all_keys`` of each text; null for null."""
    return texts.map(lambda t: None if t is None else all_keys(t))


def read_action(content: str | None, actions: Sequence[str]) -> tuple[str | None, list[str]]:
    """(action, errors) of a response that should be one JSON object with the key action alone.

    The last of duplicate keys counts; trailing text is no JSON; other keys are an error
    but keep the action.
    """
    if content is None:
        return None, ["no_content"]
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return None, ["json_decode"]
    if not isinstance(value, dict):
        return None, ["not_object"]
    errors = [] if list(value) == ["action"] else ["keys_must_equal_action"]
    action = value.get("action")
    if isinstance(action, str) and action in actions:
        return action, errors
    return None, [*errors, "invalid_action"]


def parsed_action(actions: Sequence[str]):
    """A pandas UDF for ``read_action``."""

    @F.pandas_udf(T.StructType([T.StructField("action", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]))
    def parse(contents: pd.Series) -> pd.DataFrame:
        found = [read_action(c, actions) for c in contents]
        return pd.DataFrame({"action": [a for a, _ in found], "errors": [e for _, e in found]})

    return parse


def message_content(response: Column) -> Column:
    """Content of the first choice of a chat completion's JSON."""
    return F.try_variant_get(F.try_parse_json(response), "$.choices[0].message.content", "string")


def event_status(api_error: Column, action: Column, errors: Column) -> Column:
    """Transport failure, no valid action in the answer, or a valid action."""
    return F.when(api_error.isNotNull(), "FAIL_TRANSPORT").when(action.isNull() | (F.size(errors) > 0), "COMPLETE_INVALID_ACTION").otherwise("PASS_VALID_ACTION")
