"""Common forms of ids and labels in the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.labels import plain_label, sql_trimmed, upper_id
from plumbline.sources.tables import table

__all__ = ["edge_type", "plain_label", "sql_trimmed", "table", "upper_id"]


def edge_type(name: str) -> Column:
    """An edge type in its plain spelling."""
    return F.replace(plain_label(name), F.lit("-"), F.lit("_"))
