"""Common forms of ids and labels, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL_BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(column: Column | str) -> Column:
    """Without outer whitespace of any kind."""
    return F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", "")


def upper_id(column: Column | str) -> Column:
    """An id as it compares: trimmed, upper case."""
    return F.upper(trimmed(column))


def plain_label(column: Column | str) -> Column:
    """A label as it compares: trimmed, lower case."""
    return F.lower(trimmed(column))


def sql_trimmed(expression: str) -> str:
    """SQL for ``trimmed``; DuckDB's blank class is ASCII only, so the others are listed."""
    return f"regexp_replace({expression}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_upper(expression: str) -> str:
    """SQL for ``upper_id``."""
    return f"upper({sql_trimmed(expression)})"


def sql_plain(expression: str) -> str:
    """SQL for ``plain_label``."""
    return f"lower({sql_trimmed(expression)})"
