"""Sinks: canonical JSON lines, reports, CSV, tables for documents, appends that never overwrite."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canonical import struct_json

#: Rows a report or a formatted table may have.
REPORT_ROWS = 10_000


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """Canonical lines, sorted keys, in ``order`` across all part files."""
    line = struct_json(F.struct(*sorted(df.columns)))
    df.orderBy(*order).select(line.alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """The named columns in order; a.b takes field b of struct a under the name a_b."""
    df.select(*[F.col(c).alias(c.replace(".", "_")) for c in columns]).write.mode(mode).option("header", "true").csv(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table; what is there stays."""
    df.write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, batch: str) -> None:
    """Add the rows of a named batch to a table; a batch tried again replaces itself, so it is there once.

    Readers get the name in the column ``batch``, a folder of the table, which ``df`` must not have.
    """
    if "batch" in df.columns or not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a column batch exists, or the name of the batch is no plain one")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def inside(root: str, path: str) -> str:
    """The absolute path, which must lie below ``root``."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return full


def _few(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows are no report")
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one indented JSON document; an existing file is refused."""
    rows = [r.asDict(recursive=True) for r in _few(df)]
    with open(path, "x", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False, indent=2, sort_keys=True, default=str)
        out.write("\n")


class _Cells(string.Formatter):
    """Format specs ``pct1`` (a share as a percentage with one digit), ``+pct1`` (with its sign) and the usual ones; null is --."""

    def format_field(self, value: Any, spec: str) -> str:
        if value is None:
            return "--"
        found = re.fullmatch(r"(\+?)pct(\d)", spec)
        return f"{100 * value:{found[1]}.{found[2]}f}" if found else super().format_field(value, spec)


_LATEX = {ord(c): f"\\{c}" for c in "&%$#_{}"} | {ord("\\"): r"\textbackslash{}", ord("~"): r"\textasciitilde{}", ord("^"): r"\textasciicircum{}"}


@dataclass(frozen=True)
class Layout:
    """A LaTeX table: headings, a template for each cell over a row's columns, and what stands around it.

    ``rule_at``: a rule is drawn before every row whose value of that column differs from
    the row before. ``caption`` and ``label`` make it a float, ``wide`` one over two columns;
    ``note`` is a comment after it.
    """

    align: str
    headings: Sequence[str]
    cells: Sequence[str]
    rule_at: str | None = None
    caption: str | None = None
    label: str | None = None
    wide: bool = False
    note: str | None = None


# The layouts of the published tables.
RISK_TABLE = Layout(
    "llrrll", ("Checkpoint", "View", "Clarify $n$", "Premature answer", "Non-answer $n$", "Direct answer"),
    ("{model}", "{view}", "{clarify_targets}", "{premature:pct1} [{premature_low:pct1}, {premature_high:pct1}]", "{nonanswer_targets}", "{direct:pct1} [{direct_low:pct1}, {direct_high:pct1}]"),
    note="Rates and 95% intervals are percentages from 10,000 held-out-component bootstrap draws.",
)
TRANSFER_TABLE = Layout(
    "llrrrr", ("Model", "View", "Acc.", "Macro-F1", "Unsafe", "Non-answer"), ("{model}", "{view}", "{accuracy:pct2}", "{macro_f1:pct2}", "{unsafe_rate:pct2}", "{non_answer_rate:pct2}"),
    rule_at="model", caption="Held-out transfer across information views, in percent.", label="tab:secondary-transfer",
)
FAMILY_TABLE = Layout(
    "@{}lrrrr@{}", ("Diagnostic (families/events)", "Dialogue", "State", "Evidence", "State+evidence"),
    ("{diagnostic} ({n})", "{dialogue_only}", "{state_only}", "{oracle_evidence}", "{state_oracle_evidence}"),
    caption="Held-out controlled-family diagnostics, in percent.", label="tab:family-diagnostics", wide=True,
)


def latex_layout(df: DataFrame, layout: Layout) -> str:
    """A small result in a layout, rows in the order of ``df``; texts are escaped, headings are not."""
    rows, cells = _few(df), _Cells()
    lines, before = [], None
    for i, row in enumerate(rows):
        values = {k: v.translate(_LATEX) if isinstance(v, str) else v for k, v in row.asDict().items()}
        if layout.rule_at and i and values[layout.rule_at] != before:
            lines.append(r"\midrule")
        before = values[layout.rule_at] if layout.rule_at else None
        lines.append(" & ".join(cells.vformat(c, (), values) for c in layout.cells) + r" \\")
    body = [f"\\begin{{tabular}}{{{layout.align}}}", r"\toprule", " & ".join(layout.headings) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"]
    if layout.caption:
        kind = "table*" if layout.wide else "table"
        body = [f"\\begin{{{kind}}}[t]", f"\\caption{{{layout.caption}}}", f"\\label{{{layout.label}}}", r"\centering", r"\small", *body, f"\\end{{{kind}}}"]
    if layout.note:
        body.append(f"% {layout.note}")
    return "\n".join(body) + "\n"


def latex_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A small result as a plain tabular of the named columns."""
    kinds = dict(df.dtypes)
    cells = [f"{{{c}:.{digits}f}}" if kinds[c] in ("double", "float") else f"{{{c}}}" for c in columns]
    return latex_layout(df.select(*columns), Layout("l" * len(columns), [c.translate(_LATEX) for c in columns], cells))


def markdown_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A small result as a Markdown table."""
    kinds, cells = dict(df.dtypes), _Cells()
    spec = {c: f"{{{c}:.{digits}f}}" if kinds[c] in ("double", "float") else f"{{{c}}}" for c in columns}
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for row in _few(df.select(*columns)):
        values = {k: v.replace("|", r"\|") if isinstance(v, str) else v for k, v in row.asDict().items()}
        lines.append("| " + " | ".join(cells.vformat(spec[c], (), values) for c in columns) + " |")
    return "\n".join(lines) + "\n"


def markdown_summary(df: DataFrame, title: str, lead: str, line: str) -> str:
    """A heading, a sentence, and one list item for each row by a template such as "{name}: {rate:pct1}%"."""
    cells = _Cells()
    items = [f"- {cells.vformat(line, (), row.asDict())}" for row in _few(df)]
    return "\n".join([f"# {title}", "", lead, "", *items]) + "\n"


def write_checksums(files: DataFrame, path: str) -> None:
    """Lines of digest and path of files (path, sha256), in order of path; an existing file is refused."""
    with open(path, "x", encoding="utf-8") as out:
        for row in sorted(_few(files.select("path", "sha256")), key=lambda r: r.path):
            out.write(f"{row.sha256}  {row.path}\n")
