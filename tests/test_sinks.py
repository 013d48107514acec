"""Layouts of tables and summaries, and appends that may be tried again."""

import pytest

from plumbline.sources import sinks


def test_layouts(spark):
    schema = "model string, view string, clarify_targets long, premature double, premature_low double, premature_high double, nonanswer_targets long, direct double, direct_low double, direct_high double"
    text = sinks.latex_layout(spark.createDataFrame([("m_1", "A&B", 12, 0.125, 0.1, 0.2, 30, 0.5, None, 1.0)], schema), sinks.RISK_TABLE)
    assert r"m\_1 & A\&B & 12 & 12.5 [10.0, 20.0] & 30 & 50.0 [--, 100.0] \\" in text
    assert text.startswith("\\begin{tabular}{llrrll}\n\\toprule\nCheckpoint & View") and text.endswith("bootstrap draws.\n")
    rows = [("a", "x", 0.5, 0.25, 0.0, 1.0), ("a", "y", 0.5, 0.25, 0.0, 1.0), ("b", "x", 0.5, 0.25, 0.0, 1.0)]
    text = sinks.latex_layout(spark.createDataFrame(rows, "model string, view string, accuracy double, macro_f1 double, unsafe_rate double, non_answer_rate double").coalesce(1), sinks.TRANSFER_TABLE)
    lines = text.splitlines()
    assert lines.count("\\midrule") == 2 and lines[lines.index(r"b & x & 50.00 & 25.00 & 0.00 & 100.00 \\") - 1] == "\\midrule"
    assert lines[0] == "\\begin{table}[t]" and lines[-1] == "\\end{table}"
    family = spark.createDataFrame([("Temporal flip", 3, "1 / 2", "a", "b", "c")], "diagnostic string, n long, dialogue_only string, state_only string, oracle_evidence string, state_oracle_evidence string")
    assert "Temporal flip (3) & 1 / 2 & a & b & c" in sinks.latex_layout(family, sinks.FAMILY_TABLE)
    assert "table*" in sinks.latex_layout(family, sinks.FAMILY_TABLE)


def test_plain_tables_and_summaries(spark):
    df = spark.createDataFrame([("a|b_", 0.12345, None)], "name string, rate double, more string")
    assert r"a|b\_ & 0.123 & -- \\" in sinks.latex_table(df, ["name", "rate", "more"])
    assert sinks.markdown_table(df, ["name", "rate"]).splitlines()[-1] == r"| a\|b_ | 0.123 |"
    assert sinks.markdown_summary(df, "T", "Lead.", "{name}: {rate:+pct1} points") == "# T\n\nLead.\n\n- a|b_: +12.3 points\n"


def test_a_batch_appended_again_is_there_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for rows, batch in (([1, 2], "b1"), ([3], "b2"), ([1, 2], "b1")):
        sinks.append_once(spark.createDataFrame([(r,) for r in rows], "k int"), path, batch)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="batch"):
        sinks.append_once(spark.createDataFrame([(1,)], "batch int"), path, "b3")
    with pytest.raises(ValueError, match="batch"):
        sinks.append_once(spark.createDataFrame([(1,)], "k int"), path, "../b3")
