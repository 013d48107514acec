"""Every query of the core: against its SQL where it has one, else that it gives rows with stable columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import compare

from plumbline.plans import catalogue

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.SQL.items()}
EMPTY = {"cross_cluster_cover", "clause_overlap"}
pytestmark = pytest.mark.skipif(not compare.DATA.exists(), reason="no test tables")


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare.differences(spark, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, str(compare.DATA))
    assert df.columns and (df.count() > 0 or name in EMPTY)


def test_manifests_name_every_kind_of_problem(spark):
    found = {r.path: r.problem for r in QUERIES["table_files"](spark, str(compare.DATA)).collect() if r.problem}
    assert found == {"lost.parquet": "missing", "region.parquet": "undeclared", "nation.parquet": "size", "part.parquet": "content"}


def test_planted_texts_trip_every_pattern(spark):
    from plumbline.functions.text import PATTERNS

    found = {r.kind: r.n_findings for r in QUERIES["privacy_findings"](spark, str(compare.DATA)).where("place = 'planted'").collect()}
    assert set(found) == set(PATTERNS)
    kinds = {r.finding for r in QUERIES["policy_findings"](spark, str(compare.DATA)).where("place = 'planted'").collect()}
    assert kinds == {"nested archive", "operational marker", "local marker", "infrastructure", "personal data"}


def test_duplicate_forms_match_plain_python(spark):
    """Groups of dialogues with one normal form over the whole test table."""
    from plumbline.functions.text import normal_form

    rows = spark.read.parquet(f"{compare.DATA}/scenarios.parquet").select("dialogue", "label.primary_action").collect()
    groups = {}
    for r in rows:
        if r.dialogue:
            line = " ".join(" ".join(x for x in (t.role, t.text) if x is not None) for t in r.dialogue)
            groups.setdefault(normal_form(line), []).append(r.primary_action)
    sizes = {}
    for g in groups.values():
        if len(g) > 1:
            sizes[len(g)] = sizes.get(len(g), 0) + 1
    data = str(compare.DATA)
    assert {r["size"]: r.n_groups for r in QUERIES["duplicate_dialogues"](spark, data).collect()} == sizes
    found = QUERIES["duplicate_report"](spark, data).first()
    assert (found.distinct_texts, found.excess_rows) == (len(groups), sum(map(len, groups.values())) - len(groups))
    assert found.groups_cross_gold == sum(len(set(g)) > 1 for g in groups.values())


def test_normal_forms_match_a_character_loop(spark):
    """The whole test table against the definition, character by character."""
    import re
    import unicodedata

    def slow(line):
        value = re.sub(r"\d+(?:[./:-]\d+)*", "<num>", unicodedata.normalize("NFKC", line).lower())
        return " ".join("".join(c if c.isalnum() or c in "<>" or "\u3400" <= c <= "\u9fff" else " " for c in value).split())

    lines = {r.scenario_id: r.dialogue for r in spark.read.parquet(f"{compare.DATA}/scenarios.parquet").select("scenario_id", "dialogue").collect()}
    for r in QUERIES["normalized_dialogues"](spark, str(compare.DATA)).collect():
        dialogue = lines[r.scenario_id]
        expected = None if dialogue is None else slow(" ".join(" ".join(x for x in (t.role, t.text) if x is not None) for t in dialogue))
        assert r.text == expected


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
