"""Every data-preparation query: against its SQL where it has one, else that it runs over whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import compare

from plumbline.llm import catalogue
from plumbline.llm.pieces import comparison_text

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not compare.DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare.differences(spark, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, str(compare.DATA)).count() > 0


def test_pairs_across_splits_against_every_pair(spark):
    """Over the whole test table: the smaller id left, and the pairs that comparing all dialogues gives."""
    rows = spark.read.parquet(f"{compare.DATA}/scenarios.parquet").select("scenario_id", "split", "dialogue").collect()
    sets = []
    for r in rows:
        text = comparison_text("".join(t.text or "" for t in r.dialogue or ()))
        sets.append((r.scenario_id, (r.split or "").strip().lower(), {text[i : i + 3] for i in range(len(text) - 2)}))
    expected = set()
    for i, (one, split, a) in enumerate(sets):
        for two, other, b in sets[i + 1 :]:
            if {split, other} == {"development", "heldout"} and a and b and 5 * len(a & b) >= 4 * len(a | b):
                expected.add((min(one, two), max(one, two)))
    found = [tuple(r) for r in QUERIES["p3_found"](spark, str(compare.DATA)).select("left_id", "right_id").collect()]
    assert set(found) == expected and len(found) == len(expected) and expected


def test_nothing_else_imports_the_package():
    root = Path(__file__).resolve().parent.parent.parent / "plumbline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "plumbline.llm" not in path.read_text(encoding="utf-8"), path
