"""Checks of reports, releases and panels on literal cases."""

import pytest

from plumbline.operators import agreement, keywords, validators

ACTIONS = ("ANSWER", "CLARIFY", "REFUSE", "ESCALATE")


def test_counts_and_keys(spark):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    assert {r.name: r.n for r in validators.assert_counts(tables, {"a": 3}).collect()} == {"a": 3, "b": 2}
    with pytest.raises(Exception, match="b: 2 rows, not 5"):
        validators.assert_counts(tables, {"b": 5}).collect()
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":1,"b":null}',), ("{}",), (None,), ("x",)], "j string")
    assert {(tuple(r["keys"]), r.exact, r.n) for r in validators.key_sets(df, "j", ["a", "b"]).collect()} == {(("a", "b"), True, 2), ((), False, 3)}


def test_tolerance(spark):
    left = spark.createDataFrame([("m", 0.5, None), ("n", 0.1, 0.2)], "k string, x double, y double")
    right = spark.createDataFrame([("m", 0.5 + 1e-13, None), ("n", 0.1 + 1e-11, None), ("o", 1.0, 1.0)], "k string, x double, y double")
    found = {(r.k, r.metric): r.close for r in validators.beyond_tolerance(left, right, ["k"], ["x", "y"]).collect()}
    assert found == {("m", "x"): True, ("m", "y"): True, ("n", "x"): False, ("n", "y"): False, ("o", "x"): False, ("o", "y"): False}


def test_bindings_and_status(spark):
    schema = "name string, sha256 string"
    actual = spark.createDataFrame([("corpus", "ab"), ("more", "cd")], schema)
    assert validators.unbound(spark.createDataFrame([("corpus", "AB")], schema), actual).count() == 0
    validators.assert_bound(spark.createDataFrame([("corpus", "AB")], schema), actual)
    wrong = spark.createDataFrame([("corpus", "xx"), ("lost", "ab")], schema)
    assert {tuple(r) for r in validators.unbound(wrong, actual).collect()} == {("corpus", "digest differs"), ("lost", "no such file")}
    with pytest.raises(ValueError, match="lost"):
        validators.assert_bound(wrong, actual)
    assert validators.require_status("PASS", ["PASS"]) == "PASS"
    with pytest.raises(ValueError, match="none of"):
        validators.require_status(None, ["PASS"])


def test_adjudicated_rows(spark):
    five, four = {"ANSWER": 5}, {"ANSWER": 3, "REFUSE": 1}
    rows = [
        ("ok", "HIGH_CONFIDENCE", "ANSWER", ["ANSWER"], 4, 4.0, five, None, None), ("ok2", "UNRESOLVED", None, ["ANSWER", "REFUSE"], 2, 3.0, five, five, {"yes": 3, "no": 2}),
        ("few", "HIGH_CONFIDENCE", "ANSWER", ["ANSWER"], 3, 4.0, five, None, None), ("more", "HIGH_CONFIDENCE", "ANSWER", ["ANSWER", "REFUSE"], 4, 4.0, five, None, None), ("null", "HIGH_CONFIDENCE", None, None, None, None, five, None, None),
        ("act", "UNRESOLVED", "ANSWER", ["ANSWER"], 2, 3.0, five, None, None), ("none", "UNRESOLVED", None, [], 2, 3.0, five, None, None), ("odd", "UNRESOLVED", None, ["MAYBE"], 2, 3.0, five, None, None),
        ("r1", "UNRESOLVED", None, ["ANSWER"], 2, 3.0, four, None, None), ("r1null", "UNRESOLVED", None, ["ANSWER"], 2, 3.0, None, None, None), ("r2", "UNRESOLVED", None, ["ANSWER"], 2, 3.0, five, five, None), ("st", None, None, ["ANSWER"], 2, 3.0, five, None, None),
    ]
    schema = "scenario_id string, reference_status string, final_primary_action string, final_acceptable_actions array<string>, supporting_votes long, confidence_median double, round1_action_counts map<string,long>, round2_action_counts map<string,long>, round2_rule_acceptance_counts map<string,long>"
    found = {r.scenario_id: r.problem for r in validators.broken_adjudications(spark.createDataFrame(rows, schema), ACTIONS).collect()}
    assert found == {
        "few": "not high confidence", "more": "not high confidence", "null": "not high confidence", "act": "unresolved with an action", "none": "unresolved without known actions", "odd": "unresolved without known actions",
        "r1": "votes of round one", "r1null": "votes of round one", "r2": "votes of round two", "st": "unknown status",
    }


def test_second_rounds_and_summaries(spark):
    votes = spark.createDataFrame([(1, c, d, 3, True) for c, d in (("a", False), ("a", False))] + [(2, "a", False, 4, True), (2, "b", False, 5, False), (3, "c", False, 1, True), (4, "a", True, 2, False), (5, "a", None, 2, True)], "item int, c string, d boolean, s long, m boolean")
    acceptable = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"]), (4, ["a"])], "item int, acceptable array<string>")
    found = {(r.item, r.reason) for r in agreement.second_round(votes, "item", "c", "d", acceptable).collect()}
    assert found == {(2, "not unanimous"), (3, "outside the acceptable actions"), (4, "defect"), (5, "outside the acceptable actions")}
    one = agreement.rating_summary(votes, "item", "s", "m", "d").first()
    assert (one.items, one.ratings, one.mean_score, one.match_rate, one.defects, one.defect_items) == (5, 7, 20 / 7, 5 / 7, 1, 1)


def test_keyword_tokens(spark):
    df = spark.createDataFrame([("买A股 12.5 OTC",), ("",), (None,)], "t string").select(keywords.tokens(df_text()).alias("k"))
    assert [sorted(r.k) if r.k is not None else None for r in df.collect()] == [sorted(["u:买", "u:a", "u:股", "u:<num>", "u:otc", "b:买a", "b:a股", "b:股<num>", "b:<num>otc"]), [], None]


def df_text():
    from pyspark.sql import functions as F

    return F.col("t")
