"""Rules: every operator, missing against null, short circuits, merging, refusals."""

import datetime as dt
import json

import pytest

from plumbline.operators import rules as engine

FIELDS = ("state.a.x", "state.a.y", "state.b.when")


def payload(action="ANSWER", severity="none", controls=(), tags=()):
    return {"action": action, "severity": severity, "control_actions": list(controls), "violation_tags": list(tags)}


def rule(rule_id="R", when=(), action="ANSWER", severity="none", controls=(), tags=(), **more):
    base = {
        "schema_version": "0.2.0", "rule_id": rule_id, "source_clause_ids": ["S:1"], "jurisdiction": "CN", "binding_status": "binding", "effective_from": "2020-01-01", "effective_to": None,
        "global_scope": True, "scope": [], "required_fields": [], "branches": [{"when": list(when)} | payload(action, severity, controls, tags)], "fallback": None,
    }
    return base | more


def fact(field="state.a.x", owner="system", askable=False, unknown=("unknown",), action="ESCALATE", severity="high"):
    return {"field": field, "owner": owner, "askable": askable, "unknown_values": list(unknown), "on_missing": action, "severity": severity}


def decisions(spark, rules, *states, date=dt.date(2022, 5, 5), **more):
    rows = [(i, s if isinstance(s, str) or s is None else json.dumps(s), date) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "id int, state string, decision_date date")
    return engine.decide(df, rules, FIELDS, **more).orderBy("id").collect()


def run(spark, rules, *states, **more):
    return [(r.decision.primary_action if r.decision else None, r.error) for r in decisions(spark, rules, *states, **more)]


@pytest.mark.parametrize(("p", "state", "hit"), [
    ({"field": "state.a.x", "op": "eq", "value": "v"}, {"a": {"x": "v"}}, True),
    ({"field": "state.a.x", "op": "eq", "value": None}, {"a": {"x": None}}, True),
    ({"field": "state.a.x", "op": "neq", "value": "v"}, {"a": {"x": None}}, True),
    ({"field": "state.a.x", "op": "in", "value": ["v", "w"]}, {"a": {"x": None}}, False),
    ({"field": "state.a.x", "op": "in", "value": ["v", None]}, {"a": {"x": None}}, True),
    ({"field": "state.a.x", "op": "not_in", "value": ["v"]}, {"a": {"x": None}}, True),
    ({"field": "state.a.x", "op": "is_unknown"}, {}, True),
    ({"field": "state.a.x", "op": "is_unknown"}, {"a": {"x": "missing"}}, True),
    ({"field": "state.a.x", "op": "not_unknown"}, {"a": {"x": "v"}}, True),
    ({"field": "state.a.x", "op": "not_unknown"}, {"a": {"x": "unknown"}}, False),
    ({"field": "state.b.when", "op": "date_on_or_after", "value": "2020-02-29"}, {"b": {"when": "2020-02-29"}}, True),
    ({"field": "state.b.when", "op": "date_before", "value": "2020-02-29"}, {"b": {"when": "2020-02-29"}}, False),
    ({"field": "decision_date", "op": "date_between", "value": ["2022-05-05", "2022-05-05"]}, {}, True),
    ({"field": "decision_date", "op": "eq", "value": "2022-05-05"}, {}, True),
    ({"field": "state.a.x", "op": "eq", "value": 1}, {"a": {"x": 1.0}}, True),
    ({"field": "state.a.x", "op": "eq", "value": 1}, {"a": {"x": "1"}}, False),
    ({"field": "state.a.x", "op": "eq", "value": "1"}, {"a": {"x": 1}}, False),
    ({"field": "state.a.x", "op": "eq", "value": "null"}, {"a": {"x": None}}, False),
    ({"field": "state.a.x", "op": "in", "value": [True, "v"]}, {"a": {"x": True}}, True),
    ({"field": "state.a.x", "op": "in", "value": [["p", "q"]]}, {"a": {"x": ["p", "q"]}}, True),
    ({"field": "state.a.x", "op": "not_in", "value": [2.5]}, {"a": {"x": 2.5}}, False),
    ({"field": "state.a.x", "op": "is_unknown"}, {"a": "no object"}, True),
])
def test_operators(spark, p, state, hit):
    assert run(spark, [rule(when=[p])], state) == [("ANSWER", None) if hit else (None, "no candidate")]


def test_missing_path_is_an_error_unless_cut_short(spark):
    first, second = {"field": "state.a.x", "op": "eq", "value": "v"}, {"field": "state.a.y", "op": "eq", "value": "v"}
    found = run(spark, [rule(when=[first, second])], {"a": {"x": "v"}}, {"a": {"x": "other"}}, {"a": {"x": "v", "y": None}})
    assert found == [(None, "missing path state.a.y"), (None, "no candidate"), (None, "no candidate")]


def test_dates_only_in_full_form(spark):
    p = {"field": "state.b.when", "op": "date_before", "value": "2030-01-01"}
    assert run(spark, [rule(when=[p])], {"b": {"when": "20240101"}}, {"b": {"when": "2024-1-1"}}) == [(None, "no date at state.b.when")] * 2


def test_merge_takes_strictest_and_unions(spark):
    rules = [
        rule("B", action="REFUSE", severity="low", controls=["HUMAN_REVIEW"], tags=["t2"]), rule("A", action="CLARIFY", severity="critical", controls=["COMPLIANCE_ALERT"], tags=["t1", "t2"]),
        rule("C", binding_status="non_binding", action="REFUSE", severity="critical"),
    ]
    found = decisions(spark, rules, "{}")[0].decision.asDict()
    assert found == {
        "primary_action": "REFUSE", "acceptable_actions": ["REFUSE"], "control_actions": ["COMPLIANCE_ALERT", "HUMAN_REVIEW"], "severity": "critical", "violation_tags": ["t1", "t2"],
        "controlling_rule_ids": ["A", "B"], "controlling_predicates": ["branch:0"], "oracle_version": "0.2.0", "ambiguity": "exact",
    }


def test_predicates_are_those_of_the_branch_that_matched(spark):
    """As text field:operator:value, the value as Python prints it; the scope is not among them."""
    scope = [{"field": "state.a.x", "op": "in", "value": ["v", "w"]}]
    first = {"when": [{"field": "state.a.y", "op": "not_unknown"}, {"field": "state.a.x", "op": "in", "value": ["v", None, True]}]} | payload()
    second = {"when": []} | payload("CLARIFY", "low")
    found = decisions(spark, [rule(global_scope=False, scope=scope, branches=[first, second])], {"a": {"x": "v", "y": 1}}, {"a": {"x": "w", "y": None}})
    assert found[0].decision.controlling_predicates == ["branch:1", "state.a.x:in:['v', None, True]", "state.a.y:not_unknown:"]
    assert found[1].decision.controlling_predicates == ["branch:1"] and found[0].decision.primary_action == "CLARIFY"


def test_period_and_fallback(spark):
    assert run(spark, [rule(effective_to="2021-01-01")], {}) == [(None, "no candidate")]
    assert run(spark, [rule(effective_from="2022-05-05", effective_to="2022-05-05")], {}) == [("ANSWER", None)]
    never = [{"field": "decision_date", "op": "date_before", "value": "1990-01-01"}]
    found = decisions(spark, [rule("Q", never, fallback=payload("ESCALATE", "high", ["HUMAN_REVIEW"], ["t"]))], {})[0].decision
    assert (found.primary_action, found.controlling_predicates, found.violation_tags) == ("ESCALATE", ["scope_fallback"], ["t"])


def test_required_facts(spark):
    """A rule's own unknown values count, the tags stay empty, and an absent path is an error."""
    escalating = rule("Q", required_fields=[fact(unknown=["lost", None])], fallback=payload("REFUSE", "critical"))
    found = decisions(spark, [escalating], {"a": {"x": "lost"}}, {"a": {"x": None}}, {"a": {"x": "unknown"}}, {})
    assert [(r.decision.primary_action, r.decision.control_actions, r.decision.severity) if r.decision else r.error for r in found] == [
        ("ESCALATE", ["HUMAN_REVIEW"], "high"), ("ESCALATE", ["HUMAN_REVIEW"], "high"), ("ANSWER", [], "none"), "missing path state.a.x",
    ]
    assert found[0].decision.controlling_predicates == ["branch:0", "missing:state.a.x"] and found[0].decision.violation_tags == []
    asking = rule(when=[{"field": "state.a.y", "op": "eq", "value": "no"}], required_fields=[fact(owner="user", askable=True, action="CLARIFY", severity="low")])
    found = decisions(spark, [asking], {"a": {"x": "unknown", "y": ""}})[0].decision
    assert (found.primary_action, found.control_actions, found.controlling_predicates) == ("CLARIFY", [], ["missing:state.a.x"])


def test_no_date_is_an_error_once_a_rule_binds(spark):
    assert run(spark, [rule()], {}, date=None) == [(None, "no date at decision_date")]
    assert run(spark, [rule(binding_status="non_binding")], {}, date=None) == [(None, "no candidate")]


def test_bad_states_and_empty_table(spark):
    assert run(spark, [rule()], "no json", None) == [(None, "state is no JSON")] * 2
    assert run(spark, [rule()]) == []
    with pytest.raises(Exception, match="state is no JSON"):
        run(spark, [rule()], "no json", strict=True)


@pytest.mark.parametrize("bad", [
    {"branches": []}, {"effective_to": "2019-01-01"}, {"global_scope": False}, {"effective_from": "2020-1-1"}, {"schema_version": "0.1.0"}, {"jurisdiction": "XX"}, {"rule_id": ""},
    {"source_clause_ids": []}, {"source_clause_ids": ["a", "a"]}, {"binding_status": True}, {"scope": [{"field": "state.a.x", "op": "is_unknown"}]}, {"more": 1},
    {"branches": [{"when": [{"field": "z", "op": "eq", "value": 1}]} | payload()]}, {"branches": [{"when": [{"field": "state.a.x", "op": "in", "value": []}]} | payload()]},
    {"branches": [{"when": [{"field": "state.a.x", "op": "is_unknown", "value": 1}]} | payload()]}, {"branches": [{"when": [{"field": "state.a.x", "op": "eq"}]} | payload()]},
    {"branches": [{"when": [{"field": "state.a.x", "op": "date_between", "value": ["2021-01-01", "2020-01-01"]}]} | payload()]},
    {"branches": [{"when": []} | payload("MAYBE")]}, {"branches": [{"when": []} | payload(controls=["HUMAN_REVIEW"] * 2)]}, {"branches": [{"when": []} | payload(controls=["LOG"])]},
    {"branches": [{"when": []} | payload(tags=[""])]}, {"branches": [payload()]}, {"fallback": payload() | {"when": []}}, {"fallback": {}},
    {"required_fields": [fact(action="CLARIFY")]}, {"required_fields": [fact(action="REFUSE")]}, {"required_fields": [fact(unknown=[])]}, {"required_fields": [fact(owner="x")]},
    {"required_fields": [fact(askable=1)]}, {"required_fields": [fact() | {"z": 1}]}, {"required_fields": [fact(field="z")]},
])
def test_malformed_rules_are_refused(bad):
    engine.check_rule(rule(), FIELDS)
    with pytest.raises(engine.RuleError):
        engine.check_rule(rule() | bad, FIELDS)


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(engine.RuleError):
        run(spark, [rule("A"), rule("A")], {})


def test_rules_from_a_file(spark, tmp_path):
    one, two = rule("A"), rule("B", [{"field": "state.request.type", "op": "eq", "value": "投诉"}])
    (tmp_path / "rules.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps(two, ensure_ascii=False) + "\n", encoding="utf-8")
    assert engine.read_rules(spark, str(tmp_path / "rules.jsonl")) == [one, two]
    (tmp_path / "bad.jsonl").write_text(json.dumps(one | {"fallback": 1}), encoding="utf-8")
    with pytest.raises(engine.RuleError):
        engine.read_rules(spark, str(tmp_path / "bad.jsonl"))
    assert len(engine.FIELDS) == len(set(engine.FIELDS)) == 44


def test_adjudication(spark):
    overlays = [None, ("exact", None), ("multi_label", ["ANSWER", "REFUSE", "ANSWER"]), ("adjudication_required", ["CLARIFY", "ESCALATE"]), ("adjudication_required", ["ANSWER"]), ("multi_label", None), ("other", ["ANSWER", "REFUSE"]), ("multi_label", ["ANSWER", "MAYBE"])]
    rows = [(i, "{}", dt.date(2022, 1, 1), o) for i, o in enumerate(overlays)]
    df = spark.createDataFrame(rows, "id int, state string, decision_date date, overlay struct<status:string,candidate_actions:array<string>>")
    found = engine.decide(df, [rule(severity="low")], FIELDS, adjudication="overlay").orderBy("id").collect()
    exact = ("ANSWER", ["ANSWER"], "exact", "low")
    assert [(r.decision.primary_action, r.decision.acceptable_actions, r.decision.ambiguity, r.decision.severity) if r.decision else r.error for r in found] == [
        exact, exact, ("REFUSE", ["REFUSE", "ANSWER"], "multi_label", "low"), (None, ["ESCALATE", "CLARIFY"], "adjudication_required", "low"),
        "adjudication needs two distinct actions", "adjudication needs two distinct actions", "unknown adjudication status", "adjudication needs two distinct actions",
    ]
