"""Queries of the rule engine, with example rules that use every operator."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import rules as engine
from plumbline.sources.tables import table


def _rule(rule_id: str, scope: list, branches: list, **more: Any) -> dict[str, Any]:
    base = {
        "schema_version": engine.VERSION, "rule_id": rule_id, "source_clause_ids": [f"{rule_id}:1"], "jurisdiction": "CN", "binding_status": "binding",
        "effective_from": "2020-01-01", "effective_to": None, "global_scope": not scope, "scope": scope, "required_fields": [], "branches": branches, "fallback": None,
    }
    return base | more


def _p(field: str, op: str, *value: Any) -> dict[str, Any]:
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


def _then(action: str, severity: str, controls: tuple = (), tags: tuple = ()) -> dict[str, Any]:
    return {"action": action, "severity": severity, "control_actions": list(controls), "violation_tags": list(tags)}


def _fact(field: str, owner: str, askable: bool, unknown: list, action: str, severity: str) -> dict[str, Any]:
    return {"field": field, "owner": owner, "askable": askable, "unknown_values": unknown, "on_missing": action, "severity": severity}


#: Examples, one at least for each operator, period kind and scope kind. Invented; real rules come from a file (``read_rules``).
EXAMPLES = [
    _rule("X1", [_p("state.suitability.match_status", "is_unknown")], [{"when": []} | _then("CLARIFY", "low", tags=("match",))]),
    _rule(
        "X2", [],
        [{"when": [_p("state.data.sensitive_data_status", "in", ["exposed", "masked"]), _p("state.customer.authentication_status", "neq", "verified")]}
         | _then("REFUSE", "critical", ("SECURITY_REPORT",), ("privacy",))],
    ),
    _rule(
        "X3", [_p("decision_date", "date_between", ["2021-01-01", "2023-12-31"])],
        [{"when": [_p("state.product.risk_level", "not_in", ["R1", "R2"]), _p("state.customer.investor_class", "eq", "retail")]}
         | _then("ESCALATE", "high", ("HUMAN_REVIEW",), ("risk",))],
        effective_to="2023-06-30",
    ),
    _rule(
        "X4", [_p("decision_date", "date_on_or_after", "2022-01-01")],
        [{"when": [_p("state.request.type", "not_unknown"), _p("decision_date", "date_before", "2024-01-01")]} | _then("ANSWER", "none")],
        required_fields=[
            _fact("state.interaction.channel", "user", True, [None, "unknown"], "CLARIFY", "low"),
            _fact("state.suitability.assessment_status", "system", False, ["missing", "stale"], "ESCALATE", "high"),
        ],
    ),
    _rule(
        "X5", [_p("state.customer.investor_class", "neq", "institutional")],
        [{"when": [_p("state.product.risk_level", "eq", "R5")]} | _then("REFUSE", "high", tags=("level",))],
        fallback=_then("ANSWER", "none"),
    ),
    _rule("X6", [], [{"when": []} | _then("REFUSE", "critical")], binding_status="non_binding"),
]


def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of the example rules for every scenario."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", "state", "decision_date")
    return engine.decide(rows, EXAMPLES).select("scenario_id", "error", "decision.*")


def rule_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each action is decided, and how often a row is undecided."""
    found = rule_decisions(spark, sf_dir)
    return found.groupBy("primary_action", "severity").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many scenarios each rule took part."""
    found = rule_decisions(spark, sf_dir).select(F.explode("controlling_rule_ids").alias("rule"), "primary_action")
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("primary_action") == "REFUSE").alias("n_refused"))


def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under an overlay: rows with several acceptable actions are multi-label, critical ones of them await adjudication."""
    actions = F.col("label.acceptable_actions")
    status = F.when(F.size(actions) > 1, F.when(F.col("label.severity") == "critical", "adjudication_required").otherwise("multi_label"))
    overlay = F.when(status.isNotNull(), F.struct(status.alias("status"), actions.alias("candidate_actions")))
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", "state", "decision_date", overlay.alias("overlay"))
    found = engine.decide(rows, EXAMPLES, adjudication="overlay")
    return found.select("scenario_id", "error", "decision.primary_action", "decision.acceptable_actions", "decision.ambiguity")


def _at(path: str) -> str:
    return f"json_extract_string(state, '$.{path}')"


def _gap(condition: str, path: str) -> str:
    return f"WHEN {condition} AND json_extract(state, '$.{path}') IS NULL THEN 'missing path state.{path}'"


_INVESTOR, _AUTH, _MATCH = "customer.investor_class", "customer.authentication_status", "suitability.match_status"
_ASSESS, _RISK, _REQUEST = "suitability.assessment_status", "product.risk_level", "request.type"
_CHANNEL, _DATA = "interaction.channel", "data.sensitive_data_status"


def _unknown(path: str) -> str:
    return f"({_at(path)} IS NULL OR {_at(path)} IN ('unknown', 'missing'))"


def _kept(*items: str) -> str:
    return f"list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)))"


_DECIDED = f"""
base AS (SELECT scenario_id, state, decision_date AS d, label.acceptable_actions AS actions, label.severity AS s FROM scenarios),
hits AS (
  SELECT *, d >= DATE '2020-01-01' AS alive, {_unknown(_MATCH)} AS x1,
    coalesce({_at(_DATA)} IN ('exposed', 'masked'), false) AS p2a, {_at(_AUTH)} IS DISTINCT FROM 'verified' AS p2b,
    d BETWEEN DATE '2021-01-01' AND DATE '2023-06-30' AS s3,
    NOT coalesce({_at(_RISK)} IN ('R1', 'R2'), false) AS p3a, {_at(_INVESTOR)} IS NOT DISTINCT FROM 'retail' AS p3b,
    d >= DATE '2022-01-01' AS s4, NOT {_unknown(_REQUEST)} AND d < DATE '2024-01-01' AS p4,
    {_at(_CHANNEL)} IS NULL OR {_at(_CHANNEL)} = 'unknown' AS m4, coalesce({_at(_ASSESS)} IN ('missing', 'stale'), false) AS n4,
    {_at(_INVESTOR)} IS DISTINCT FROM 'institutional' AS s5, {_at(_RISK)} IS NOT DISTINCT FROM 'R5' AS p5
  FROM base),
found AS (
  SELECT *, CASE WHEN d IS NULL THEN 'no date at decision_date'
    {_gap("alive", _DATA)} {_gap("alive AND p2a", _AUTH)} {_gap("s3", _RISK)} {_gap("s3 AND p3a", _INVESTOR)} {_gap("s4", _REQUEST)} {_gap("s4", _CHANNEL)} {_gap("s4", _ASSESS)}
    {_gap("alive", _INVESTOR)} {_gap("alive AND s5", _RISK)} END AS e0,
    alive AND x1 AS c1, alive AND p2a AND p2b AS c2, s3 AND p3a AND p3b AS c3, s4 AND p4 AS c4, s4 AND m4 AS c4m, s4 AND n4 AS c4n,
    alive AND s5 AND p5 AS c5, alive AND s5 AND NOT p5 AS c5f FROM hits),
final AS (
  SELECT *, coalesce(e0, CASE WHEN NOT (c1 OR c2 OR c3 OR c4 OR c4m OR c4n OR c5 OR c5f) THEN 'no candidate' END) AS error,
    CASE WHEN c2 OR c5 THEN 'REFUSE' WHEN c3 OR c4n THEN 'ESCALATE' WHEN c1 OR c4m THEN 'CLARIFY' ELSE 'ANSWER' END AS a,
    CASE WHEN c2 THEN 'critical' WHEN c3 OR c4n OR c5 THEN 'high' WHEN c1 OR c4m THEN 'low' ELSE 'none' END AS v,
    {_kept("CASE WHEN c2 THEN 'SECURITY_REPORT' END", "CASE WHEN c3 OR c4n THEN 'HUMAN_REVIEW' END")} AS k,
    {_kept("CASE WHEN c1 THEN 'match' END", "CASE WHEN c2 THEN 'privacy' END", "CASE WHEN c3 THEN 'risk' END", "CASE WHEN c5 THEN 'level' END")} AS t,
    {_kept("CASE WHEN c1 THEN 'X1' END", "CASE WHEN c2 THEN 'X2' END", "CASE WHEN c3 THEN 'X3' END", "CASE WHEN c4 OR c4m OR c4n THEN 'X4' END", "CASE WHEN c5 OR c5f THEN 'X5' END")} AS r,
    {_kept(
        "CASE WHEN c1 THEN 'branch:0' END", "CASE WHEN c2 THEN 'state.data.sensitive_data_status:in:[''exposed'', ''masked'']' END",
        "CASE WHEN c2 THEN 'state.customer.authentication_status:neq:verified' END", "CASE WHEN c3 THEN 'state.product.risk_level:not_in:[''R1'', ''R2'']' END",
        "CASE WHEN c3 THEN 'state.customer.investor_class:eq:retail' END", "CASE WHEN c4 THEN 'state.request.type:not_unknown:' END",
        "CASE WHEN c4 THEN 'decision_date:date_before:2024-01-01' END", "CASE WHEN c4m THEN 'missing:state.interaction.channel' END",
        "CASE WHEN c4n THEN 'missing:state.suitability.assessment_status' END", "CASE WHEN c5 THEN 'state.product.risk_level:eq:R5' END", "CASE WHEN c5f THEN 'scope_fallback' END",
    )} AS q
  FROM found),
decided AS (
  SELECT scenario_id, actions, s, error, CASE WHEN error IS NULL THEN a END AS primary_action, CASE WHEN error IS NULL THEN [a] END AS acceptable_actions,
    CASE WHEN error IS NULL THEN k END AS control_actions, CASE WHEN error IS NULL THEN v END AS severity, CASE WHEN error IS NULL THEN t END AS violation_tags,
    CASE WHEN error IS NULL THEN r END AS controlling_rule_ids, CASE WHEN error IS NULL THEN q END AS controlling_predicates,
    CASE WHEN error IS NULL THEN '0.2.0' END AS oracle_version, CASE WHEN error IS NULL THEN 'exact' END AS ambiguity FROM final)
"""  # fmt: skip

SQL = {
    "rule_decisions": f"WITH {_DECIDED} SELECT * EXCLUDE (actions, s) FROM decided",
    "rule_actions": f"WITH {_DECIDED} SELECT primary_action, severity, count(*) AS n, count(error) AS n_errors FROM decided GROUP BY primary_action, severity",
    "rule_support": f"""WITH {_DECIDED} SELECT rule, count(*) AS n, count(*) FILTER (primary_action = 'REFUSE') AS n_refused
FROM (SELECT unnest(controlling_rule_ids) AS rule, primary_action FROM decided) GROUP BY rule""",
    "adjudicated": f"""WITH {_DECIDED}, ordered AS (
  SELECT *, list_filter(['REFUSE', 'ESCALATE', 'CLARIFY', 'ANSWER'], lambda x: list_contains(actions, x)) AS strict,
    CASE WHEN len(actions) > 1 THEN CASE WHEN s = 'critical' THEN 'adjudication_required' ELSE 'multi_label' END END AS status FROM decided),
checked AS (SELECT *, coalesce(error, CASE WHEN status IS NOT NULL AND len(strict) < 2 THEN 'adjudication needs two distinct actions' END) AS e FROM ordered)
SELECT scenario_id, e AS error,
  CASE WHEN e IS NULL THEN CASE WHEN status IS NULL THEN primary_action WHEN status = 'multi_label' THEN strict[1] END END AS primary_action,
  CASE WHEN e IS NULL THEN CASE WHEN status IS NULL THEN acceptable_actions ELSE strict END END AS acceptable_actions,
  CASE WHEN e IS NULL THEN coalesce(status, 'exact') END AS ambiguity FROM checked""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rule_decisions, rule_actions, rule_support, adjudicated)}
