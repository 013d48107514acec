"""Declarative rules over typed nested state, compiled to columns.

A rule is validated once on the driver and becomes one array of candidate decisions per
row; all rules together are one projection without a shuffle. Missing and null are
different: state is a VARIANT, where a path is absent (SQL NULL) or holds a JSON null.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Versions, actions in order of precedence, severities in order, controls, the
# nine operators, spellings of an unknown value, owners of facts, and the paths rules may read.
VERSION = "0.2.0"
PRECEDENCE = ("ANSWER", "CLARIFY", "ESCALATE", "REFUSE")
SEVERITIES = ("none", "low", "high", "critical")
CONTROLS = ("HUMAN_REVIEW", "COMPLIANCE_ALERT", "SECURITY_REPORT", "COMPLAINT_ROUTING")
OPERATORS = ("eq", "neq", "in", "not_in", "is_unknown", "not_unknown", "date_on_or_after", "date_before", "date_between")
UNKNOWN = (None, "unknown", "missing")
OWNERS = ("user", "institution", "rule_registry", "system")
DATE_FIELD = "decision_date"
FIELDS = """
decision_date
state.jurisdiction.country
state.jurisdiction.regulatory_regime
state.jurisdiction.customer_location
state.institution.type
state.institution.authorization_status
state.institution.requested_business_scope
state.institution.request_scope_match
state.assistant.function
state.assistant.workflow_mode
state.assistant.responsible_human_role
state.assistant.responsible_human_registration_status
state.assistant.human_approval_status
state.assistant.affiliation_status
state.assistant.practice_scope_match
state.customer.relationship
state.customer.authentication_status
state.customer.account_authority
state.customer.investor_class
state.customer.marketing_consent
state.customer.sensitive_data_consent
state.suitability.assessment_status
state.suitability.match_status
state.suitability.assessed_product_match
state.product.category
state.product.instrument_type
state.product.market
state.product.risk_level
state.product.access_threshold_status
state.request.type
state.request.personalization
state.request.commercial_intent
state.request.transaction_intent
state.interaction.channel
state.interaction.audience_scope
state.interaction.solicitation_status
state.interaction.complaint_phase
state.interaction.complaint_deadline_status
state.interaction.history_status
state.data.sensitive_data_status
state.data.third_party_data_status
state.market_integrity.inside_information_status
state.market_integrity.conflict_of_interest
state.evidence.rule_evidence_status
""".split()
#: Rules of one query; each becomes part of its plan.
MOST_RULES = 1000
_CANDIDATE = "struct<action:string,severity:string,controls:array<string>,tags:array<string>,rule:string,predicates:array<string>>"


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def _iso(value: Any) -> dt.date:
    if not (isinstance(value, str) and len(value) == 10 and value[4] == value[7] == "-"):
        raise RuleError(f"not an ISO date: {value!r}")
    try:
        return dt.date.fromisoformat(value)
    except ValueError as error:
        raise RuleError(f"not an ISO date: {value!r}") from error


def check_predicate(p: Any, fields: Sequence[str] = FIELDS) -> None:
    """Keys, field, operator and arity of one predicate."""
    if not isinstance(p, Mapping) or set(p) - {"field", "op", "value"}:
        raise RuleError(f"not a predicate: {p!r}")
    op, value = p.get("op"), p.get("value")
    if p.get("field") not in fields:
        raise RuleError(f"field is not allowed: {p.get('field')!r}")
    if op not in OPERATORS:
        raise RuleError(f"unknown operator: {op!r}")
    if (op in ("is_unknown", "not_unknown")) == ("value" in p):
        raise RuleError(f"{op} with or without a value, the other way round")
    if op in ("in", "not_in") and not (isinstance(value, list) and value):
        raise RuleError(f"{op} needs a list that is not empty")
    if op == "date_between":
        if not (isinstance(value, list) and len(value) == 2) or _iso(value[1]) < _iso(value[0]):
            raise RuleError("date_between needs two dates in order")
    elif op.startswith("date_"):
        _iso(value)


# The keys of a rule and of its parts.
_RULE_KEYS = {
    "schema_version", "rule_id", "source_clause_ids", "jurisdiction", "binding_status", "effective_from",
    "effective_to", "global_scope", "scope", "required_fields", "branches", "fallback",
}
_PAYLOAD_KEYS = {"action", "severity", "control_actions", "violation_tags"}
_REQUIRED_KEYS = {"field", "owner", "askable", "unknown_values", "on_missing", "severity"}


def _check_payload(payload: Any, keys: set[str], name: str) -> None:
    if not isinstance(payload, Mapping) or set(payload) != keys:
        raise RuleError(f"{name}: not the keys {sorted(keys)}")
    if payload["action"] not in PRECEDENCE or payload["severity"] not in SEVERITIES:
        raise RuleError(f"{name}: unknown action or severity")
    controls, tags = payload["control_actions"], payload["violation_tags"]
    if not isinstance(controls, list) or len(set(controls)) < len(controls) or not set(controls) <= set(CONTROLS):
        raise RuleError(f"{name}: controls repeat or are unknown")
    if not isinstance(tags, list) or not all(isinstance(t, str) and t for t in tags):
        raise RuleError(f"{name}: a tag is no text or empty")


def _check_required(required: Any, fields: Sequence[str], name: str) -> None:
    if not isinstance(required, Mapping) or set(required) != _REQUIRED_KEYS:
        raise RuleError(f"{name}: keys of a required field")
    if required["field"] not in fields or required["owner"] not in OWNERS or not isinstance(required["askable"], bool):
        raise RuleError(f"{name}: field, owner or askable of a required field")
    if not isinstance(required["unknown_values"], list) or not required["unknown_values"]:
        raise RuleError(f"{name}: a required field needs unknown values")
    if required["on_missing"] not in ("CLARIFY", "ESCALATE") or required["severity"] not in SEVERITIES:
        raise RuleError(f"{name}: action or severity of a required field")
    if required["on_missing"] == "CLARIFY" and not (required["askable"] and required["owner"] == "user"):
        raise RuleError(f"{name}: only what a user can be asked may be clarified")


def check_rule(rule: Mapping[str, Any], fields: Sequence[str] = FIELDS, jurisdiction: str = "CN") -> None:
    """Shape of one rule: keys, version, sources, period, scope or global scope, required fields, branches, fallback."""
    if not isinstance(rule, Mapping) or set(rule) != _RULE_KEYS:
        raise RuleError(f"rule keys: {sorted(set(rule) ^ _RULE_KEYS)}")
    name = rule["rule_id"]
    if not isinstance(name, str) or not name:
        raise RuleError("a rule needs an id")
    if rule["schema_version"] != VERSION or rule["jurisdiction"] != jurisdiction:
        raise RuleError(f"{name}: version or jurisdiction")
    sources = rule["source_clause_ids"]
    if not isinstance(sources, list) or not sources or len(set(sources)) < len(sources):
        raise RuleError(f"{name}: sources repeat or are none")
    if rule["binding_status"] not in ("binding", "non_binding"):
        raise RuleError(f"{name}: binding status")
    start, end = _iso(rule["effective_from"]), rule["effective_to"]
    if end is not None and _iso(end) < start:
        raise RuleError(f"{name}: the period ends before it begins")
    lists = (rule["scope"], rule["required_fields"], rule["branches"])
    if not isinstance(rule["global_scope"], bool) or not all(isinstance(x, list) for x in lists):
        raise RuleError(f"{name}: global scope is no flag or a part is no list")
    if rule["global_scope"] == bool(rule["scope"]):
        raise RuleError(f"{name}: a rule has either a scope or global scope")
    if not rule["branches"]:
        raise RuleError(f"{name}: a rule needs a branch")
    for branch in rule["branches"]:
        _check_payload(branch, _PAYLOAD_KEYS | {"when"}, name)
        if not isinstance(branch["when"], list):
            raise RuleError(f"{name}: when is no list")
    for p in (*rule["scope"], *(p for b in rule["branches"] for p in b["when"])):
        check_predicate(p, fields)
    for required in rule["required_fields"]:
        _check_required(required, fields, name)
    if rule["fallback"] is not None:
        _check_payload(rule["fallback"], _PAYLOAD_KEYS, name)


def read_rules(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Rules from a file of one JSON object a line, blank lines aside; at most MOST_RULES, as they become part of the query."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(MOST_RULES + 1).collect()
    if len(lines) > MOST_RULES:
        raise RuleError(f"more than {MOST_RULES} rules")
    rules = [json.loads(line.value) for line in lines]
    for rule in rules:
        check_rule(rule)
    return rules


def shown(p: Mapping[str, Any]) -> str:
    """A predicate as text, field:operator:value, the value as Python prints it, nothing if there is none."""
    return f"{p['field']}:{p['op']}:{p.get('value', '')}"


class StateColumns:
    """Access to the leaves of a VARIANT state and to the decision date."""

    def __init__(self, state: str, date: str) -> None:
        self.state, self.date = state, date

    def _leaf(self, field: str) -> Column:
        return F.variant_get(F.col(self.state), "$." + field.removeprefix("state."), "variant")

    def present(self, field: str) -> Column:
        """Whether the path exists; null is a value."""
        return F.lit(True) if field == DATE_FIELD else self._leaf(field).isNotNull()

    def text(self, field: str) -> Column:
        """The leaf if it is a text, else null."""
        if field == DATE_FIELD:
            return F.col(self.date).cast("string")
        leaf = self._leaf(field)
        return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(leaf, "$", "string"))

    def equals(self, field: str, value: Any) -> Column:
        """Whether the leaf is ``value``; texts, numbers and null are never each other, true and false are 1 and 0. Never null."""
        if isinstance(value, str):
            return F.coalesce(self.text(field) == value, F.lit(False))
        if field == DATE_FIELD:
            return F.col(self.date).isNull() if value is None else F.lit(False)
        leaf = self._leaf(field)
        if value is None:
            return F.coalesce(F.is_variant_null(leaf), F.lit(False))
        kind = F.schema_of_variant(leaf)
        if isinstance(value, (bool, int, float)):
            number = F.when(kind != "STRING", F.try_variant_get(leaf, "$", "double"))
            return F.coalesce(number == float(value), F.lit(False))
        return F.coalesce(F.to_json(leaf) == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), F.lit(False))

    def one_of(self, field: str, values: Sequence[Any]) -> Column:
        """Whether the leaf is any of ``values``. Never null."""
        texts = [v for v in values if isinstance(v, str)]
        found = F.coalesce(self.text(field).isin(*texts), F.lit(False)) if texts else F.lit(False)
        for value in values:
            if not isinstance(value, str):
                found = found | self.equals(field, value)
        return found

    def day(self, field: str) -> Column:
        """The leaf as a date, only in full ISO form."""
        if field == DATE_FIELD:
            return F.col(self.date).cast("date")
        text = self.text(field)
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text))


def _absent(at: StateColumns, field: str) -> Column:
    return F.when(~at.present(field), F.lit(f"missing path {field}"))


def matches(p: Mapping[str, Any], at: StateColumns) -> tuple[Column, Column]:
    """(match, error) of one predicate in two-valued logic: null equals null, a missing path is an error but for ``is_unknown``."""
    op, field = p["op"], p["field"]
    if op == "is_unknown":
        return ~at.present(field) | at.one_of(field, UNKNOWN), F.lit(None).cast("string")
    missing = _absent(at, field)
    if op == "not_unknown":
        return ~at.one_of(field, UNKNOWN), missing
    if op in ("eq", "neq"):
        same = at.equals(field, p["value"])
        return (same if op == "eq" else ~same), missing
    if op in ("in", "not_in"):
        inside = at.one_of(field, p["value"])
        return (inside if op == "in" else ~inside), missing
    day = at.day(field)
    missing = F.coalesce(missing, F.when(day.isNull(), F.lit(f"no date at {field}")))
    if op == "date_between":
        low, high = (F.lit(_iso(v)) for v in p["value"])
        return F.coalesce(day.between(low, high), F.lit(False)), missing
    bound = F.lit(_iso(p["value"]))
    return F.coalesce(day >= bound if op == "date_on_or_after" else day < bound, F.lit(False)), missing


def all_match(predicates: Sequence[Mapping[str, Any]], at: StateColumns) -> tuple[Column, Column]:
    """A conjunction that stops at the first predicate that fails or cannot be told; empty is true."""
    error, match = F.lit(None).cast("string"), F.lit(True)
    for p in reversed(predicates):
        hit, missing = matches(p, at)
        error = F.when(missing.isNotNull(), missing).when(~hit, F.lit(None).cast("string")).otherwise(error)
        match = F.when(missing.isNotNull() | ~hit, F.lit(False)).otherwise(match)
    return match, error


def _candidate(payload: Mapping[str, Any], rule_id: str, predicates: Sequence[str]) -> Column:
    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return F.struct(
        F.lit(payload["action"]).alias("action"), F.lit(payload["severity"]).alias("severity"), texts(payload["control_actions"]).alias("controls"),
        texts(payload["violation_tags"]).alias("tags"), F.lit(rule_id).alias("rule"), texts(predicates).alias("predicates"),
    )


def compile_rule(rule: Mapping[str, Any], at: StateColumns) -> tuple[Column, Column]:
    """(candidates, error) of one rule for a row.

    Every branch that matches is a candidate, and so is every required fact that is
    unknown; only without any of them the fallback is. Errors come in the order in which
    the parts are looked at: date, scope, branches, required facts.
    """
    none = F.array().cast(f"array<{_CANDIDATE}>")
    if rule["binding_status"] != "binding":
        return none, F.lit(None).cast("string")
    day = at.day(DATE_FIELD)
    in_force = day >= F.lit(_iso(rule["effective_from"]))
    if rule["effective_to"] is not None:
        in_force = in_force & (day <= F.lit(_iso(rule["effective_to"])))
    in_force = F.coalesce(in_force, F.lit(False))
    scope, scope_error = all_match(rule["scope"], at)
    parts, errors = [], []
    for number, branch in enumerate(rule["branches"]):
        hit, error = all_match(branch["when"], at)
        payload = {k: branch[k] for k in _PAYLOAD_KEYS}
        found = _candidate(payload, rule["rule_id"], [shown(p) for p in branch["when"]] or [f"branch:{number}"])
        parts.append(F.when(hit, F.array(found)).otherwise(none))
        errors.append(error)
    for required in rule["required_fields"]:
        action = required["on_missing"]
        payload = {"action": action, "severity": required["severity"], "control_actions": ["HUMAN_REVIEW"] if action == "ESCALATE" else [], "violation_tags": []}
        found = _candidate(payload, rule["rule_id"], [f"missing:{required['field']}"])
        parts.append(F.when(at.one_of(required["field"], required["unknown_values"]), F.array(found)).otherwise(none))
        errors.append(_absent(at, required["field"]))
    found = F.concat(*parts)
    if rule["fallback"] is not None:
        fallback = F.array(_candidate(rule["fallback"], rule["rule_id"], ["scope_fallback"]))
        found = F.when(F.size(found) == 0, fallback).otherwise(found)
    no_date = F.when(day.isNull(), F.lit(f"no date at {DATE_FIELD}"))
    error = F.coalesce(no_date, F.when(in_force, F.coalesce(scope_error, F.when(scope, F.coalesce(*errors)))))
    return F.when(in_force & scope, found).otherwise(none), error


def _rank(column: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), column)


def merged(candidates: Column) -> Column:
    """One decision: the strictest action, the highest severity, and the sorted unions over all candidates."""

    def union(part: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform(candidates, lambda c: c[part]))))

    def strictest(part: str, order: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in order]), F.array_max(F.transform(candidates, lambda c: _rank(c[part], order))).cast("int"))

    action = strictest("action", PRECEDENCE)
    return F.struct(
        action.alias("primary_action"), F.array(action).alias("acceptable_actions"), union("controls").alias("control_actions"),
        strictest("severity", SEVERITIES).alias("severity"), union("tags").alias("violation_tags"),
        F.array_sort(F.array_distinct(F.transform(candidates, lambda c: c["rule"]))).alias("controlling_rule_ids"),
        union("predicates").alias("controlling_predicates"), F.lit(VERSION).alias("oracle_version"), F.lit("exact").alias("ambiguity"),
    )


def adjudicated(decision: Column, status: Column, actions: Column) -> tuple[Column, Column]:
    """(decision, error) under a human adjudication of status and candidate actions.

    No adjudication or 'exact' keeps the decision. The two other kinds need at least two
    distinct known actions, which become the acceptable ones, the strictest first:
    'multi_label' decides for that one, 'adjudication_required' for none.
    """
    ordered = F.array_sort(F.array_distinct(actions), lambda a, b: (_rank(b, PRECEDENCE) - _rank(a, PRECEDENCE)).cast("int"))
    kept = status.isNull() | (status == "exact")
    known = F.forall(ordered, lambda a: F.coalesce(a.isin(*PRECEDENCE), F.lit(False)))
    error = F.when(~kept & ~status.isin("adjudication_required", "multi_label"), F.lit("unknown adjudication status")).when(
        ~kept & ~F.coalesce((F.size(ordered) >= 2) & known, F.lit(False)), F.lit("adjudication needs two distinct actions")
    )
    primary = F.when(status == "multi_label", ordered[0])
    changed = decision.withField("primary_action", primary).withField("acceptable_actions", ordered).withField("ambiguity", status)
    return F.when(error.isNull(), F.when(kept, decision).otherwise(changed)), error


def decide(
    scenarios: DataFrame, rules: Sequence[Mapping[str, Any]], fields: Sequence[str] = FIELDS, state: str = "state", date: str = "decision_date",
    adjudication: str | None = None, strict: bool = False,
) -> DataFrame:
    """``scenarios`` with ``decision`` and ``error``.

    ``state`` is a JSON string or a VARIANT; ``adjudication``, where given, a column of
    struct<status, candidate_actions>. A row no rule decides has no decision and an
    error, never an implicit answer; so does a row whose rules meet a missing path, a row
    without a date (unless no rule is binding) and one whose state is no JSON. With
    ``strict`` such a row ends the job. Duplicate rule ids and malformed rules are errors
    when the query is built. The columns ``decision`` and ``error`` must not exist yet.
    """
    for rule in rules:
        check_rule(rule, [*fields, DATE_FIELD])
    if len({r["rule_id"] for r in rules}) < len(rules):
        raise RuleError("duplicate rule id")
    if {"decision", "error"} & set(scenarios.columns):
        raise RuleError("columns decision or error exist")
    as_variant = F.try_parse_json(state) if dict(scenarios.dtypes)[state] == "string" else F.col(state)
    parsed = scenarios.withColumn("__state", as_variant)
    at = StateColumns("__state", date)
    compiled = [compile_rule(r, at) for r in rules]
    candidates = F.concat(*[c for c, _ in compiled]) if compiled else F.array().cast(f"array<{_CANDIDATE}>")
    error = F.coalesce(F.when(F.col("__state").isNull(), F.lit("state is no JSON")), *[e for _, e in compiled])
    found = parsed.withColumns({"__candidates": candidates, "__error": error})
    error = F.coalesce("__error", F.when(F.size("__candidates") == 0, F.lit("no candidate")))
    found = found.withColumn("error", error)
    found = found.withColumn("decision", F.when(F.col("error").isNull(), merged(F.col("__candidates"))))
    if adjudication:
        changed, wrong = adjudicated(F.col("decision"), F.col(f"{adjudication}.status"), F.col(f"{adjudication}.candidate_actions"))
        found = found.withColumn("__wrong", wrong).withColumn("decision", F.when(F.col("error").isNull(), changed))
        found = found.withColumn("error", F.coalesce("error", "__wrong")).drop("__wrong")
    if strict:
        found = found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    return found.drop("__state", "__candidates", "__error")
