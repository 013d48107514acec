"""Queries over views and evaluation requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import plain_label, sql_plain
from plumbline.operators import views
from plumbline.sources.tables import table

PREFIX, MODEL = "EVAL14", "any-chat-model"
PROMPT = '只输出 {"action":"..."}。\nOne JSON object, nothing else.'


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every controlling rule with two clauses of its own and one it shares with the others."""
    rules = table(spark, sf_dir, "scenarios").select(F.explode("label.controlling_rule_ids").alias("rule_id")).distinct()
    return rules.select("rule_id", F.array(F.concat("rule_id", F.lit("-B")), F.lit("SHARED"), F.concat("rule_id", F.lit("-A"))).alias("source_clause_ids"))


def _clauses(rules: DataFrame) -> DataFrame:
    ids = rules.select(F.explode("source_clause_ids").alias("clause_id")).distinct()
    ends = F.when(F.endswith("clause_id", F.lit("-B")), "2030-12-31")
    return ids.select(
        "clause_id", F.lit("监管机构").alias("issuer"), F.concat(F.lit("Title of "), "clause_id").alias("title"), F.lit('Art. "1"').alias("article"),
        F.lit("2020-01-01").alias("effective_from"), ends.alias("effective_to"), F.concat(F.lit("Text\nof "), "clause_id").alias("excerpt"),
    )


def _heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scenarios").where(plain_label("split") == "heldout")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, rules = _heldout(spark, sf_dir), _rules(spark, sf_dir)
    evidence = views.evidence_for(rows, rules, _clauses(rules), strict=True)
    return views.evaluation_requests(views.evaluation_views(rows, evidence), PREFIX, PROMPT, MODEL)


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ids, input and request digests of heldout scenarios for all four methods."""
    return _requests(spark, sf_dir).select("job_id", "scenario_id", "method", "model_input_sha256", "request_sha256")


def model_inputs_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen digest over all jobs and their inputs."""
    return views.pairs_digest(_requests(spark, sf_dir), "job_id", "model_input_sha256")


def model_inputs_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a sum that any number of tasks adds up."""
    return views.checksum(_requests(spark, sf_dir), "job_id", "model_input_sha256")


def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored jobs are rebuilt under their id, and with the same input digest."""
    jobs = table(spark, sf_dir, "evaluation_jobs").select("job_id", F.col("model_input_sha256").alias("stored"))
    built = _requests(spark, sf_dir).select("job_id", "model_input_sha256")
    kind = F.when(F.col("model_input_sha256").isNull(), "not rebuilt").when(F.col("stored").isNull(), "not stored").when(F.lower("stored") == F.col("model_input_sha256"), "equal").otherwise("different")
    return jobs.join(built, "job_id", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of all heldout scenarios, without payloads."""
    return views.job_ledger(_requests(spark, sf_dir), _heldout(spark, sf_dir))


def scoring_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer sees."""
    rules = _rules(spark, sf_dir)
    rows = table(spark, sf_dir, "scenarios")
    found = views.evidence_for(rows, rules, _clauses(rules)).select("scenario_id", F.transform("evidence", lambda e: F.struct(e["clause_id"].alias("source_clause_id"))).alias("evidence"))
    return views.scoring_view(rows.join(found, "scenario_id")).select("*", "label.*").drop("label")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios as records with message ids and evidence that is not always allowed."""
    named = F.transform("dialogue", lambda t, i: F.struct(F.trim(F.lower(t["role"])).alias("role"), t["text"].alias("text"), F.concat(F.lit("m"), i.cast("string")).alias("message_id")))
    fields = [F.concat(F.lit(f"{f} of "), "suite").alias(f) for f in views.EVIDENCE_FIELDS]
    role = F.when(F.col("suite") == "temporal", "comment").otherwise("controlling")
    return table(spark, sf_dir, "scenarios").select("scenario_id", "decision_date", named.alias("dialogue"), "state", F.array(F.struct(role.alias("role"), *fields)).alias("evidence"))


def model_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would read of every scenario by three methods, as digests, and why some have none."""
    found = views.model_input_views(_records(spark, sf_dir))
    return found.select("scenario_id", "method", F.sha2(F.col("view").cast("binary"), 256).alias("view_sha256"), "problem")


def payload_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys in what a model would read, where there should be none, and in whole records, where there are."""
    rows = table(spark, sf_dir, "scenarios")
    safe = views.evaluation_views(rows).select(F.lit("view").alias("kind"), "view")
    whole = rows.select(F.lit("record").alias("kind"), F.to_json(F.struct("scenario_id", "suite", "label", "dialogue")).alias("view"))
    both = safe.unionAll(whole).withColumn("id", F.struct("kind", F.monotonically_increasing_id().alias("n")))
    found = views.leaks(both, "id", "view").groupBy("id.kind", "keys").agg(F.count("*").alias("n_leaking"))
    return both.groupBy("kind").agg(F.count("*").alias("n")).join(found, "kind", "left").select("kind", "n", F.coalesce("n_leaking", F.lit(0)).alias("n_leaking"), "keys")


def controlling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every scenario: ids of its rules' clauses."""
    rules = _rules(spark, sf_dir)
    found = views.evidence_for(table(spark, sf_dir, "scenarios"), rules, _clauses(rules))
    return found.select("scenario_id", F.transform("evidence", lambda e: e["clause_id"]).alias("evidence"), "missing")


def _canonical_state(column: str) -> str:
    """SQL: a state of two levels with sorted keys and no blanks."""
    inner = f"json_extract({column}, '$.\"' || k || '\"')"
    path = "'$.\"' || l || '\"'"
    leaf = f"CASE json_type({inner}, {path}) WHEN 'VARCHAR' THEN CAST(to_json(json_extract_string({inner}, {path})) AS VARCHAR) ELSE coalesce(CAST(json_extract({inner}, {path}) AS VARCHAR), 'null') END"
    leaves = f"'{{' || array_to_string(list_transform(list_sort(json_keys({inner})), lambda l: CAST(to_json(l) AS VARCHAR) || ':' || {leaf}), ',') || '}}'"
    return f"'{{' || array_to_string(list_transform(list_sort(json_keys({column})), lambda k: CAST(to_json(k) AS VARCHAR) || ':' || {leaves}), ',') || '}}'"


def _js(expression: str) -> str:
    return f"CAST(to_json({expression}) AS VARCHAR)"


_PROMPT_SQL = "replace('" + PROMPT.replace("\n", "|") + "', '|', chr(10))"
_EVIDENCE = f"""
ruled AS (SELECT DISTINCT scenario_id, unnest(label.controlling_rule_ids) AS rule_id FROM scenarios),
cited AS (SELECT DISTINCT scenario_id, unnest([rule_id || '-A', rule_id || '-B', 'SHARED']) AS c FROM ruled WHERE rule_id IS NOT NULL),
evidence AS (SELECT scenario_id, list(c ORDER BY c) AS ids, '[' || string_agg({_js("{article: 'Art. \"1\"', clause_id: c, effective_from: '2020-01-01', effective_to: CASE WHEN suffix(c, '-B') THEN '2030-12-31' END, excerpt: 'Text' || chr(10) || 'of ' || c, issuer: '监管机构', title: 'Title of ' || c}")}, ',' ORDER BY c) || ']' AS proof
  FROM cited GROUP BY scenario_id)"""
_INPUTS = f"""
{_EVIDENCE},
s AS (SELECT scenario_id, coalesce({_js("CAST(decision_date AS VARCHAR)")}, 'null') AS d, coalesce({_js("dialogue")}, 'null') AS g, coalesce({_canonical_state("state")}, 'null') AS t, coalesce(proof, '[]') AS p
  FROM scenarios LEFT JOIN evidence USING (scenario_id) WHERE {sql_plain("split")} = 'heldout'),
o AS (
  SELECT scenario_id, 'dialogue_only' AS method, '{{"decision_date":' || d || ',"dialogue":' || g || '}}' AS v FROM s
  UNION ALL SELECT scenario_id, 'state_only', '{{"decision_date":' || d || ',"dialogue":' || g || ',"typed_state":' || t || '}}' FROM s
  UNION ALL SELECT scenario_id, 'oracle_evidence', '{{"decision_date":' || d || ',"dialogue":' || g || ',"official_clause_evidence":' || p || '}}' FROM s
  UNION ALL SELECT scenario_id, 'state_oracle_evidence', '{{"decision_date":' || d || ',"dialogue":' || g || ',"official_clause_evidence":' || p || ',"typed_state":' || t || '}}' FROM s),
inputs AS (SELECT '{PREFIX}-' || upper(replace(method, '_', '-')) || '-' || scenario_id AS job_id, scenario_id, method, sha256(v) AS model_input_sha256,
  sha256('{{"chat_template_kwargs":{{"enable_thinking":false}},"max_tokens":64,"messages":[{{"content":' || {_js(_PROMPT_SQL)} || ',"role":"system"}},{{"content":' || {_js("v")}
    || ',"role":"user"}}],"model":"{MODEL}","response_format":{{"type":"json_object"}},"stream":false,"temperature":0.0}}') AS request_sha256 FROM o)"""

_TURNS = "list_transform(dialogue, lambda t, i: {message_id: 'm' || (i - 1), role: trim(lower(t.role), ' '), text: t.text})"
_PROOF = f"'[' || {_js('{' + ', '.join(f'{f}: ' + chr(39) + f + ' of ' + chr(39) + ' || suite' for f in sorted(views.EVIDENCE_FIELDS)) + '}')} || ']'"

SQL = {
    "model_inputs": f"WITH {_INPUTS} SELECT * FROM inputs",
    "model_inputs_digest": f"""WITH {_INPUTS} SELECT count(*) AS n, sha256('[' || string_agg('["' || job_id || '","' || model_input_sha256 || '"]', ',' ORDER BY job_id) || ']') AS sha256 FROM inputs""",
    "input_hashes": f"""WITH {_INPUTS} SELECT CASE WHEN i.job_id IS NULL THEN 'not rebuilt' WHEN j.job_id IS NULL THEN 'not stored' WHEN lower(j.model_input_sha256) = i.model_input_sha256 THEN 'equal' ELSE 'different' END AS kind,
  count(*) AS n FROM evaluation_jobs j FULL JOIN inputs i USING (job_id) GROUP BY 1""",
    "job_ledger": f"""WITH {_INPUTS} SELECT '0.20.0' AS schema_version, job_id, i.scenario_id, method, 'public_openai_compatible' AS system_slot, model_input_sha256, family_id, leakage_component_id AS component_id,
  component_id AS design_component_id, suite, split, sha256({_js("label.primary_action")}) AS gold_action_sha256, 'prepared_label_free_evaluation_not_run' AS status,
  'single_first_attempt' AS repeat_policy, job_id AS exact_request_group, CAST(1 AS BIGINT) AS repeat FROM inputs i JOIN scenarios s ON s.scenario_id = i.scenario_id""",
    "scoring_view": f"""WITH {_EVIDENCE} SELECT scenario_id, family_id, CAST(NULL AS VARCHAR) AS pair_id, CAST(NULL AS VARCHAR) AS conversation_id, CAST(NULL AS BIGINT) AS turn_index, suite, split, decision_date,
  CAST(NULL AS VARCHAR) AS transformation, coalesce(ids, []) AS evidence_ids, label.primary_action AS primary_action, label.acceptable_actions AS acceptable_actions, label.severity AS severity,
  label.controlling_rule_ids AS controlling_rule_ids FROM scenarios LEFT JOIN evidence USING (scenario_id)""",
    "model_views": f"""WITH s AS (SELECT scenario_id, {_js("CAST(decision_date AS VARCHAR)")} AS d, {_TURNS} AS turns, {_canonical_state("state")} AS t, {_PROOF} AS p, suite FROM scenarios),
o AS (SELECT *, '{{"decision_date":' || coalesce(d, 'null') || ',"dialogue":' || {_js("turns")} AS a,
  CASE WHEN coalesce(len(turns), 0) = 0 THEN 'dialogue is empty' WHEN turns[len(turns)].role IS DISTINCT FROM 'customer' THEN 'last turn is not the customer''s' END AS e FROM s),
v AS (
  SELECT scenario_id, 'direct' AS method, a || ',"method":"direct","view_version":"0.2.0"}}' AS view, e FROM o
  UNION ALL SELECT scenario_id, 'evidence_rag', a || ',"evidence":' || p || ',"method":"evidence_rag","view_version":"0.2.0"}}', coalesce(e, CASE WHEN suite = 'temporal' THEN 'evidence of a role that is not allowed' END) FROM o
  UNION ALL SELECT scenario_id, 'state_aware', a || ',"evidence":' || p || ',"method":"state_aware","observed_state":' || t || ',"view_version":"0.2.0"}}',
    coalesce(e, CASE WHEN suite = 'temporal' THEN 'evidence of a role that is not allowed' END) FROM o)
SELECT scenario_id, method, CASE WHEN e IS NULL THEN sha256(view) END AS view_sha256, e AS problem FROM v""",
    "payload_leaks": """WITH n AS (SELECT count(*) AS n FROM scenarios)
SELECT 'view' AS kind, 4 * n AS n, CAST(0 AS BIGINT) AS n_leaking, CAST(NULL AS VARCHAR[]) AS keys FROM n
UNION ALL SELECT 'record', n, n, ['acceptable_actions', 'controlling_rule_ids', 'label', 'primary_action', 'scenario_id', 'severity', 'suite'] FROM n""",
    "controlling_rules": f"WITH {_EVIDENCE} SELECT scenario_id, coalesce(ids, []) AS evidence, CAST([] AS VARCHAR[]) AS missing FROM scenarios LEFT JOIN evidence USING (scenario_id)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (model_inputs, model_inputs_digest, model_inputs_checksum, input_hashes, job_ledger, scoring_view, model_views, payload_leaks, controlling_rules)
}
