"""Projections that control what a model, a scorer or a reviewer may see, and evaluation requests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canonical import canonical, digest, exact_json, json_keys, object_json, string_digest, text_json

# Methods of evaluation, methods of a model input, roles and fields of
# evidence, fields of a clause, and keys that must never reach a model.
METHODS = ("dialogue_only", "state_only", "oracle_evidence", "state_oracle_evidence")
INPUT_METHODS = ("direct", "evidence_rag", "state_aware")
EVIDENCE_ROLES = ("controlling", "retrieval_candidate", "distractor")
EVIDENCE_FIELDS = ("source_clause_id", "authority", "title", "effective_from", "effective_to", "article", "excerpt")
CLAUSE_FIELDS = ("clause_id", "issuer", "title", "article", "effective_from", "effective_to", "excerpt")
FORBIDDEN = (
    "state", "label", "adjudication", "primary_action", "acceptable_actions", "control_actions", "severity", "violation_tags",
    "controlling_rule_ids", "controlling_predicates", "oracle_version", "ambiguity", "suite", "split", "scenario_id", "family_id",
    "pair_id", "conversation_id", "turn_index", "transformation", "expected_relation", "minimality_status", "provenance", "audits",
    "annotation_ledger_refs", "status_as_of_decision", "accessed_at",
)


def oracle_view(scenarios: DataFrame) -> DataFrame:
    """What a rule may see."""
    return scenarios.select("scenario_id", "decision_date", "state")


def realization_view(scenarios: DataFrame) -> DataFrame:
    """What a writer of dialogues may see: date, language and state, no label."""
    return scenarios.select("scenario_id", "decision_date", "language", "state")


def scoring_view(scenarios: DataFrame) -> DataFrame:
    """What a scorer needs; columns a table lacks are null, evidence is reduced to its clause ids."""

    def maybe(name: str, kind: str) -> Column:
        return (F.col(name) if name in scenarios.columns else F.lit(None).cast(kind)).alias(name)

    ids = F.transform("evidence", lambda e: e["source_clause_id"]) if "evidence" in scenarios.columns else F.lit(None)
    return scenarios.select(
        "scenario_id", "family_id", maybe("pair_id", "string"), maybe("conversation_id", "string"), maybe("turn_index", "long"), "suite", "split",
        maybe("decision_date", "date"), "label", maybe("transformation", "string"), F.coalesce(ids, F.array().cast("array<string>")).alias("evidence_ids"),
    )


def public_view(scenarios: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the named columns, in their order."""
    return scenarios.select(*keep)


def _wrong_roles(evidence: Column) -> Column:
    return F.coalesce(~F.forall(evidence, lambda e: F.coalesce(e["role"].isin(*EVIDENCE_ROLES), F.lit(False))), F.lit(False))


def _plain_evidence(evidence: Column, fields: Sequence[str]) -> Column:
    return F.transform(evidence, lambda e: F.struct(*[e[f].alias(f) for f in sorted(fields)]))


def sanitized_evidence(evidence: Column) -> Column:
    """Evidence with the allowed fields only; null is an empty list, a role that is not allowed ends the job."""
    kept = F.coalesce(_plain_evidence(evidence, EVIDENCE_FIELDS), F.array())
    return F.when(_wrong_roles(evidence), F.raise_error(F.lit("evidence of a role that is not allowed"))).otherwise(kept)


def _as_json(value: Column) -> Column:
    return exact_json(F.to_json(value, {"ignoreNullFields": "false"}))


def model_input_views(records: DataFrame, version: str = "0.2.0", strict: bool = False) -> DataFrame:
    """(scenario_id, method, view, problem): what a model reads by each input method, as canonical JSON.

    ``dialogue`` is an array of structs with role and message_id at least, ``evidence`` an
    array of structs with role and EVIDENCE_FIELDS, ``state`` a JSON object. A record whose
    dialogue is empty, does not end with the customer or lacks or repeats a message id,
    whose evidence has another role, whose state is no object where it is needed, or whose
    view would hold a forbidden key has no view but a problem; with ``strict`` it ends the
    job. An empty table gives an empty result.
    """
    turn = records.schema["dialogue"].dataType.elementType
    dialogue = F.transform("dialogue", lambda t: F.struct(*[t[f].alias(f) for f in sorted(turn.names)]))
    ids = F.transform("dialogue", lambda t: t["message_id"])
    bad_dialogue = (
        F.when(F.coalesce(F.size("dialogue"), F.lit(0)) <= 0, "dialogue is empty")
        .when(~F.element_at("dialogue", -1)["role"].eqNullSafe(F.lit("customer")), "last turn is not the customer's")
        .when(F.exists(ids, lambda i: i.isNull() | (i == "")), "a message has no id")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "message ids repeat")
    )
    bad_evidence = F.when(_wrong_roles(F.col("evidence")), "evidence of a role that is not allowed")
    rows = records.select(
        "scenario_id", F.col("decision_date").cast("string").alias("date"), _as_json(dialogue).alias("turns"), canonical("state").alias("observed"),
        _as_json(F.coalesce(_plain_evidence(F.col("evidence"), EVIDENCE_FIELDS), F.array())).alias("proof"), bad_dialogue.alias("bad_dialogue"), bad_evidence.alias("bad_evidence"),
    )
    bad_state = F.when(~F.coalesce(F.startswith("observed", F.lit("{")), F.lit(False)), "state is no object")
    options = []
    for method in INPUT_METHODS:
        fields = {"view_version": F.lit(json.dumps(version)), "method": F.lit(json.dumps(method)), "decision_date": text_json(F.col("date")), "dialogue": F.col("turns")}
        problems = [F.col("bad_dialogue")]
        if method != "direct":
            fields["evidence"] = F.col("proof")
            problems.append(F.col("bad_evidence"))
        if method == "state_aware":
            fields["observed_state"] = F.col("observed")
            problems.append(bad_state)
        options.append(F.struct(F.lit(method).alias("method"), object_json(fields).alias("view"), F.coalesce(*problems).alias("problem")))
    found = rows.select("scenario_id", F.explode(F.array(*options)).alias("o")).select("scenario_id", "o.*")
    leaking = F.arrays_overlap(json_keys("view"), F.array(*[F.lit(k) for k in FORBIDDEN]))
    found = found.withColumn("problem", F.coalesce("problem", F.when(leaking, F.lit("a forbidden key"))))
    if strict:
        found = found.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))))
    return found.select("scenario_id", "method", F.when(F.col("problem").isNull(), F.col("view")).alias("view"), "problem")


def evidence_for(scenarios: DataFrame, rules: DataFrame, clauses: DataFrame, strict: bool = False) -> DataFrame:
    """(scenario_id, evidence, missing): the clauses of a scenario's controlling rules, each once, in order of id.

    ``rules`` is (rule_id, source_clause_ids), ``clauses`` holds CLAUSE_FIELDS, both with
    unique ids. Rules and clauses that are not there are named in ``missing``; with
    ``strict`` they end the job. Every scenario has a row; one without rules has no evidence.
    """
    ruled = scenarios.select("scenario_id", F.explode_outer("label.controlling_rule_ids").alias("rule_id")).distinct()
    joined = ruled.join(rules.select("rule_id", F.col("source_clause_ids").alias("ids")), "rule_id", "left")
    cited = joined.select("scenario_id", "rule_id", F.col("ids").isNull().alias("no_rule"), F.explode_outer("ids").alias("clause_id"))
    known = clauses.select("clause_id", F.struct(*[F.col(f) for f in sorted(CLAUSE_FIELDS)]).alias("clause"))
    found = cited.join(known, "clause_id", "left")
    gap = F.when(F.col("rule_id").isNotNull() & F.col("no_rule"), F.concat(F.lit("rule "), "rule_id")).when(F.col("clause_id").isNotNull() & F.col("clause").isNull(), F.concat(F.lit("clause "), "clause_id"))
    out = found.groupBy("scenario_id").agg(F.collect_set("clause").alias("evidence"), F.array_sort(F.collect_set(gap)).alias("missing"))
    ordered = F.array_sort("evidence", lambda a, b: F.when(a["clause_id"] < b["clause_id"], -1).when(a["clause_id"] > b["clause_id"], 1).otherwise(0))
    out = out.withColumn("evidence", ordered)
    if strict:
        out = out.withColumn("missing", F.when(F.size("missing") > 0, F.raise_error(F.concat_ws(", ", "missing"))).otherwise(F.col("missing")))
    return out


def evaluation_views(scenarios: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(scenario_id, method, view): date and dialogue, with state and evidence as the method adds them, as canonical JSON.

    Evidence, where given, is (scenario_id, evidence) with at most one row each; it is
    joined once, and every part is written once, before rows are multiplied by the methods.
    The state is an object in the view; one that is no JSON is a null.
    """
    rows = scenarios.select("scenario_id", F.col("decision_date").cast("string").alias("date"), _as_json(F.col("dialogue")).alias("turns"), canonical("state").alias("typed"))
    if evidence is None:
        rows = rows.withColumn("proof", F.lit("[]"))
    else:
        rows = rows.join(evidence.select("scenario_id", _as_json(F.col("evidence")).alias("proof")), "scenario_id", "left").fillna("[]", ["proof"])
    base = {"decision_date": text_json(F.col("date")), "dialogue": F.col("turns")}
    state, proof = {"typed_state": F.col("typed")}, {"official_clause_evidence": F.col("proof")}
    options = [F.struct(F.lit(m).alias("method"), object_json(base | more).alias("view")) for m, more in zip(METHODS, ({}, state, proof, state | proof), strict=True)]
    return rows.select("scenario_id", F.explode(F.array(*options)).alias("o")).select("scenario_id", "o.*")


def evaluation_requests(views: DataFrame, prefix: str, prompt: str, model: str, slot: str = "public_openai_compatible", version: str = "0.20.0") -> DataFrame:
    """Jobs with their ids, the digest of what the model will read, and the request with its own digest.

    The prefix may hold capitals, digits, ``_`` and ``-`` only; an empty prompt is an error.
    """
    if not re.fullmatch(r"[A-Z0-9_-]+", prefix):
        raise ValueError(f"invalid job prefix: {prefix!r}")
    if not prompt.strip():
        raise ValueError("the prompt is empty")
    job_id = F.concat_ws("-", F.lit(prefix), F.upper(F.replace("method", F.lit("_"), F.lit("-"))), "scenario_id")

    def said(role: str, content: Column) -> Column:
        return object_json({"role": F.lit(json.dumps(role)), "content": content})

    system = said("system", F.lit(json.dumps(prompt.strip(), ensure_ascii=False)))
    messages = F.concat(F.lit("["), system, F.lit(","), said("user", text_json(F.col("view"))), F.lit("]"))
    # The settings of a request.
    payload = object_json({
        "model": F.lit(json.dumps(model, ensure_ascii=False)), "messages": messages, "temperature": F.lit("0.0"), "max_tokens": F.lit("64"), "stream": F.lit("false"),
        "response_format": F.lit('{"type":"json_object"}'), "chat_template_kwargs": F.lit('{"enable_thinking":false}'),
    })
    rows = views.select(job_id.alias("job_id"), "scenario_id", "method", digest(F.col("view")).alias("model_input_sha256"), payload.alias("request_payload"))
    return rows.select(F.lit(version).alias("schema_version"), "job_id", "scenario_id", "method", F.lit(slot).alias("system_slot"), "model_input_sha256", digest(F.col("request_payload")).alias("request_sha256"), "request_payload")


def job_ledger(requests: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One job for each request, bound to its scenario by ids and to its input and label by digests."""
    s = scenarios.select(
        "scenario_id", "family_id", F.col("leakage_component_id").alias("component_id"), F.col("component_id").alias("design_component_id"),
        "suite", "split", string_digest(F.col("label.primary_action")).alias("gold_action_sha256"),
    )
    fixed = {"status": "prepared_label_free_evaluation_not_run", "repeat_policy": "single_first_attempt"}
    rows = requests.drop("request_payload", "request_sha256").join(s, "scenario_id")
    return rows.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], F.col("job_id").alias("exact_request_group"), F.lit(1).cast("long").alias("repeat"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, n = hashlib.sha256(b"["), 0
    for batch in batches:
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state.update((b"," if n else b"") + json.dumps(pair, ensure_ascii=False, separators=(",", ":")).encode())
            n += 1
    state.update(b"]")
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=["n", "sha256"])


def pairs_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(n, sha256): digest of the canonical JSON list of all (key, value) pairs in order of key.

    SHA-256 reads its input in order, so the pairs, sorted by all tasks, stream through
    one that keeps none of them. For tables beyond a frozen reference use ``checksum``.
    """
    ordered = rows.select(F.col(key).cast("string"), F.col(value).cast("string")).orderBy(key, value).coalesce(1)
    nothing = hashlib.sha256(b"[]").hexdigest()
    one = ordered.mapInArrow(_hashed, "n long, sha256 string")
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.lit(nothing)).alias("sha256"))


def checksum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(n, checksum) over all (key, value) pairs, whatever their order: counted and summed, not sorted in one place.

    The sum of the first 60 bits of each pair's hash changes with any pair, and adds up
    from any number of partitions.
    """
    each = F.sha2(F.concat_ws("|", key, value).cast("binary"), 256)
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("checksum"))


def profiled(payload: Column, drop: Sequence[str], add: Mapping[str, Column]) -> Column:
    """A request struct rewritten for a provider: fields dropped, fields added or replaced."""
    found = payload.dropFields(*drop) if drop else payload
    for name, value in add.items():
        found = found.withField(name, value)
    return found


def leaks(rows: DataFrame, key: str, payload: str, forbidden: Sequence[str] = FORBIDDEN, strict: bool = False) -> DataFrame:
    """(key, keys): rows whose JSON holds a forbidden key at any depth, and which; with ``strict`` such a row ends the job."""
    keys = F.array_sort(F.array_intersect(json_keys(payload), F.array(*[F.lit(k) for k in forbidden])))
    found = rows.select(key, keys.alias("keys")).where("size(keys) > 0")
    if strict:
        found = found.withColumn("keys", F.raise_error(F.concat(F.lit("forbidden keys: "), F.array_join("keys", ", "))).cast("array<string>"))
    return found


def broken_dialogues(scenarios: DataFrame, asker: str = "customer") -> DataFrame:
    """(scenario_id, problem): dialogues that are empty, do not end with the asker, or repeat a turn."""
    last = F.lower(F.trim(F.element_at("dialogue", -1)["role"]))
    problem = F.when(F.col("dialogue").isNull() | (F.size("dialogue") == 0), "empty").when(~last.eqNullSafe(F.lit(asker)), "last_turn").when(
        F.size(F.array_distinct("dialogue")) < F.size("dialogue"), "repeated_turn"
    )
    return scenarios.select("scenario_id", problem.alias("problem")).where("problem IS NOT NULL")


def with_prediction(rows: DataFrame, predictions: DataFrame, key: str, column: str = "prediction", required: bool = False) -> DataFrame:
    """Rows with the column replaced by that of ``predictions`` (key, column); rows without one keep theirs, or end the job if one is required."""
    new = predictions.select(key, F.col(column).alias("__new"), F.lit(True).alias("__known"))
    lacking = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast(rows.schema[column].dataType)
    kept = F.when(F.col("__known").isNull(), lacking).otherwise(F.col("__new")) if required else F.coalesce("__new", column)
    return rows.join(new, key, "left").withColumn(column, kept).drop("__new", "__known")
