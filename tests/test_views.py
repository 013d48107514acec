"""Views and requests against plain Python: canonical JSON, digests, guards."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import views

SCHEMA = "scenario_id string, decision_date date, dialogue array<struct<role:string,text:string>>, state string, label struct<primary_action:string,controlling_rule_ids:array<string>>, family_id string, component_id string, leakage_component_id string, suite string, split string"
ROWS = [
    ("S1", dt.date(2024, 1, 2), [("customer", 'hi "你"\n\u001f\u2028/')], ' {"b": {"y":null,"x":1.50}, "a":{"z":"\\u4f60"}} ', ("ANSWER", ["R1", "R2"]), "f", "d", "c", "s", "heldout"),
    ("S2", None, None, None, ("REFUSE", None), None, None, None, None, None),
]
RULES = [("R1", ["C2", "C1"]), ("R2", ["C2"]), ("R9", ["C9"])]
CLAUSES = [(c, "issuer", f"title {c}", "1", "2020-01-01", None, "text\n文") for c in ("C1", "C2")]


def canon(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(value):
    return hashlib.sha256(canon(value).encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark):
    clauses = spark.createDataFrame(CLAUSES, ", ".join(f"{f} string" for f in views.CLAUSE_FIELDS))
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(RULES, "rule_id string, source_clause_ids array<string>"), clauses


def expected_views():
    proof = [dict(zip(views.CLAUSE_FIELDS, c)) for c in CLAUSES]
    one = {"decision_date": "2024-01-02", "dialogue": [{"role": "customer", "text": ROWS[0][2][0][1]}]}
    state = {"typed_state": json.loads(ROWS[0][3])}
    return {"dialogue_only": one, "state_only": one | state, "oracle_evidence": one | {"official_clause_evidence": proof}, "state_oracle_evidence": one | state | {"official_clause_evidence": proof}}


def test_views_and_requests_equal_plain_python(spark, tables):
    rows, rules, clauses = tables
    evidence = views.evidence_for(rows, rules, clauses, strict=True)
    found = views.evaluation_views(rows, evidence)
    by_key = {(r.scenario_id, r.method): r.view for r in found.collect()}
    for method, view in expected_views().items():
        assert by_key["S1", method] == canon(view)
    assert by_key["S2", "state_oracle_evidence"] == '{"decision_date":null,"dialogue":null,"official_clause_evidence":[],"typed_state":null}'
    requests = views.evaluation_requests(found, "EVAL14", "  Say\n“一”. ", "m").collect()
    of = {r.job_id: r for r in requests}
    for method, view in expected_views().items():
        job = of[f"EVAL14-{method.upper().replace('_', '-')}-S1"]
        payload = {
            "model": "m", "messages": [{"role": "system", "content": "Say\n“一”."}, {"role": "user", "content": canon(view)}], "temperature": 0.0, "max_tokens": 64, "stream": False,
            "response_format": {"type": "json_object"}, "chat_template_kwargs": {"enable_thinking": False},
        }
        assert (job.model_input_sha256, job.request_sha256, job.request_payload) == (sha(view), sha(payload), canon(payload))
        assert not {"label", "primary_action", "scenario_id", "split"} & {k for k in json.loads(canon(view))}
    pairs = sorted([r.job_id, r.model_input_sha256] for r in requests)
    again = views.evaluation_requests(found, "EVAL14", "x", "m")
    assert tuple(views.pairs_digest(again, "job_id", "model_input_sha256").first()) == (8, sha(pairs))
    assert views.pairs_digest(again.limit(0), "job_id", "model_input_sha256").first().sha256 == sha([])
    one, two = (views.checksum(x, "job_id", "model_input_sha256").first() for x in (again, again.orderBy(F.desc("job_id"))))
    assert one == two and views.checksum(again.limit(7), "job_id", "model_input_sha256").first() != one
    jobs = views.job_ledger(again, rows).where("scenario_id = 'S1'").first()
    assert (jobs.component_id, jobs.design_component_id, jobs.gold_action_sha256, jobs.repeat) == ("c", "d", sha("ANSWER"), 1)


@pytest.mark.parametrize("prefix", ["", "eval", "A B", "É"])
def test_bad_prefixes_and_prompts(spark, prefix):
    found = spark.createDataFrame([("S", "m", "{}")], "scenario_id string, method string, view string")
    with pytest.raises(ValueError, match="prefix"):
        views.evaluation_requests(found, prefix, "p", "m")
    with pytest.raises(ValueError, match="prompt"):
        views.evaluation_requests(found, "OK-1_", " \n", "m")


def test_missing_rules_and_clauses_are_named(spark, tables):
    rows, rules, clauses = tables
    lacking = spark.createDataFrame([("S3", ("X", ["R9", "R8"]))], "scenario_id string, label struct<primary_action:string,controlling_rule_ids:array<string>>")
    found = views.evidence_for(lacking, rules, clauses).first()
    assert found.evidence == [] and found.missing == ["clause C9", "rule R8"]
    with pytest.raises(Exception, match="clause C9"):
        views.evidence_for(lacking, rules, clauses, strict=True).collect()


EVIDENCE = "array<struct<role:string,source_clause_id:string,authority:string,title:string,effective_from:string,effective_to:string,article:string,excerpt:string,url:string>>"
RECORD = f"scenario_id string, decision_date date, dialogue array<struct<role:string,text:string,message_id:string>>, state string, evidence {EVIDENCE}"
PROOF = ("controlling", "c1", "a", "t", "f", None, "1", "e", "hidden")


def test_model_input_views(spark):
    good, day = [("assistant", "x", "1"), ("customer", "y", "2")], dt.date(2024, 1, 2)
    rows = [
        ("ok", day, good, '{"b":{"y":1},"a":{}}', [PROOF]), ("empty", day, [], "{}", None), ("none", day, None, "{}", None), ("last", day, good[:1], "{}", None), ("noid", day, [("customer", "y", "")], "{}", None),
        ("twice", day, [("customer", "y", "2")] * 2, "{}", None), ("role", day, good, "{}", [("rumour", *PROOF[1:])]), ("state", day, good, "[1]", None), ("leak", day, good, '{"a":{"label":1}}', []),
    ]
    found = {(r.scenario_id, r.method): r for r in views.model_input_views(spark.createDataFrame(rows, RECORD)).collect()}
    base = {"view_version": "0.2.0", "decision_date": "2024-01-02", "dialogue": [{"role": r, "text": t, "message_id": i} for r, t, i in good]}
    proof = [{"source_clause_id": "c1", "authority": "a", "title": "t", "effective_from": "f", "effective_to": None, "article": "1", "excerpt": "e"}]
    assert found["ok", "direct"].view == canon(base | {"method": "direct"})
    assert found["ok", "evidence_rag"].view == canon(base | {"method": "evidence_rag", "evidence": proof})
    assert found["ok", "state_aware"].view == canon(base | {"method": "state_aware", "evidence": proof, "observed_state": {"a": {}, "b": {"y": 1}}})
    problems = {(s, m): r.problem for (s, m), r in found.items() if r.problem}
    assert {s for s, m in problems if m == "direct"} == {"empty", "none", "last", "noid", "twice"}
    assert {s for s, m in problems if m == "evidence_rag"} - {s for s, m in problems if m == "direct"} == {"role"}
    assert {s for s, m in problems if m == "state_aware"} - {s for s, m in problems if m == "evidence_rag"} == {"state", "leak"}
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        views.model_input_views(spark.createDataFrame(rows, RECORD), strict=True).collect()
    assert views.model_input_views(spark.createDataFrame([], RECORD)).count() == 0


def test_evidence_of_a_wrong_role_ends_the_job(spark):
    df = spark.createDataFrame([([PROOF],), (None,)], f"e {EVIDENCE}")
    kept = [r.e for r in df.select(views.sanitized_evidence(F.col("e")).alias("e")).collect()]
    assert set(kept[0][0].asDict()) == set(views.EVIDENCE_FIELDS) and kept[1] == []
    wrong = spark.createDataFrame([([(None, *PROOF[1:])],)], f"e {EVIDENCE}")
    with pytest.raises(Exception, match="not allowed"):
        wrong.select(views.sanitized_evidence(F.col("e")).alias("e")).collect()


def test_views_keep_only_what_they_name(spark, tables):
    df = spark.createDataFrame([("S", dt.date(2024, 1, 1), "{}", "x", "zh", "f", "s", "h")], "scenario_id string, decision_date date, state string, label string, language string, family_id string, suite string, split string")
    assert views.oracle_view(df).columns == ["scenario_id", "decision_date", "state"]
    assert views.realization_view(df).columns == ["scenario_id", "decision_date", "language", "state"]
    assert views.public_view(df, ["state", "scenario_id"]).columns == ["state", "scenario_id"]
    found = views.scoring_view(df.withColumn("pair_id", F.lit("p"))).first()
    assert (found.pair_id, found.turn_index, found.evidence_ids, found.label) == ("p", None, [], "x")
    assert {(r.scenario_id, r.problem) for r in views.broken_dialogues(tables[0]).collect()} == {("S2", "empty")}


def test_profiles_predictions_and_leaks(spark):
    changed = views.profiled(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")), ["a"], {"c": F.lit(3)})
    assert spark.range(1).select(changed.alias("p")).first().p.asDict() == {"b": 2, "c": 3}
    replaced = views.with_prediction(spark.createDataFrame([("k", "A"), ("l", "B")], "k string, prediction string"), spark.createDataFrame([("k", "C")], "k string, prediction string"), "k")
    assert {(r.k, r.prediction) for r in replaced.collect()} == {("k", "C"), ("l", "B")}
    with pytest.raises(Exception, match="no prediction for l"):
        views.with_prediction(spark.createDataFrame([("k", "A"), ("l", "B")], "k string, prediction string"), spark.createDataFrame([("k", "C")], "k string, prediction string"), "k", required=True).collect()
    df = spark.createDataFrame([(1, '{"a":[{"split":1}]}'), (2, '{"a":1}')], "id int, j string")
    assert [(r.id, r["keys"]) for r in views.leaks(df, "id", "j").collect()] == [(1, ["split"])]
    with pytest.raises(Exception, match="forbidden keys: split"):
        views.leaks(df, "id", "j", strict=True).collect()
