"""Injected clients: retries, failures as rows, pages; and the smaller operators beside them."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical, text
from plumbline.operators import agreement, scoring, style, validators
from plumbline.sources import jsonl, remote, sinks


def test_pause_grows_and_repeats():
    waits = [remote.pause(k, "job") for k in range(1, 8)]
    assert waits == [remote.pause(k, "job") for k in range(1, 8)]
    assert all(min(2 ** (k - 1), 8) <= w <= min(2 ** (k - 1), 8) + 0.25 for k, w in enumerate(waits, 1))


def test_calls_are_tried_again_and_failures_kept():
    slept, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert remote.called(flaky, "s", slept.append) == ("ok", None, 3) and len(slept) == 2
    result, error, attempts = remote.called(lambda: 1 / 0, "s", slept.append)
    assert result is None and error.startswith("ZeroDivisionError") and attempts == remote.TRIES


def test_pages_and_answers(spark):
    def never(seconds):
        pass

    def page(number):
        if number == 2:
            raise ValueError("no page")
        return f"body {number}"

    def reply(payload):
        if "bad" in payload:
            raise OSError("down")
        return payload.upper()

    pages = {r.page: (r.body, r.attempts) for r in remote.read_pages(spark, 3, page, sleep=never).collect()}
    assert pages == {1: ("body 1", 1), 2: (None, 4), 3: ("body 3", 1)}
    requests = spark.createDataFrame([("a", "x"), ("b", "bad")], "job_id string, payload string")
    found = {r.job_id: (r.response, r.api_error) for r in remote.answer(requests, reply, sleep=never).collect()}
    assert found == {"a": ("X", None), "b": (None, "OSError: down")}


def test_pending_jobs_skip_failed_ones(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    events = spark.createDataFrame([("a", 1), ("b", 2), (None, 1)], "job_id string, run_generation long")
    assert sorted(r.job_id for r in scoring.pending_jobs(jobs, events).collect()) == ["b", "c"]
    assert [r.job_id for r in scoring.pending_jobs(jobs, events, canary=1).collect()] == ["b"]


def test_nearest_and_markers(spark, scratch):
    left = spark.createDataFrame([(1, "abcd"), (2, "zz"), (3, None), (4, "")], "id long, text string")
    right = spark.createDataFrame([(9, "abcd"), (8, "abcd"), (7, "abxx")], "id long, text string")
    assert [tuple(r) for r in style.nearest(left, right, 2, scratch).collect()] == [(1, 8, 1.0)]
    found = style.marker_rates(left.withColumn("k", F.lit("k")), "k", F.col("text"), {"z": "z"}).first()
    assert (found.n, found.n_z) == (3, 1)


@pytest.mark.parametrize("first", [1, 8])
def test_nearest_matches_every_comparison(spark, scratch, monkeypatch, first):
    monkeypatch.setattr(style, "FIRST", first)
    rng = random.Random(9)
    rows = [[(i, "".join(rng.choices("abcde", k=rng.randrange(1, 30)))) for i in range(n)] for n in (40, 90)]
    sets = [[(i, {t[k : k + 2] for k in range(len(t) - 1)}) for i, t in side] for side in rows]
    expected = set()
    for i, x in sets[0]:
        scored = [(-len(x & y) / len(x | y), j) for j, y in sets[1] if x & y]
        if scored:
            expected.add((i, min(scored)[1], -min(scored)[0]))
    left, right = (spark.createDataFrame(side, "id long, text string") for side in rows)
    assert {tuple(r) for r in style.nearest(left, right, 2, scratch).collect()} == expected


def test_votes_and_broad_agreement(spark):
    rows = spark.createDataFrame([("a", {"x": 3, "y": 2}), ("b", {"x": 4}), ("c", None), ("d", {"x": None})], "k string, v map<string,long>")
    assert sorted((r.k, r.total) for r in agreement.wrong_vote_totals(rows, "k", "v").collect()) == [("b", 4), ("d", 0)]
    ratings = spark.createDataFrame([(1, "a", 3)] * 5 + [(2, "a", 1)] * 4 + [(2, "b", 5)], "item int, c string, s long")
    found = agreement.broad_agreement(ratings, "item", "c", "s").first()
    assert (found.items, found.unanimous, found.four_agree, found.within_one, found.mean_score) == (2, 1, 2, 1, 2.4)


def test_small_text_helpers_and_checksums(spark, tmp_path):
    row = spark.range(1).select(text.absolute_url(F.lit("//x/y")).alias("u"), text.percent(F.lit(0.1234)).alias("p"), text.record_id(F.lit("a"), F.lit("b")).alias("r")).first()
    assert (row.u, row.p, len(row.r)) == ("https://x/y", "12.3%", 20)
    sinks.write_checksums(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string"), str(tmp_path / "sums"))
    assert (tmp_path / "sums").read_text() == "1  a\n2  b\n"


def test_documents_prompts_and_contents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "a": 1\n}')
    assert jsonl.read_json_document(spark, str(tmp_path / "d.json"), "a long").first().a == 1
    (tmp_path / "p.txt").write_text("  ask\nthis \n")
    assert jsonl.read_prompt(spark, str(tmp_path / "p.txt")) == "ask\nthis"
    (tmp_path / "e.txt").write_text(" \n")
    with pytest.raises(ValueError, match="no text"):
        jsonl.read_prompt(spark, str(tmp_path / "e.txt"))
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}',), ("{}",), ("x",), (None,)], "r string")
    assert [r.c for r in df.select(canonical.message_content(F.col("r")).alias("c")).collect()] == ["hi", None, None, None]


def test_digests_and_second_rounds(spark):
    df = spark.createDataFrame([("a", "0CC175B9C0F1B6A831C399E269772661"), ("b", None)], "k string, d string")
    assert [r.k for r in validators.digest_mismatches(df, "k", "d", F.md5(F.col("k").cast("binary"))).collect()] == ["b"]
    votes = spark.createDataFrame([(1, c, True, 5) for c in "aaaab"] + [(2, c, False, 4) for c in "aaaaa"] + [(3, c, True, 5) for c in "aabbc"], "item int, choice string, ok boolean, conf int")
    decided = {r.item: (r.decision, r.votes) for r in agreement.panel_decisions(votes, "item", "choice", "ok", "conf").collect()}
    assert decided == {1: ("confirm", 4), 2: ("revise", 5), 3: ("unresolved", 2)}
