"""Text forms, JSON, parsing, views and validators on literal cases."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical, text
from plumbline.operators import agreement, keywords, validators, views
from plumbline.sources import jsonl, sinks

ACTIONS = ("ANSWER", "CLARIFY", "REFUSE", "ESCALATE")


def test_forms():
    assert text.compact_form("Ａ， B。证券") == "ab证券"
    assert text.normal_form("Am 3.5.2024: 12/7 Ａ_b") == "am <num> <num> a b"
    assert text.normal_form("") == ""


def test_ngrams_of_short_text(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,), ("aaaa",)], "t string")
    found = [sorted(r.g) if r.g is not None else None for r in df.select(text.ngrams(F.col("t"), 3).alias("g")).collect()]
    assert found == [["abc", "bcd"], [], [], [], ["aaa"]]


@pytest.mark.parametrize(("value", "kinds"), [
    ("contact 13800138000 for this test", {"mainland_mobile_number"}),
    ("nothing to see", set()), ("证件 11010519491231002X", {"mainland_identity_number", "long_account_like_number"}),
    ("id 110105194912310021", {"mainland_identity_number", "long_account_like_number"}),
    ("mail a.b@example.org now", {"email_address"}), ("证a@example.org", set()), ("at 10.0.0.1.", {"ipv4_address"}),
    ("API_KEY = x", {"credential_assignment"}), ("我的身份证号是", {"explicit_chinese_identifier_disclosure"}), ("１３８００１３８０００", set()),
])
def test_findings(spark, value, kinds):
    df = spark.createDataFrame([(1, value), (2, None)], "id int, t string")
    assert {r.kind for r in text.findings(df, ["id"], "t").collect()} == kinds


def test_shared_grams_match_plain_sets(spark):
    rows = [(1, "abcabcabd"), (2, "xabcaby"), (3, "zz"), (4, None), (5, ""), (1, "abcab"), (6, "手续费手续费率")]
    clauses = [(10, "abcabd"), (11, "续费手续费"), (12, None), (13, "qqqqqq")]
    sets = [[(k, {t[i : i + 4] for i in range(len(t or "") - 3)}) for k, t in side] for side in (rows, clauses)]
    expected = {}
    for k, x in sets[0]:
        for c, y in sets[1]:
            if x & y:
                expected[k, c] = expected.get((k, c), 0) + len(x & y)
    left, right = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(clauses, "clause long, text string")
    found = {(r.id, r.clause): r.shared for r in text.gram_overlap(left, "id", right, "clause", 4).collect()}
    assert found == expected and len(expected) >= 3
    assert text.gram_overlap(left, "id", right.limit(0), "clause", 4).count() == 0
    assert text.gram_hashes(["aaaaaa", None, "ab", "", "abcd", "a"], 3)[0].tolist() == [0, 4, 4] and len(text.gram_hashes([], 3)[0]) == 0


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_overlap_counts_without_rows_of_pairs(spark, scratch, monkeypatch, bits):
    """Boilerplate shared by all of both sides is added up by text, not joined (F3); filters that are full change nothing."""
    monkeypatch.setattr(text, "MOST_BITS", bits)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(12)]
    texts = [(rng.randrange(60), rng.choice([None, "ab", "".join(rng.choices(words, k=4))])) for _ in range(200)] + [(None, words[0] + words[1])]
    clauses = [(rng.randrange(30), rng.choice([None, "", "".join(rng.choices(words, k=3))])) for _ in range(50)] + [(None, words[1] + words[0])]
    sets = [[(k, {t[i : i + 7] for i in range(len(t or "") - 6)}) for k, t in side] for side in (texts, clauses)]
    shared = {}
    for k, x in sets[0]:
        for c, y in sets[1]:
            if x & y:
                shared.setdefault(k, Counter())[c] += len(x & y)
    left, right = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(clauses, "clause string, text string")
    found = text.overlap_counts(left, "id", right, "clause", 7, scratch)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {r.id: (r.n_clauses, r.most_shared) for r in found.collect()} == {k: (len(v), max(v.values())) for k, v in shared.items()} and len(shared) > 30
    assert text.overlap_counts(left, "id", right.limit(0), "clause", 7, scratch).count() == 0
    assert text.overlap_counts(left.limit(0), "id", right, "clause", 7, scratch).count() == 0


@pytest.mark.parametrize(("path", "value", "found"), [
    ("a/b.TAR.GZ", None, {"nested archive"}), ("a.txt", "the request_payload", {"operational marker"}), ("a.txt", "in c:\\USERS\\x", {"local marker"}),
    ("a.txt", "host 192.168.0.7", {"infrastructure"}), ("a.txt", "host 172.32.0.7", set()), ("a.txt", "/srv/data", {"infrastructure"}),
    ("a.txt", "mail a@b.cn", {"personal data"}), ("skip.txt", "request_payload /root/x", set()), ("a.txt", "", set()),
])
def test_policy_findings(spark, path, value, found):
    df = spark.createDataFrame([(1, path, value)], "id int, p string, t string")
    assert {r.finding for r in text.policy_findings(df, "id", "p", "t", ["skip.txt"]).collect()} == found


def test_registry(spark):
    from plumbline.operators import registry

    rows = [
        (2, "c", "m1", "q2", "later", "//x/2", "2024-02-01", "<p>投诉处理</p> 微信"), (1, "c", "m1", "q1", "<b>first</b>", "//x/1", "2024-01-01", "适当性"), (3, "d", None, "q1", "t", "https://y/3", None, "内幕信息，操纵市场"),
        (4, "d", "m4", "q1", "nothing", "//z", "2023-01-01", "none of them"), (5, "d", None, None, None, None, None, None),
    ]
    found = registry.registry(spark.createDataFrame(rows, "arrival long, channel string, manuscript string, query string, title string, url string, published string, content string"))
    of = {r.source_channel: r for r in found.collect()}
    assert set(of) == {"c", "d"} and found.count() == 2
    assert (of["c"].title, of["c"].url, of["c"].published_date, of["c"].query_terms) == ("first", "https://x/1", "2024-01-01", ["q1", "q2"])
    assert of["c"].categories == ["complaint_workflow", "public_or_social_channel", "suitability_and_access"] and len(of["c"].record_id) == 20
    assert [(e.category, e.term) for e in of["d"].evidence] == [("inside_information", "内幕信息"), ("market_manipulation", "操纵市场")]
    assert [r.source_channel for r in registry.latest(found, 5).collect()] == ["c", "d"]
    counted = registry.counts(found, "categories")
    scenarios = spark.createDataFrame([("s1", (["A", "A", "B"],)), ("s2", (["P"],)), ("s3", (["X"],)), ("s4", (None,))], "scenario_id string, label struct<controlling_rule_ids:array<string>>")
    rules = spark.createDataFrame([("A", ["inside_information", "conflict_of_interest"]), ("B", []), ("P", [registry.PROXY])], "rule_id string, categories array<string>")
    covered = {r.rule_id: (r.scenario_support, r.record_categories_present, r.covered_by_records, r.covered_by_anchors) for r in registry.rule_coverage(scenarios, rules, counted).collect()}
    assert covered == {"A": (2, ["inside_information"], True, True), "B": (1, [], False, False), "P": (1, [], False, True), "X": (1, [], False, False)}
    assert tuple(registry.scenario_coverage(scenarios, rules, counted).first()) == (4, 1, 2)


def test_tags_and_categories(spark):
    df = spark.createDataFrame([("<p>a <b>fee</b>\n x</p>",), (None,)], "t string")
    assert [r[0] for r in df.select(text.stripped_tags(F.col("t"))).collect()] == ["a fee x", None]
    found = df.select(text.categories(F.col("t"), {"c": ["fee", "x"], "d": ["no"]}).alias("c")).first().c
    assert [(c.category, c.evidence) for c in found] == [("c", ["fee", "x"])]


@pytest.mark.parametrize(("content", "action", "errors"), [
    ('{"action":"CLARIFY"}', "CLARIFY", []), ('{"action":"ANSWER","why":1}', "ANSWER", ["keys_must_equal_action"]), ("not json", None, ["json_decode"]),
    ('{"action":"A"} x', None, ["json_decode"]), ("[1]", None, ["not_object"]), ('{"action":1}', None, ["invalid_action"]), ('{"action":"ANSWER","action":"REFUSE"}', "REFUSE", []), (None, None, ["no_content"]),
])
def test_read_action(content, action, errors):
    assert canonical.read_action(content, ACTIONS) == (action, errors)


def test_canonical_json_and_digests(spark):
    assert canonical.canonical_json('{"b": [1, {"z":null,"a":"é"}], "a": 0.0}') == '{"a":0.0,"b":[1,{"a":"é","z":null}]}'
    assert canonical.canonical_json("{") is None
    df = spark.createDataFrame([('say "x"\n',)], "t string").select(canonical.string_digest(F.col("t")).alias("d"))
    import hashlib

    assert df.first().d == hashlib.sha256(json.dumps('say "x"\n').encode()).hexdigest()


def test_leaks_and_keys(spark):
    df = spark.createDataFrame([(1, '{"a":[{"label":1}],"split":2}'), (2, '{"a":1}'), (3, None), (4, "x")], "id int, j string")
    assert [(r.id, r.keys) for r in views.leaks(df, "id", "j").collect()] == [(1, ["label", "split"])]
    found = {r.id: (r.unexpected, r.absent) for r in validators.unexpected_keys(df, "id", "j", ["a"]).collect()}
    assert found == {1: (["split"], []), 3: ([], ["a"]), 4: ([], ["a"])}


def test_validators(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "k string, v int")
    assert sorted((r.k or "", r.n) for r in validators.repeated_keys(df, ["k"]).collect()) == [("", 1), ("", 1), ("a", 2)]
    with pytest.raises(Exception, match="keys are not unique"):
        validators.assert_unique(df, ["k"]).collect()
    assert validators.assert_unique(df.where("k = 'b'"), ["k"]).count() == 1
    other = spark.createDataFrame([("b", 6), ("c", 1)], "k string, v int")
    found = {r.k: r.problem for r in validators.unequal(df.where("k = 'b'"), other, ["k"], ["v"]).collect()}
    assert found == {"b": "differs", "c": "right_only"}


def test_kappa_wilson_and_icc(spark):
    same = spark.createDataFrame([(i, r, i % 2) for i in range(4) for r in range(3)], "item int, rater int, c int")
    assert agreement.fleiss_kappa(same, "item", "c").first().kappa == 1.0
    one = spark.createDataFrame([(1, r, 0) for r in range(3)], "item int, rater int, c int")
    assert agreement.fleiss_kappa(one, "item", "c").first().kappa is None
    ragged = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1)], "item int, rater int, c int")
    assert agreement.fleiss_kappa(ragged, "item", "c").first().equal is False
    low, high = agreement.wilson(F.lit(7), F.lit(500))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(r.l, 4), round(r.h, 4)) == (0.0068, 0.0286)
    # The classic six targets and four judges.
    scores = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    df = spark.createDataFrame([(i, j, s) for i, row in enumerate(scores) for j, s in enumerate(row)], "item int, rater int, s long")
    icc = agreement.intraclass(df, "item", "rater", "s").first()
    assert (round(icc.icc_single, 2), round(icc.icc_average, 2)) == (0.29, 0.62)


def test_keyword_priors(spark):
    counts = {"ANSWER": 2836, "CLARIFY": 985, "ESCALATE": 1748, "REFUSE": 2431}
    df = spark.createDataFrame(list(counts.items()), "label string, n int").select("label", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    import math

    found = {r.label: r.prior for r in keywords.label_counts(df, "label").collect()}
    assert all(abs(found[k] - math.log((n + 1) / 8004)) < 1e-12 for k, n in counts.items())


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"b":"é","a":1}\n\n{"b":null,"a":2}\n', encoding="utf-8")
    df = jsonl.read_jsonl(spark, str(folder / "a.jsonl"), "a long, b string")
    assert df.count() == 2
    sinks.write_jsonl(df, str(tmp_path / "out"), ["a"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    with pytest.raises(Exception, match="exists"):
        sinks.write_jsonl(df, str(tmp_path / "out"), ["a"])
    (folder / "bad.jsonl").write_text("[1]\n{\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        jsonl.read_jsonl(spark, str(folder / "bad.jsonl"), "a long").collect()
    files = jsonl.file_digests(spark, str(folder))
    assert files.count() == 2
    changed = files.withColumn("sha256", F.when(F.col("path") == "a.jsonl", F.lit("0")).otherwise(F.col("sha256")))
    assert [(r.path, r.problem) for r in jsonl.manifest_differences(changed, files).collect()] == [("a.jsonl", "content")]
    sinks.write_report(df, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        sinks.write_report(df, str(tmp_path / "r.json"))
    with pytest.raises(ValueError, match="outside"):
        sinks.inside(str(tmp_path), "../x")
    assert "\\_" in sinks.latex_table(df.withColumnRenamed("a", "a_b"), ["a_b"]) and sinks.markdown_table(df, ["a"]).count("\n") == 4
    sinks.write_csv(df.select(F.struct("a", "b").alias("s")), str(tmp_path / "csv"), ["s.a", "s.b"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["s_a", "s_b"]
