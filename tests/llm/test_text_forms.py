"""Formatting-blind records and consistent text forms against plain versions."""

import json
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import formatting, lookalike

SCHEMA = "id string, d array<struct<role:string,text:string>>, s string, n_copies long, canonical string"


def plain(value):
    return "".join(c for c in value.casefold() if not c.isspace() and unicodedata.category(c)[0] != "P")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA ß.,。，「　\t\n_-𐄀😀"))))
def test_plain_matches_a_character_loop(value):
    assert formatting.plain(value) == plain(value)


def test_structure_survives():
    def form(state, roles=("r",), texts=("t",)):
        return formatting.canonical_record(list(roles), list(texts), state)

    assert form('{"a":{"x":"Public_Fund","y":1}}') == form(' { "a" : {"y":1, "x":" public fund."} } ')
    assert form('{"a":null}') != form('{"a":"null"}') != form("{}")
    assert form('{"a":1.5}') != form('{"a":15}') and form('{"a":-1}') != form('{"a":1}')
    assert form('{"a":"b","c":"d"}') != form('{"a":"bc","d":""}')
    assert form("{}", texts=["ab"]) != form("{}", roles=["r", "r"], texts=["a", "b"])
    assert form("{}", texts=[None]) != form("{}", texts=[""])
    assert form("no json") == form("NO, JSON!") and form(None) != form("null") or form(None) == form("null")
    assert form('{"a":"\\u0002"}') != form('{"a":null}')
    assert form("[" * 100_000) == form("[" * 100_000)


def rows(*items):
    return [(i, None if turns is None else [("customer", t) for t in turns], s, 9, "x") for i, turns, s in items]


def test_collapse(spark, scratch):
    long = "长" * 200_000
    df = spark.createDataFrame(rows(("b", ["Hello, world"], '{"a":"X"}'), ("a", ["hello world!"], '{ "a": "x" }'), ("c", ["hello world!"], '{ "a": "x" }'), ("d", ["hello world"], "{}"), ("e", None, "{}"), ("f", [], "{}"), ("g", None, "{}"), ("h", [long], None), ("i", [long + " "], None), (None, ["hello world"], "{}")), SCHEMA)
    found = formatting.collapse_formatting(df, "id", "d", "s", scratch)
    assert sorted(map(tuple, found.records.collect())) == [("a", 3), ("d", 1), ("e", 1), ("f", 1), ("g", 1), ("h", 2)]
    assert sorted(map(tuple, found.members.collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("h", "h"), ("h", "i")]


def test_collapse_of_nothing_and_of_one_hot_record(spark, scratch):
    empty = formatting.collapse_formatting(spark.createDataFrame([], SCHEMA), "id", "d", "s", scratch)
    assert empty.records.count() == 0 and empty.members.count() == 0
    hot = rows(*[(f"{i:04d}", ["Same." if i % 2 else "same"], "{}") for i in range(400)])
    found = formatting.collapse_formatting(spark.createDataFrame(hot, SCHEMA), "id", "d", "s", scratch)
    assert [tuple(r) for r in found.records.collect()] == [("0000", 400)] and found.members.count() == 400


def slow_form(text):
    """The whole text at once, without segments."""
    kept = "".join(c for c in text if not lookalike._is_widthless(c))
    value = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", kept).translate(lookalike.LOOKALIKES))
    return "".join(" " if unicodedata.category(c) == "Zs" else c for c in value)


ALPHABET = st.one_of(
    st.characters(codec="utf-8"), st.sampled_from("aeё éе̧́​­　 ﬁ가각Ａ，⽉\U0001d400\U000e0100\n"),
)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30))
def test_segments_equal_the_whole(text):
    assert lookalike.consistent_form(text) == slow_form(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=30))
def test_form_is_stable(text):
    once = lookalike.consistent_form(text)
    assert lookalike.consistent_form(once) == once


@pytest.mark.parametrize(("a", "b"), [("Ａ１，", "A1,"), ("é", "é"), ("рaу", "pay"), ("a b　c", "a b c"), ("a​b﻿", "ab"), ("⽉", "月"), ("е‍́", "é")])
def test_equal_looking(a, b):
    assert lookalike.consistent_form(a) == lookalike.consistent_form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("a,", "a."), ("a b", "a  b"), ("a\nb", "a b"), ("к", "k")])
def test_visible_differences(a, b):
    assert lookalike.consistent_form(a) != lookalike.consistent_form(b)


def test_pairs(spark):
    df = spark.createDataFrame(rows(("a", ["pay"], None), ("b", ["рay"], None), ("c", ["pay"], None), ("d", ["pay", ""], None), ("e", None, None), ("f", [], None), ("g", ["ｐay"], None), ("g", ["ｐay"], None), ("h", [None], None), ("i", [None], None), (None, ["pаy"], None)), SCHEMA)
    found = sorted(map(tuple, lookalike.equal_looking(df, "id", "d").collect()))
    assert found == [("a", "b"), ("a", "g"), ("b", "c"), ("b", "g"), ("c", "g")]
    assert lookalike.equal_looking(df.limit(0), "id", "d").count() == 0


@pytest.mark.parametrize("block", [20_000, 3])
def test_pairs_of_many_equal_texts(spark, monkeypatch, block):
    """A hot form: the work is that of the answer, not of all pairs of its members."""
    monkeypatch.setattr(lookalike, "BLOCK", block)
    n = 200_000 if block > 3 else 40
    same = spark.range(n).selectExpr("format_string('%07d', id) AS id", "array(struct('c' AS role, 'pay' AS text)) AS d")
    other = spark.createDataFrame([("x1", [("c", "рay")]), ("x2", [("c", "ｐay")])], "id string, d array<struct<role:string,text:string>>")
    found = lookalike.equal_looking(same.unionAll(other), "id", "d")
    assert found.count() == 2 * n + 1
    assert found.where("left_id < right_id").distinct().count() == 2 * n + 1


def test_random_records_against_pairwise_comparison(spark, scratch):
    rng = random.Random(4)
    words = ["Fund A", "fund a.", "FUND_A", "Other", "other!"]
    items = [(f"{i:03d}", [rng.choice(words) for _ in range(rng.randrange(1, 3))], json.dumps({"k": rng.choice(["v", "V ", None]), "l": 1}, indent=rng.choice([None, 1]))) for i in range(60)]
    df = spark.createDataFrame(rows(*items), SCHEMA)

    def key(item):
        state = json.loads(item[2])
        return [plain(t) for t in item[1]], None if state["k"] is None else plain(state["k"])

    expected = set()
    for a in items:
        group = [b[0] for b in items if key(a) == key(b)]
        if len(group) > 1:
            expected.add((min(group), a[0]))
    assert set(map(tuple, formatting.collapse_formatting(df, "id", "d", "s", scratch).members.collect())) == expected


def test_composed_lookalikes_equal_their_parts():
    """Every character that decomposes into a look-alike, as stored composed, decomposed and beside a zero-width character."""
    found = 0
    for point in (p for p in range(0x30000) if not 0xD800 <= p < 0xE000):
        char = chr(point)
        parts = unicodedata.normalize("NFKD", char)
        if parts == char or not any(ord(c) in lookalike.LOOKALIKES for c in parts):
            continue
        found += 1
        variants = (char, unicodedata.normalize("NFD", char), parts, char + "\u200b", "\u200b" + char, "\u200b".join(parts))
        assert len({lookalike.consistent_form(f"x{v}y") for v in variants}) == 1, hex(point)
    assert found > 100
    assert lookalike.consistent_form("\u0451") == lookalike.consistent_form("\u0435\u0308") == "\u00eb"


def test_each_character_has_one_form_beside_a_zero_width_one():
    for point in (p for p in range(0x30000) if not 0xD800 <= p < 0xE000):
        char = chr(point)
        assert lookalike.consistent_form(char) == lookalike.consistent_form(char + "\u200b"), hex(point)
