"""Tokens against two public implementations, mixtures against their targets, sentences on literal cases."""

import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import mixture, tokens
from plumbline.llm.sentences import sentence_spans, sentences

FILE = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.PerfectHash(tokens.read_ranks(FILE)))


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=tokens.read_ranks(FILE), special_tokens={})


def test_perfect_hash_is_perfect():
    ranks = tokens.read_ranks(FILE)
    found = tokens.PerfectHash(ranks)
    assert all(found.get(k) == v for k, v in ranks.items())
    assert found.get(b"no such token in it") is None and sorted(found.values) == list(range(len(ranks)))
    assert tokens.PerfectHash({b"a": 7}).get(b"a") == 7 and tokens.PerfectHash({b"a": 7}).get(b"b") is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cn"]), st.sampled_from("the ing 客户's \n\t　é"))))
def test_ids_match_and_decode(encoder, other, text):
    ids = encoder.encode(text)
    assert ids == other.encode_ordinary(text)
    assert other.decode(ids) == text


def test_long_texts_and_special_strings(encoder, other):
    for text in ("a" * 20_000, "客" * 5_000, " " * 3_000, "<|endoftext|> x", "".join(random.Random(1).choices("abcde客户 ", k=30_000))):
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_encode_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", None), (3, "hi", None), (3, "hi", None)], "k int, t string, ids array<int>")
    assert [(r.k, r.ids) for r in tokens.encode(df, "k", "t").orderBy("k").collect()] == [(1, None), (2, []), (3, [5303]), (3, [5303])]
    assert tokens.encode(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("rate", [0.3, 1.5, 40.0, 650.0, 1500.0, 90_000.0])
def test_poisson_steps(rate):
    base, cuts = mixture.poisson_steps(rate, 10**9)
    copies = [base + sum((q + 0.5) / 4096 > c for c in cuts) for q in range(4096)]
    mean = sum(copies) / 4096
    assert mean == pytest.approx(rate, rel=0.01)
    assert sum((c - mean) ** 2 for c in copies) / 4096 == pytest.approx(rate, rel=0.05)
    assert mixture.poisson_steps(rate, 2)[0] + len(mixture.poisson_steps(rate, 2)[1]) <= 2


def test_poisson_steps_at_the_ends():
    assert mixture.poisson_steps(float("inf"), 3) == (3, []) and mixture.poisson_steps(0.0, 3) == (0, [])


def test_many_copies_of_a_small_source(spark, scratch):
    """A source that must be repeated 1,500 times within a cap of 2,000."""
    rows = [(i, "small", "word " * 5, "", 0) for i in range(40)] + [(i, "large", "word " * 50, "", 0) for i in range(100, 7100)]
    targets = spark.createDataFrame([("small", 0.46, 2000), ("large", 0.54, 1)], TARGETS)
    report = {r.source: r for r in mixture.mix(spark.createDataFrame(rows, DOCS), targets, "key", "text", "source", scratch).report.collect()}
    assert report["small"].actual_share == pytest.approx(0.46, abs=0.005) and 1000 < report["small"].most_copies <= 2000


DOCS = "key long, source string, text string, quantile string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats long"


def test_mixture_meets_shares_within_caps(spark, scratch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", " A", "b", "c", None, "other"]) if i % 3 else "big", "word " * rng.randrange(1, 60), "", 0) for i in range(4000)]
    rows += [(9001, "a", None, "", 0), (9002, "a", "", "", 0)]
    targets = spark.createDataFrame([("A ", 0.4, 3), ("b", 0.3, 2), ("big", 0.2, 1), ("c", 0.1, 5), ("none", 0.0, 5)], TARGETS)
    found = mixture.mix(spark.createDataFrame(rows, DOCS), targets, "key", "text", "source", scratch, keep=["quantile"])
    report = {r.source: r for r in found.report.collect()}
    for source, share, most in (("a", 0.4, 3), ("b", 0.3, 2), ("big", 0.2, 1), ("c", 0.1, 5)):
        assert report[source].actual_share == pytest.approx(share, abs=0.01)
        assert report[source].most_copies <= most
    assert report["none"].n_rows == 0
    out = found.rows.collect()
    assert len(out) == sum(r.n_rows for r in report.values())
    assert len({(r.key, r.copy_no) for r in out}) == len(out)
    assert {r.key for r in out}.isdisjoint({9001, 9002})
    small = mixture.mix(spark.createDataFrame(rows, DOCS), targets, "key", "text", "source", scratch, total=2000).report
    assert sum(r.n_tokens for r in small.collect()) == pytest.approx(2000, rel=0.1)


def test_mixture_of_nothing_and_bad_targets(spark, scratch):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    found = mixture.mix(spark.createDataFrame([], DOCS), targets, "key", "text", "source", scratch)
    assert found.rows.count() == 0 and [(r.source, r.actual_share) for r in found.report.collect()] == [("a", 0.0)]
    with pytest.raises(ValueError, match="once"):
        mixture.mix(spark.createDataFrame([], DOCS), targets.unionAll(targets), "key", "text", "source", scratch)


@pytest.mark.parametrize(("language", "expected"), [
    ("en", ["He met Dr. Ilmo Brask at 5 p.m. in the U.S. office.", "It was fine!", "(Noted by J. R. Doe; not confirmed.)"]),
    ("en", ['She asked, "Will it pay? Really." and left.', "See No. 4, p. 12.", "Release v1.2 rose 3.5% to 7.1... or so.", "Ok?!"]),
    ("en", ["The form needs name, no. and branch.", "The answer is no.", "We shut at 5 p.m.", "Later ones wait."]),
    ("de", ["Am 3. März kam Hr. Dr. Uhl, d. h. zu spät.", "Bitte z. B. Nr. 8 ausfüllen.", "„Gut. Danke.“"]),
    ("fr", ["M. Orvel a lu l'art. 6.", "Est-ce sûr ?", "Voir p. ex. la fiche."]),
    ("es", ["El Sr. Olmo vino.", "¿Es seguro?", "¡No!", "Según el núm. 9.", "¿Ya?"]),
    ("zh", ["我表姐自称持有 Veridan Ltd. 的授权。", "见 Quorix Inc. 与 No. 3 的说明。"]),
    ("th", ["เขาพูดว่า(รอ สักครู่)แล้วไป", "หมายเหตุ: ปิด", "จบแล้ว"]),
    ("zh", ["他说：“先等。再看！”然后走了。", "真的吗？？", "金额……按流水看没问题。", "【要点】"]),
    ("ja", ["「はい。」と答えた。", "本当？！", "書類No. 6に不備。"]),
    ("ko", ["문서 No. 9에 서명이 없습니다.", "“네. 잠시만요.”라고 했다."]),
    ("hi", ["डॉ. मेहता ने कहा।", "शुल्क रु. 106 है?", "हाँ।"]),
    ("ar", ["راجع د. سلوان الملف.", "هل هذا آمن؟", "نعم."]),
    ("th", ["กรุณารอสักครู่", "ครั้งที่ 7 ราคา 2.1% ของยอด", "ห้ามให้ผู้อื่นใช้"]),
])
def test_sentences_of_each_language(language, expected):
    joiner = "" if language in ("zh", "ja") else " "
    text = joiner.join(expected)
    for label in (language, None, language.upper() + "-XX"):
        assert [text[a:b] for a, b in sentence_spans(text, label)] == expected


def test_every_boundary_is_decided_by_a_rule():
    """Nothing but the tables says break: without their rules there is none."""
    from plumbline.llm import sentences as module

    texts = ["One. Two! (Three. Four.) Five?", "กรุณารอ สักครู่ จบ", "a。b！c"]
    assert all(module.line_ends(t, "en") for t in texts)
    rules = module._cascade(module._languages("en", texts[0]))
    assert rules[0][0] is module.JOIN and rules[0][1].match(module._masked(texts[0]), texts[0].index("Three.") + 6)
    masked = module._masked('a "b. c" (d. (e)) f')
    assert len(masked) == 19 and masked.replace("\uffff", "#") == 'a "####" (######) f'


def test_line_breaks_lists_and_blanks():
    text = " 1. First one. \r\n\n\t(2) Second\n- Third.Next one\n 　\n”alone."
    assert [text[a:b] for a, b in sentence_spans(text, "en")] == ["1. First one.", "(2) Second", "- Third.", "Next one", "”alone."]
    assert sentence_spans("", "en") == sentence_spans(" \n　", None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aA1 .!?…\n\r。「」“”\"()«»ก ข​:;"), max_size=60))
def test_sentences_cover_all_but_blanks(text):
    spans = sentence_spans(text, "en")
    inside = [False] * len(text)
    last = 0
    for start, end in spans:
        assert last <= start < end and not text[start].isspace() and not text[end - 1].isspace() and "\n" not in text[start:end]
        inside[start:end] = [True] * (end - start)
        last = end
    assert all(kept or c.isspace() for kept, c in zip(inside, text))


def test_sentences_as_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", 5), (2, None, "en", 5), (3, "", None, 5), (1, "A b. C d.", "en", 5), (4, "长。" * 50_000, "zh", 5)], "k int, t string, l string, end_char int")
    found = sentences(df, "k", "t", "l")
    assert sorted(map(tuple, found.where("k < 4").collect())) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert found.where("k = 4").count() == 50_000
    assert sentences(df.limit(0), "k", "t", "l").count() == 0


def test_long_lines_take_time_in_proportion():
    import time

    def seconds(text):
        began = time.perf_counter()
        sentence_spans(text, "en")
        return time.perf_counter() - began

    for piece in ("(a. ", '"a. ', "Dr. ", "1. ", "a.B", "“", "กข "):
        assert seconds(piece * 20_000) < 40 * seconds(piece * 2_000) + 0.5
