"""Lexical edges: exact stars, near pairs against brute force, nulls and nothing."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import normal_form
from plumbline.operators import lexical


def test_edges(spark, scratch):
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} term" for i in range(60))
    rows = [("b", "The SAME, text!"), ("a", "the same text"), ("c", "the  same text"), ("d", base), ("e", base.replace("wordab", "other")), ("f", None), ("g", ""), ("h", "quite something else"), ("i", "ab"), ("i", "ab")]
    found = lexical.lexical_edges(spark.createDataFrame(rows, "id string, t string"), "id", "t", scratch).collect()
    assert {(r.left_id, r.right_id) for r in found if r.edge_type == "exact_semantic_signature"} == {("a", "b"), ("a", "c")}
    near = {(r.left_id, r.right_id, r.edge_type): r.score for r in found if r.edge_type != "exact_semantic_signature"}
    assert ("d", "e", "char_ngram") in near and all(0.8 < s < 1 for s in near.values())
    assert lexical.lexical_edges(spark.createDataFrame([], "id string, t string"), "id", "t", scratch).count() == 0


def test_sets():
    assert lexical.tokens("a1 <num> 你好 b") == {"a1", "<num>", "你", "好", "b", "a1 <num>", "<num> 你", "你 好", "好 b"}
    assert len(lexical.trigrams("a b c d")) == 2 and len(lexical.trigrams("ab")) == 0
    assert lexical.jaccards("", "") == (0.0, 0.0) and lexical.jaccards("a b c", "a b c") == (1.0, 1.0)


def _family(rng, size):
    words = ["".join(rng.choices("abcdefgh客户手续费", k=rng.randrange(2, 7))) for _ in range(rng.randrange(30, 90))]
    for _ in range(size):
        copy = list(words)
        for _ in range(rng.randrange(0, 1 + len(copy) // 8)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz") * rng.randrange(1, 4)
        yield " ".join(copy)


@pytest.mark.parametrize("block", [2000, 3])
def test_near_edges_match_brute_force(spark, scratch, monkeypatch, block):
    """Families edited up to and beyond the thresholds, one of them large, also in blocks."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(3)
    texts = [t for i in range(14) for t in _family(rng, 60 if i == 0 else 6)]
    rows = [(f"{i:03d}", t) for i, t in enumerate(texts)]
    heads = {}
    for i, t in rows:
        heads.setdefault(normal_form(t), i)
    expected, near = {}, 0
    for a, i in heads.items():
        for b, j in heads.items():
            if i < j:
                c, w = lexical.jaccards(a, b)
                expected |= {(i, j, k): s for k, s, least in (("char_ngram", c, 0.82), ("token_jaccard", w, 0.88)) if s >= least}
                near += 0.78 < c < 0.86
    found = lexical.lexical_edges(spark.createDataFrame(rows, "id string, t string"), "id", "t", scratch).where(F.col("edge_type") != "exact_semantic_signature").collect()
    assert {(r.left_id, r.right_id, r.edge_type): r.score for r in found} == expected and len(found) == len(expected)
    assert near > 50 and len(expected) > 300
