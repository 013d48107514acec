"""Components, clusters and covers against sequential programs."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph


def sequential(vertices, edges):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            for x in (a, b):
                parent.setdefault(x, x)
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, scratch, seed):
    rng = random.Random(seed)
    vertices = [f"v{i:03d}" for i in range(120)]
    edges = [(rng.choice(vertices), rng.choice(vertices)) for _ in range(70)] + [("v000", f"v{i:03d}") for i in range(60, 90)] + [(None, "v001")]
    found = graph.components(spark.createDataFrame([(v,) for v in vertices], "v string"), spark.createDataFrame(edges, "a string, b string"), scratch)
    assert {r.v: r.root for r in found.collect()} == sequential(vertices, edges)


def test_a_long_path_and_no_edges(spark, scratch):
    ids = spark.range(300).select(F.format_string("%04d", "id").alias("v"))
    path = spark.range(299).select(F.format_string("%04d", "id").alias("a"), F.format_string("%04d", F.col("id") + 1).alias("b"))
    assert {r.root for r in graph.components(ids, path, scratch).collect()} == {"0000"}
    assert graph.components(ids, path.limit(0), scratch).where("v <> root").count() == 0


def test_size_summary(spark):
    found = graph.size_summary(spark.createDataFrame([(1,), (1,), (2,)], "n long")).first()
    assert (found.components, found.minimum_rows, found.median_rows, found.maximum_rows, found.maximum_share) == (3, 1, 1, 2, 0.5)
    assert found.hhi == 6 / 16 and found.effective_components == 16 / 6


PAIRS = "block_a string, block_b string, edge_count long, n_exact_semantic_signature long, n_char_ngram long, n_token_jaccard long, max_score double, priority int"


def test_bounded_clusters_respect_the_cap_and_the_order(spark, scratch):
    weights = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 1)], "block string, n long")
    pairs = spark.createDataFrame([("a", "b", 1, 0, 1, 0, 0.9, 2), ("b", "c", 1, 1, 0, 0, 1.0, 3), ("c", "d", 9, 0, 0, 9, 0.9, 1)], PAIRS)
    clusters = graph.bounded_clusters(weights, pairs, 8, scratch)
    assert {r.block: r.cluster for r in clusters.collect()} == {"a": "a", "b": "b", "c": "b", "d": "b"}
    report = graph.cluster_report(clusters, pairs).first()
    assert (report.components, report.maximum_rows, report.most_blocks, report.accepted_pairs, report.rejected_pairs) == (2, 8, 3, 2, 1)


def test_bounded_clusters_match_a_loop_over_the_pairs(spark, scratch):
    rng = random.Random(6)
    weights = {f"b{i:02d}": rng.randrange(1, 60) for i in range(40)}
    pairs = {tuple(sorted(rng.sample(sorted(weights), 2))): (rng.randrange(1, 4), rng.randrange(3), rng.randrange(1, 9), rng.choice([0.8, 0.9, 1.0])) for _ in range(150)}
    rows = [(a, b, n, e, 0, 0, score, p) for (a, b), (p, e, n, score) in pairs.items()]
    cluster, accepted, rejected = {b: b for b in weights}, 0, 0
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (*x[1], x[0]), reverse=True):
        x, y = cluster[a], cluster[b]
        if x == y:
            continue
        sizes = {c: sum(weights[k] for k in weights if cluster[k] == c) for c in (x, y)}
        if sum(sizes.values()) > 120:
            rejected += 1
            continue
        accepted += 1
        keep, drop = sorted((x, y), key=lambda c: (-sizes[c], c))
        cluster = {k: keep if c == drop else c for k, c in cluster.items()}
    found = graph.bounded_clusters(spark.createDataFrame(list(weights.items()), "block string, n long"), spark.createDataFrame(rows, PAIRS), 120, scratch)
    assert {r.block: r.cluster for r in found.collect()} == cluster
    report = graph.cluster_report(found, spark.createDataFrame(rows, PAIRS)).first()
    assert (report.accepted_pairs, report.rejected_pairs) == (accepted, rejected)


ENDS = "left_family_id string, right_family_id string"


def ordered(df):
    return sorted(((r.family, r.n_edges) for r in df.collect()), key=lambda x: (-x[1], x[0]))


def test_cover_is_greedy_with_ties_to_the_least(spark, scratch):
    edges = spark.createDataFrame([("f1", "f2"), ("f1", "f3"), ("f4", "f5"), ("f6", "f6"), (None, "f1")], ENDS)
    for most in (100, 1):
        assert ordered(graph.family_cover(edges, scratch, most)) == [("f1", 2), ("f4", 1), ("f6", 1)]
    assert graph.family_cover(edges.limit(0), scratch).count() == 0


@pytest.mark.parametrize("most", [10_000, 12, 0])
def test_cover_matches_a_plain_loop_in_one_task_and_in_rounds(spark, scratch, most):
    rng = random.Random(7)
    names = [f"f{i:02d}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(36)] + [("f00", rng.choice(names)) for _ in range(12)]
    live, expected = list(edges), []
    while live:
        counts = {f: sum(f in e for e in live) for f in names}
        best = min(names, key=lambda f: (-counts[f], f))
        expected.append((best, counts[best]))
        live = [e for e in live if best not in e]
    assert ordered(graph.family_cover(spark.createDataFrame(edges, ENDS), scratch, most)) == expected


def test_components_of_variants_and_without_vertices(spark, scratch):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "")], "id string, f string")
    edges = spark.createDataFrame([("b", "c"), ("c", "d")], "left_id string, right_id string")
    kept = graph.without_vertices(edges, spark.createDataFrame([("d",)], "id string"), "id")
    variants = [("none", rows, (), None), ("field", rows, ("f",), None), ("all", rows, ("f",), edges), ("kept", rows, ("f",), kept)]
    found = graph.tagged_components(variants, "id", scratch).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.variant, []).append(r.n)
    assert {k: sorted(v) for k, v in sizes.items()} == {"none": [1, 1, 1, 1], "field": [1, 1, 2], "all": [4], "kept": [1, 3]}


def test_parents_and_relations_join_components(spark, scratch):
    rows = spark.createDataFrame([("a", "x", None), ("b", None, "a"), ("c", None, "c"), ("d", None, ""), ("e", "y", "zz")], "id string, f string, parent string")
    between = graph.relation_edges(rows, "id", ["f"]).unionAll(graph.parent_edges(rows, "id", "parent"))
    found = {r.v: r.root for r in graph.components(rows.select(F.col("id").alias("v")), between, scratch).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_duplicate_summary(spark):
    rows = spark.createDataFrame([("t", "s", "A", 1), ("t", "s", "B", 1), ("t", "z", "A", 1), ("u", "s", "A", 2), (None, "s", "A", 3)], "t string, s string, gold string, block int")
    found = graph.duplicate_summary(rows, "t", "s", ["gold", "block"], "gold").first().asDict()
    assert found == {"distinct_texts": 2, "unique_share": 0.5, "excess_rows": 2, "groups": 1, "rows_in_groups": 3, "largest_group": 3, "groups_cross_gold": 1, "groups_cross_block": 0, "rows_cross_gold": 3, "distinct_text_states": 3}


def test_review_packets_of_too_few_edges_end_the_job(spark):
    edges = spark.createDataFrame([("a", "b", k, 1.0) for k in graph.PRIORITY for _ in range(2)], "left_id string, right_id string, edge_type string, score double")
    assert graph.review_packet(edges, 2, "s", exactly=True).count() == 6
    with pytest.raises(Exception, match="too few edges"):
        graph.review_packet(edges, 3, "s", exactly=True).collect()


def test_edge_selection_keeps_exact(spark):
    edges = spark.createDataFrame([("exact_semantic_signature", 0.1), ("char_ngram", 0.8), ("char_ngram", 0.9), ("token_jaccard", 0.9)], "edge_type string, score double")
    assert graph.edge_selection(edges, 0.82, 0.95).count() == 2
    assert graph.edge_selection(edges, None, None).count() == 1 and graph.edge_selection(edges, None, 0.9).count() == 2
