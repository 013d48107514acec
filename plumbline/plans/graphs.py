"""Queries of the corpus graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.canonical import canonical
from plumbline.functions.labels import plain_label, sql_plain, sql_trimmed, sql_upper, upper_id
from plumbline.operators import graph, resplit
from plumbline.scratch import Scratch
from plumbline.sources.tables import table

_BOTH = ("component_id", "family_id")
_ALL = tuple(graph.PRIORITY)
# Relation fields and edge types of each way to define components, pairs of
# thresholds (character, token), caps on cluster rows, and the gates of a corpus.
VARIANTS = {
    "rows_only": ((), ()),
    "family_only": (("family_id",), ()),
    "authoring_block_only": (_BOTH, ()),
    "family_plus_all_text_edges": (("family_id",), _ALL),
    "authoring_block_plus_exact": (_BOTH, ("exact_semantic_signature",)),
    "authoring_block_plus_char": (_BOTH, ("char_ngram",)),
    "authoring_block_plus_token": (_BOTH, ("token_jaccard",)),
    "authoring_block_plus_all_text_edges": (_BOTH, _ALL),
}
THRESHOLDS = ((None, None), (0.82, 0.88), (0.86, 0.92), (0.90, 0.94), (0.94, 0.96), (0.96, 0.98))
CAPS = (100, 150, 200, 250, 300, 400, 500)
CAP = 300
GATES = {
    "scenarios": 10000,
    "families": 5750,
    "authoring_blocks": 500,
    "maximum_component_rows": 300,
    "maximum_component_share": 0.03,
    "minimum_effective_components_inverse_hhi": 50.0,
    "minimum_realized_components": 200,
    "minimum_unique_dialogue_state_pair_share": 0.9,
}
SEED = "27072027"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with comparable ids and labels."""
    rows = table(spark, sf_dir, "scenarios")
    return rows.select("scenario_id", upper_id("component_id").alias("component_id"), upper_id("family_id").alias("family_id"), "suite", plain_label("split").alias("split"), F.col("label.primary_action").alias("gold"), F.sha2(F.to_json("dialogue"), 256).alias("exact_text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed edges between two different scenarios, each unordered pair and type once with its best score."""
    kind = F.replace(plain_label("edge_type"), F.lit("-"), F.lit("_"))
    rows = table(spark, sf_dir, "lexical_edges").select(upper_id("left_id").alias("l"), upper_id("right_id").alias("r"), kind.alias("edge_type"), "score")
    rows = rows.where("l IS NOT NULL AND r IS NOT NULL AND l <> r").where(F.col("edge_type").isin(*graph.PRIORITY))
    return rows.groupBy(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"), "edge_type").agg(F.max("score").alias("score"))


def _between_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are both scenarios."""
    found, ids = edges(spark, sf_dir), table(spark, sf_dir, "scenarios").select("scenario_id")
    for side in ("left_id", "right_id"):
        found = found.join(ids.withColumnRenamed("scenario_id", side), side, "left_semi")
    return found.select("left_id", "right_id", "edge_type", "score")


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_ends(edges(spark, sf_dir), records(spark, sf_dir), "scenario_id", ["component_id", "family_id", "suite", "split", "gold"])


def component_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size summaries of the component definitions, and how many edges each takes in."""
    scratch = Scratch(spark)
    rows, links = scratch.save(records(spark, sf_dir), "records"), scratch.save(_between_records(spark, sf_dir), "edges")
    parts = [(name, rows, fields, links.where(F.col("edge_type").isin(*kinds)) if kinds else None) for name, (fields, kinds) in VARIANTS.items()]
    counts = links.groupBy().agg(*[F.count_if(F.col("edge_type").isin(*kinds)).alias(name) if kinds else F.lit(0).cast("long").alias(name) for name, (_, kinds) in VARIANTS.items()])
    included = counts.select(F.explode(F.create_map(*[x for name in VARIANTS for x in (F.lit(name), F.col(name))])).alias("variant", "included_edges"))
    return graph.size_summary(graph.tagged_components(parts, "scenario_id", scratch), ["variant"]).join(F.broadcast(included), "variant")


def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of blocks, families and the edges that remain at each pair of thresholds."""
    scratch = Scratch(spark)
    rows, links = scratch.save(records(spark, sf_dir), "records"), scratch.save(_between_records(spark, sf_dir), "edges")
    parts = [(str(i), rows, _BOTH, graph.edge_selection(links, *pair)) for i, pair in enumerate(THRESHOLDS)]
    found = graph.size_summary(graph.tagged_components(parts, "scenario_id", scratch), ["variant"])
    return found.withColumn("step", F.col("variant").cast("int")).drop("variant")


def component_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest authoring blocks."""
    sizes = records(spark, sf_dir).where("component_id IS NOT NULL").groupBy(F.col("component_id").alias("root")).agg(F.count("*").alias("n"))
    return graph.top_sizes(sizes)


def edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each type, and how many go across blocks, suites and labels."""
    return graph.edge_statistics(_ended(spark, sf_dir), ["component_id", "suite", "gold"])


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between each pair of blocks."""
    return graph.block_pairs(_ended(spark, sf_dir), "component_id")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("component_id IS NOT NULL").groupBy(F.col("component_id").alias("block")).agg(F.count("*").alias("n"))


def bounded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks merged along their strongest pairs up to a cap."""
    return graph.bounded_clusters(_weights(spark, sf_dir), block_pairs(spark, sf_dir), CAP, Scratch(spark))


def _crossing(ended: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges with ends in different clusters."""
    for side in ("left", "right"):
        ended = ended.join(clusters.select(F.col("block").alias(f"{side}_component_id"), F.col("cluster").alias(f"{side}_cluster")), f"{side}_component_id")
    return ended.where("left_cluster <> right_cluster")


def cross_cluster_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that cover all edges between clusters."""
    return graph.family_cover(_crossing(_ended(spark, sf_dir), bounded_clusters(spark, sf_dir)), Scratch(spark))


def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with an edge into another block, their records and such edges."""
    crossing = _ended(spark, sf_dir).where("left_component_id <> right_component_id")
    families = crossing.select(F.explode(F.array("left_family_id", "right_family_id")).alias("family_id")).where("family_id IS NOT NULL")
    return graph.repair_candidates(records(spark, sf_dir), crossing, families)


def repair_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cap: clusters, edges across them, families and rows to rewrite, and the components once these are rewritten.

    The components of all caps are contracted in one loop.
    """
    scratch = Scratch(spark)
    rows, links = scratch.save(records(spark, sf_dir), "records"), scratch.save(_between_records(spark, sf_dir), "edges")
    weights, pairs = scratch.save(_weights(spark, sf_dir), "weights"), scratch.save(block_pairs(spark, sf_dir), "pairs")
    ended, out, parts = scratch.save(_ended(spark, sf_dir), "ended"), None, []
    for cap in CAPS:
        clusters = scratch.save(graph.bounded_clusters(weights, pairs, cap, scratch), "clusters")
        crossing = _crossing(ended, clusters)
        families = scratch.save(graph.family_cover(crossing, scratch), "families")
        chosen = scratch.save(rows.join(families.withColumnRenamed("family", "family_id"), "family_id").select("scenario_id"), "chosen")
        parts.append((str(cap), rows, _BOTH, graph.without_vertices(links, chosen, "scenario_id")))
        report = graph.cluster_report(clusters, pairs).select(F.col("components").alias("n_clusters"), F.col("maximum_rows").alias("largest_cluster"), "most_blocks", "accepted_pairs", "rejected_pairs")
        counts = [crossing.agg(F.count("*").alias("n_crossing")), families.agg(F.count("*").alias("n_families")), chosen.agg(F.count("*").alias("n_rows"))]
        one = report.select(F.lit(str(cap)).alias("variant"), "*")
        for count in counts:
            one = one.crossJoin(F.broadcast(count))
        out = one if out is None else out.unionAll(one)
    after = graph.size_summary(graph.tagged_components(parts, "scenario_id", scratch), ["variant"])
    return out.join(F.broadcast(after), "variant").withColumn("cap", F.col("variant").cast("int")).drop("variant")


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with digests of the normal form of their dialogue and of their canonical state."""
    rows = table(spark, sf_dir, "scenarios")
    line = F.when(F.size("dialogue") > 0, text.dialogue_line(F.col("dialogue")))
    rows = rows.select("scenario_id", upper_id("component_id").alias("component_id"), upper_id("family_id").alias("family_id"), "suite", F.col("label.primary_action").alias("gold"), text.normalized(line).alias("t"), canonical("state").alias("s"))
    return rows.withColumns({"normal": F.sha2(F.col("t").cast("binary"), 256), "state": F.sha2(F.col("s").cast("binary"), 256)}).drop("t", "s")


def duplicate_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of groups of dialogues with one normal form, and what they cross."""
    rows = _normal(spark, sf_dir).where("normal IS NOT NULL")
    return graph.duplicate_groups(rows, F.col("normal"), ["component_id", "suite", "gold"])


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normal forms, dialogue and state pairs, and groups in sum."""
    return graph.duplicate_summary(_normal(spark, sf_dir), "normal", "state", ["component_id", "suite", "gold"], "gold")


def stored_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histogram over dialogues as stored."""
    rows = records(spark, sf_dir).where("exact_text IS NOT NULL")
    return graph.duplicate_groups(rows, F.col("exact_text"), ["component_id", "suite", "gold"])


def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hundred edges of each type for a blinded review."""
    return graph.review_packet(edges(spark, sf_dir), 100, SEED)


def split_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage components with scenarios in more than one split."""
    rows = table(spark, sf_dir, "scenarios").select(upper_id("leakage_component_id").alias("component"), plain_label("split").alias("split"))
    found = rows.where("component IS NOT NULL").groupBy("component").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n"))
    return found.where("n_splits > 1")


def component_resplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heldout split of whole leakage components with a fifth of the rows: rows, rows that enter and leave, and components of both splits."""
    rows = table(spark, sf_dir, "scenarios").select(upper_id("leakage_component_id").alias("component"), plain_label("split").alias("split"), "suite", F.col("label.primary_action").alias("gold"))
    placed = resplit.resplit(rows, "component", "split", "suite", "gold", 0.2, int(SEED))
    joined = rows.join(placed, "component")
    return joined.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_components"), F.count_if(~F.col("split").eqNullSafe(F.col("split_name"))).alias("n_moved"))


def _realized(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Sizes of the components of blocks, families and all edges."""
    return graph.tagged_components([("all", records(spark, sf_dir), _BOTH, _between_records(spark, sf_dir))], "scenario_id", scratch)


def diversity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the corpus passes the nine gates: exact counts, component sizes, distinct dialogue and state pairs, edges across clusters."""
    scratch = Scratch(spark)
    rows = _normal(spark, sf_dir)
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("family_id").alias("families"), F.count_distinct("component_id").alias("blocks"))
    pairs = rows.where("normal IS NOT NULL").groupBy("normal", "state").agg(F.count("*").alias("k")).agg(F.count("*").alias("pairs"))
    sizes = graph.size_summary(_realized(spark, sf_dir, scratch))
    clusters = graph.bounded_clusters(_weights(spark, sf_dir), block_pairs(spark, sf_dir), CAP, scratch)
    across = _crossing(_ended(spark, sf_dir), clusters).agg(F.count("*").alias("n_crossing"))
    one = counts.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(across))
    return graph.gates(one, [
        ("scenarios_exact", F.col("n") == GATES["scenarios"]),
        ("families_exact", F.col("families") == GATES["families"]),
        ("authoring_blocks_exact", F.col("blocks") == GATES["authoring_blocks"]),
        ("maximum_component_rows", F.col("maximum_rows") <= GATES["maximum_component_rows"]),
        ("maximum_component_share", F.col("maximum_share") <= GATES["maximum_component_share"]),
        ("minimum_effective_components", F.col("effective_components") >= GATES["minimum_effective_components_inverse_hhi"]),
        ("minimum_realized_components", F.col("components") >= GATES["minimum_realized_components"]),
        ("minimum_unique_dialogue_state_pair_share", F.col("pairs") / F.col("n") >= GATES["minimum_unique_dialogue_state_pair_share"]),
        ("zero_cross_bounded_cluster_lexical_edges", F.col("n_crossing") == 0),
    ])


_RECORDS = f"""
records AS (SELECT scenario_id, {sql_upper("component_id")} AS component_id, {sql_upper("family_id")} AS family_id, suite,
  {sql_plain("split")} AS split, label.primary_action AS gold, dialogue FROM scenarios),
edges AS (
  SELECT least(l, r) AS left_id, greatest(l, r) AS right_id, edge_type, max(score) AS score FROM (
    SELECT {sql_upper("left_id")} AS l, {sql_upper("right_id")} AS r, replace(lower({sql_trimmed("edge_type")}), '-', '_') AS edge_type, score FROM lexical_edges)
  WHERE l <> r AND edge_type IN ('exact_semantic_signature', 'char_ngram', 'token_jaccard') GROUP BY ALL),
ended AS (
  SELECT e.*, a.component_id AS lc, b.component_id AS rc, a.suite AS ls, b.suite AS rs, a.gold AS lg, b.gold AS rg
  FROM edges e JOIN records a ON a.scenario_id = left_id JOIN records b ON b.scenario_id = right_id)
"""
_SUMMARY = """count(*) AS components, min(n) AS minimum_rows, median(CAST(n AS DOUBLE)) AS median_rows, max(n) AS maximum_rows, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS maximum_share,
  CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) * sum(n) AS BIGINT) AS hhi, CAST(sum(n) * sum(n) AS DOUBLE) / CAST(sum(n * n) AS BIGINT) AS effective_components"""
_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
rooted AS (SELECT v, min(w) AS root FROM reach GROUP BY v)"""


def _sql_relations(tag: str, fields: tuple[str, ...]) -> list[str]:
    return [f"SELECT '{tag}|' || scenario_id AS a, '{tag}|' || min(scenario_id) OVER (PARTITION BY {f}) AS b FROM records WHERE {f} IS NOT NULL AND {f} <> ''" for f in fields]


def _sql_variants() -> tuple[str, str]:
    vertices, links = [], []
    for name, (fields, kinds) in VARIANTS.items():
        inside = ", ".join(f"'{k}'" for k in kinds) or "''"
        vertices.append(f"SELECT '{name}' AS variant, '{name}|' || scenario_id AS v, (SELECT count(*) FROM ended WHERE edge_type IN ({inside})) AS included_edges FROM records")
        links += _sql_relations(name, fields)
        links.append(f"SELECT '{name}|' || left_id AS a, '{name}|' || right_id AS b FROM ended WHERE edge_type IN ({inside})")
    return " UNION ALL ".join(vertices), " UNION ALL ".join(links)


def _sql_steps() -> tuple[str, str]:
    vertices, links = [], []
    for i, (char, token) in enumerate(THRESHOLDS):
        vertices.append(f"SELECT {i} AS step, '{i}|' || scenario_id AS v FROM records")
        links += _sql_relations(str(i), _BOTH)
        kept = "edge_type = 'exact_semantic_signature'"
        if char is not None:
            kept += f" OR edge_type = 'char_ngram' AND score >= {char} OR edge_type = 'token_jaccard' AND score >= {token}"
        links.append(f"SELECT '{i}|' || left_id AS a, '{i}|' || right_id AS b FROM ended WHERE {kept}")
    return " UNION ALL ".join(vertices), " UNION ALL ".join(links)


_VERTICES, _LINKS = _sql_variants()
_STEPS, _STEP_LINKS = _sql_steps()

SQL = {
    "component_variants": f"""WITH RECURSIVE {_RECORDS}, links AS ({_LINKS}), {_REACH}, vertices AS ({_VERTICES}),
sizes AS (SELECT variant, included_edges, coalesce(root, vertices.v) AS root, count(*) AS n FROM vertices LEFT JOIN rooted ON rooted.v = vertices.v GROUP BY ALL)
SELECT variant, included_edges, {_SUMMARY} FROM sizes GROUP BY variant, included_edges""",
    "threshold_sensitivity": f"""WITH RECURSIVE {_RECORDS}, links AS ({_STEP_LINKS}), {_REACH}, vertices AS ({_STEPS}),
sizes AS (SELECT step, coalesce(root, vertices.v) AS root, count(*) AS n FROM vertices LEFT JOIN rooted ON rooted.v = vertices.v GROUP BY ALL)
SELECT step, {_SUMMARY} FROM sizes GROUP BY step""",
    "component_top10": f"""WITH {_RECORDS}, top AS (SELECT component_id, count(*) AS n FROM records WHERE component_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, component_id LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY n DESC, component_id) AS INTEGER) AS rank, n FROM top""",
    "edge_statistics": f"""WITH {_RECORDS} SELECT edge_type, count(*) AS n, count(*) FILTER (lc IS DISTINCT FROM rc) AS cross_component_id,
  count(*) FILTER (ls IS DISTINCT FROM rs) AS cross_suite, count(*) FILTER (lg IS DISTINCT FROM rg) AS cross_gold,
  min(score) AS min_score, median(score) AS median_score, max(score) AS max_score FROM ended GROUP BY edge_type""",
    "block_pairs": f"""WITH {_RECORDS} SELECT least(lc, rc) AS block_a, greatest(lc, rc) AS block_b, count(*) AS edge_count,
  count(*) FILTER (edge_type = 'exact_semantic_signature') AS n_exact_semantic_signature, count(*) FILTER (edge_type = 'char_ngram') AS n_char_ngram,
  count(*) FILTER (edge_type = 'token_jaccard') AS n_token_jaccard, max(score) AS max_score,
  max(CASE edge_type WHEN 'exact_semantic_signature' THEN 3 WHEN 'char_ngram' THEN 2 ELSE 1 END) AS priority FROM ended WHERE lc <> rc GROUP BY 1, 2""",
    "repair_candidates": f"""WITH {_RECORDS}, x AS (
  SELECT e.left_id, e.right_id, e.edge_type, a.family_id AS lf, b.family_id AS rf FROM edges e JOIN records a ON a.scenario_id = left_id JOIN records b ON b.scenario_id = right_id
  WHERE a.component_id <> b.component_id),
f AS (SELECT DISTINCT left_id, right_id, edge_type, lf AS family_id FROM x WHERE lf IS NOT NULL UNION SELECT left_id, right_id, edge_type, rf FROM x WHERE rf IS NOT NULL),
n AS (SELECT family_id, count(*) AS n_edges FROM f GROUP BY family_id)
SELECT family_id, (SELECT count(*) FROM records r WHERE r.family_id = n.family_id) AS n_rows, n_edges FROM n""",
    "stored_duplicates": f"""WITH {_RECORDS}, groups AS (
  SELECT count(*) AS size, count(DISTINCT component_id) > 1 AS c, count(DISTINCT suite) > 1 AS s, count(DISTINCT gold) > 1 AS g
  FROM records WHERE dialogue IS NOT NULL GROUP BY dialogue HAVING count(*) > 1)
SELECT size, count(*) AS n_groups, CAST(sum(size - 1) AS BIGINT) AS excess, count(*) FILTER (c) AS cross_component_id, count(*) FILTER (s) AS cross_suite, count(*) FILTER (g) AS cross_gold FROM groups GROUP BY size""",
    "review_packet": f"""WITH {_RECORDS} SELECT left_id, right_id, edge_type, score, CAST(place AS INTEGER) AS place, edge_type || '-' || lpad(CAST(place AS VARCHAR), 4, '0') AS packet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY sha256('{SEED}|' || edge_type || '|' || left_id || '|' || right_id), left_id, right_id) AS place FROM edges)
WHERE place <= 100""",
    "split_crossing": f"""SELECT component, count(DISTINCT split) AS n_splits, count(*) AS n FROM (
  SELECT {sql_upper("leakage_component_id")} AS component, {sql_plain("split")} AS split FROM scenarios) WHERE component IS NOT NULL GROUP BY component HAVING count(DISTINCT split) > 1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        component_variants, threshold_sensitivity, component_top10, edge_statistics, block_pairs, bounded_clusters, cross_cluster_cover,
        repair_candidates, repair_simulation, duplicate_dialogues, duplicate_report, stored_duplicates, review_packet, split_crossing, component_resplit, diversity_gates,
    )
}
