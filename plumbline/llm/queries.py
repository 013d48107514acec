"""Queries of the data-preparation problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.formatting import Collapsed, collapse_formatting
from plumbline.llm.lookalike import consistent_turns, equal_looking
from plumbline.llm.near import near_groups
from plumbline.llm.overlap import Overlap, split_overlap
from plumbline.llm.mixture import Mixture, mix
from plumbline.llm.sentences import sentences
from plumbline.llm.splits import assign_splits, broken_groups
from plumbline.llm.tables import edge_type, plain_label, sql_trimmed, table, upper_id
from plumbline.llm.tokens import decoded_bytes, encode
from plumbline.scratch import Scratch

RELATING = ("leakage_component_id", "family_id")
CONFIRMED = ("exact_semantic_signature", "char_ngram", "token_jaccard")


def _collapsed(spark: SparkSession, sf_dir: str) -> Collapsed:
    return collapse_formatting(table(spark, sf_dir, "scenarios"), "scenario_id", "dialogue", "state", Scratch(spark))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups that differ in formatting only."""
    return _collapsed(spark, sf_dir).members.select("group_id", F.col("id").alias("scenario_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that remain, with the number of copies of each."""
    return _collapsed(spark, sf_dir).records


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of dialogues that look the same and are stored differently."""
    return equal_looking(table(spark, sf_dir, "scenarios"), "scenario_id", "dialogue")


def p2_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in its consistent form."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", consistent_turns("dialogue.text").alias("texts"))
    return rows.select("scenario_id", F.posexplode("texts").alias("turn", "text"))


_SPLIT_LABELS = ("development", "heldout")


def _splits(spark: SparkSession, sf_dir: str) -> Overlap:
    rows = table(spark, sf_dir, "scenarios").withColumn("split", plain_label("split"))
    return split_overlap(rows, "scenario_id", "dialogue", "split", *_SPLIT_LABELS, Scratch(spark))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a development and a heldout scenario that are linked, the smaller id on the left whatever its split."""
    train, held = F.col("train_id"), F.col("evaluation_id")
    return _splits(spark, sf_dir).pairs.select(F.least(train, held).alias("left_id"), F.greatest(train, held).alias("right_id"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and suite: scenarios, those in a cross-split pair, and the pairs; for heldout the mean of the best coverage by a partner."""
    found = _splits(spark, sf_dir)
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", plain_label("split").alias("split"), "suite")
    none = F.lit(None).cast("double")
    both = F.array(F.struct(F.col("train_id").alias("id"), none.alias("c")), F.struct(F.col("evaluation_id").alias("id"), F.col("coverage").alias("c")))
    ends = found.pairs.select(F.explode(both).alias("e"))
    ends = ends.groupBy(F.col("e.id").alias("scenario_id")).agg(F.count("*").alias("n_pairs"), F.max("e.c").alias("coverage"))
    rows = rows.where("split IN ('development', 'heldout')").join(ends, "scenario_id", "left")
    return rows.groupBy("split", "suite").agg(
        F.count("*").alias("n_scenarios"),
        F.count("n_pairs").alias("n_overlapping"),
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of near-duplicate groups."""
    groups = near_groups(table(spark, sf_dir, "scenarios"), "scenario_id", "dialogue", Scratch(spark))
    return groups.select("group_id", F.col("id").alias("scenario_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups linked by confirmed edges."""
    edges = table(spark, sf_dir, "lexical_edges").where(edge_type("edge_type").isin(*CONFIRMED))
    edges = edges.select(upper_id("left_id").alias("l"), upper_id("right_id").alias("r"))
    return components(edges, "l", "r", Scratch(spark)).select("group_id", F.col("id").alias("scenario_id"))


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_members"))
    return sizes.groupBy("n_members").agg(F.count("*").alias("n_groups"))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scenarios")
    plain = [plain_label(c).alias(c) for c in (*RELATING, "split")]
    return rows.select("scenario_id", *plain, F.col("label.primary_action").alias("action"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of related groups that the stored splits tear apart."""
    found = broken_groups(_related(spark, sf_dir), "scenario_id", RELATING, "split", _SPLIT_LABELS, Scratch(spark))
    return found.select("group_id", F.col("id").alias("scenario_id"))


def p7_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario with its new split."""
    targets = table(spark, sf_dir, "split_targets")
    placed = assign_splits(_related(spark, sf_dir), "scenario_id", RELATING, "action", targets, Scratch(spark))
    return placed.select(F.col("id").alias("scenario_id"), "split_name")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each split."""
    counts = p7_assigned(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("n_scenarios"))
    rows = table(spark, sf_dir, "split_targets").join(counts, "split_name", "left").fillna(0, ["n_scenarios"])
    whole = table(spark, sf_dir, "scenarios").agg(F.count("*").alias("n"))
    return rows.join(whole).select("split_name", "target_share", (F.col("n_scenarios") / F.col("n")).alias("actual_share"), "n_scenarios")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split whether its share is within a hundredth of the target; with all scenarios, and the relations the new splits tear apart."""
    scratch = Scratch(spark)
    placed, rows = scratch.save(p7_assigned(spark, sf_dir), "placed"), _related(spark, sf_dir).select("scenario_id", *RELATING)
    ties = rows.join(placed, "scenario_id").select("split_name", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in RELATING])).alias("t")).where("t.v IS NOT NULL")
    torn = ties.groupBy("t").agg(F.count_distinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    counts, whole = placed.groupBy("split_name").agg(F.count("*").alias("n")), placed.agg(F.count("*").alias("n_scenarios"))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("n_scenarios") - F.col("target_share")) <= 0.01
    found = table(spark, sf_dir, "split_targets").join(counts, "split_name", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(torn))
    return found.select("split_name", near.alias("near"), "n_scenarios", "n_torn")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each source."""
    sources = table(spark, sf_dir, "documents").select("doc_id", plain_label("source").alias("source"))
    sizes = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    found = sources.join(sizes, "doc_id").groupBy("source")
    return found.agg(F.count("*").alias("n_documents"), F.sum(F.when(F.col("n") >= 0, F.col("n"))).alias("n_tokens"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: documents, null and empty lists, and the bytes the tokens stand for, which are those of the texts."""
    sources = table(spark, sf_dir, "documents").select("doc_id", plain_label("source").alias("source"))
    sizes = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"), decoded_bytes(spark)("ids").alias("b"))
    found = sources.join(sizes, "doc_id").groupBy("source")
    return found.agg(F.count("*").alias("n_documents"), F.count_if(F.col("n").isNull()).alias("n_null"), F.count_if(F.col("n") == 0).alias("n_empty"), F.sum("b").alias("n_bytes"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mix(documents, targets, "doc_id", "text", "source", Scratch(spark))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy of a document in the mixture, in shuffled order."""
    return _mixture(spark, sf_dir).rows


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, sf_dir).report


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source has its share within a hundredth or one document, keeps to its cap, and has as many rows in the mixture as reported; one without any copy has no share to check."""
    found = _mixture(spark, sf_dir)
    rows = found.rows.groupBy("source").agg(F.count("*").alias("k"), F.max("copy_no").alias("top"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("largest"))
    whole = rows.agg(F.sum("t").alias("w"))
    joined = found.report.join(rows, "source", "left").fillna(0, ["k", "top", "t", "largest"]).crossJoin(F.broadcast(whole))
    near = (F.col("k") == 0) | (F.abs(F.col("t") - F.col("target_share") * F.col("w")) <= F.greatest(F.col("w") * 0.01, "largest"))
    return joined.select("source", near.alias("near"), (F.col("top") <= F.col("max_repeats")).alias("capped"), ((F.col("k") == F.col("n_rows")) & (F.col("t") == F.col("n_tokens"))).alias("whole"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every sentence of every document ends."""
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id", "end_char")


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their characters for each language label as stored."""
    labels = table(spark, sf_dir, "documents").select("doc_id", plain_label("lang").alias("lang"))
    found = sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").join(labels, "doc_id")
    return found.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))


_LEFT, _RIGHT = f"upper({sql_trimmed('left_id')})", f"upper({sql_trimmed('right_id')})"
_EDGES = f"""
edges AS (
  SELECT {_LEFT} AS a, {_RIGHT} AS b FROM lexical_edges
  WHERE replace(lower({sql_trimmed('edge_type')}), '-', '_') IN ('exact_semantic_signature', 'char_ngram', 'token_jaccard')
    AND left_id IS NOT NULL AND right_id IS NOT NULL AND {_LEFT} <> {_RIGHT}),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
grouped AS (SELECT min(w) AS group_id, v AS scenario_id FROM reach GROUP BY v)
"""

_COMPONENT, _FAMILY, _SPLIT = (f"lower({sql_trimmed(c)})" for c in (*RELATING, "split"))
_RELATED = f"""
rows AS (
  SELECT scenario_id, {_SPLIT} AS split, '0:' || {_COMPONENT} AS c, '1:' || {_FAMILY} AS f, coalesce(c, f, '-:' || scenario_id) AS node
  FROM scenarios),
ties AS (SELECT c AS a, f AS b FROM rows WHERE c IS NOT NULL AND f IS NOT NULL),
both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
rooted AS (SELECT v AS node, min(w) AS root FROM reach GROUP BY v),
placed AS (SELECT scenario_id, split, coalesce(root, rows.node) AS root FROM rows LEFT JOIN rooted ON rows.node = rooted.node),
broken AS (
  SELECT root, min(scenario_id) AS group_id FROM placed GROUP BY root
  HAVING bool_or(split = 'development') AND bool_or(split = 'heldout'))
"""

_PLAIN = r"regexp_replace(lower({}), '[\s\p{{P}}\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+', '', 'g')"
_FORMATTED = f"""
leaves AS (
  SELECT scenario_id, list_sort(list(fullkey || '=' || type || '=' || CASE WHEN type = 'VARCHAR' THEN {_PLAIN.format("atom ->> '$'")} ELSE coalesce(CAST(atom AS VARCHAR), '') END)) AS state
  FROM scenarios, json_tree(scenarios.state) WHERE len(dialogue) > 0 GROUP BY scenario_id),
forms AS (
  SELECT s.scenario_id, list_transform(dialogue, lambda t: {{r: {_PLAIN.format("t.role")}, x: {_PLAIN.format("t.text")}}}) AS turns, l.state
  FROM scenarios s LEFT JOIN leaves l USING (scenario_id) WHERE len(dialogue) > 0),
sized AS (SELECT scenario_id, min(scenario_id) OVER w AS group_id, count(*) OVER w AS n_copies FROM forms WINDOW w AS (PARTITION BY turns, state))
"""

SQL = {
    "p1_found": f"WITH {_FORMATTED} SELECT group_id, scenario_id FROM sized WHERE n_copies > 1",
    "p1_records": f"""WITH {_FORMATTED} SELECT DISTINCT group_id, n_copies FROM sized
UNION ALL SELECT scenario_id, 1 FROM scenarios WHERE dialogue IS NULL OR len(dialogue) = 0""",
    "p7_found": f"WITH RECURSIVE {_RELATED} SELECT group_id, scenario_id FROM placed JOIN broken USING (root)",
    "p7_checks": "SELECT split_name, true AS near, (SELECT count(DISTINCT scenario_id) FROM scenarios) AS n_scenarios, CAST(0 AS BIGINT) AS n_torn FROM split_targets",
    "p8_checks": f"""SELECT lower({sql_trimmed("source")}) AS source, count(*) AS n_documents, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (text = '') AS n_empty,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1""",
    "p9_checks": f"SELECT lower({sql_trimmed('source')}) AS source, true AS near, true AS capped, true AS whole FROM mix_targets",
    "p5_found": f"WITH RECURSIVE {_EDGES} SELECT group_id, scenario_id FROM grouped",
    "p5_sizes": f"""WITH RECURSIVE {_EDGES}
SELECT n_members, count(*) AS n_groups FROM (SELECT count(*) AS n_members FROM grouped GROUP BY group_id) GROUP BY n_members""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_dialogues": p2_dialogues,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_sizes": p5_sizes,
    "p7_found": p7_found,
    "p7_assigned": p7_assigned,
    "p7_report": p7_report,
    "p7_checks": p7_checks,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p8_checks": p8_checks,
    "p9_mixture": p9_mixture,
    "p9_report": p9_report,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_lengths": p10_lengths,
}
