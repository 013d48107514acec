"""Families of related records: pairs that should flip or hold, and trajectories over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Suites whose families are pairs, and the suite of trajectories.
PAIR_SUITES = ("counterfactual", "temporal", "institution_role")
MULTI_TURN = "multi_turn"


def family_rates(scored: DataFrame) -> DataFrame:
    """Counts and rates for each (method, suite) over families.

    A family is exact if all its rows are right. In the pair suites, families of two
    whose labels differ must flip, others must hold. The relation accuracy counts all
    families of the suite, also those that are no pairs; the rates of flips and holds
    have their own denominators and are null without any. Rows without a family are none.
    A family spread over suites belongs to the smallest suite in string order.
    """
    golds, preds = F.count_distinct("gold"), F.count_distinct("prediction")
    families = scored.where("family_id IS NOT NULL").groupBy("method", "family_id").agg(
        F.min("suite").alias("suite"), F.count("*").alias("n"), F.min((F.col("gold") == F.col("prediction")).cast("int")).alias("exact"),
        (golds > 1).alias("gold_flip"), (preds > 1).alias("pred_flip"),
    )
    pair = F.col("suite").isin(*PAIR_SUITES) & (F.col("n") == 2)
    counted = families.groupBy("method", "suite").agg(
        F.count("*").alias("families"), F.sum("exact").alias("family_exact"),
        F.count_if(pair).alias("pairs"),
        F.count_if(pair & (F.col("gold_flip") == F.col("pred_flip"))).alias("relation_correct"),
        F.count_if(pair & F.col("gold_flip")).alias("required_flips"),
        F.count_if(pair & F.col("gold_flip") & F.col("pred_flip")).alias("flips_correct"),
        F.count_if(pair & ~F.col("gold_flip")).alias("required_holds"),
        F.count_if(pair & ~F.col("gold_flip") & ~F.col("pred_flip")).alias("holds_correct"),
    )

    def rate(a: str, b: str):
        return F.col(a) / F.nullif(F.col(b), F.lit(0))

    return counted.select(
        "*", rate("family_exact", "families").alias("family_exact_rate"), rate("relation_correct", "families").alias("relation_accuracy"),
        rate("flips_correct", "required_flips").alias("flip_accuracy"), rate("holds_correct", "required_holds").alias("hold_accuracy"),
        (F.col("required_holds") - F.col("holds_correct")).alias("unwanted_flips"),
    )


def turn_positions(scored: DataFrame) -> DataFrame:
    """Rows of multi-turn families with their place by turns (ties by job id), the previous label and whether it changed."""
    w = Window.partitionBy("method", "family_id").orderBy("n_turns", "job_id")
    rows = scored.where((F.col("suite") == MULTI_TURN) & F.col("family_id").isNotNull())
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("previous_gold", F.lag("gold").over(w))
    return rows.withColumn("changed", F.coalesce(F.col("gold") != F.col("previous_gold"), F.lit(False)))


def trajectories(scored: DataFrame) -> DataFrame:
    """One row for each multi-turn family: last turn right, all right, changes, stale answers, delay until right again."""
    rows = turn_positions(scored).withColumn("ok", F.col("gold") == F.col("prediction"))
    whole = Window.partitionBy("method", "family_id")
    rows = rows.withColumn("first_change", F.min(F.when(F.col("changed"), F.col("place"))).over(whole))
    right_after = F.min(F.when((F.col("place") >= F.col("first_change")) & F.col("ok"), F.col("place")))
    return rows.groupBy("method", "family_id").agg(
        F.count("*").alias("n_turn_rows"), F.max_by("ok", "place").cast("int").alias("final_correct"), F.min(F.col("ok").cast("int")).alias("exact"),
        F.count_if("changed").alias("changes"), F.count_if(F.col("changed") & F.col("ok")).alias("correct_after_change"),
        F.count_if(F.col("changed") & (F.col("prediction") == F.col("previous_gold"))).alias("stale"),
        (right_after - F.min("first_change")).alias("delay"),
    )


def trajectory_rates(scored: DataFrame) -> DataFrame:
    """Rates over trajectories for each method; null where nothing changed."""
    t = trajectories(scored).groupBy("method").agg(
        F.count("*").alias("n_trajectories"), F.sum("final_correct").alias("final_correct"), F.sum("exact").alias("exact"), F.sum("changes").alias("changes"),
        F.sum("correct_after_change").alias("correct_after_change"), F.sum("stale").alias("stale"),
        F.count_if(F.col("changes") > 0).alias("with_change"), F.count("delay").alias("resolved"), F.coalesce(F.sum("delay"), F.lit(0)).alias("delay_sum"),
    )

    def rate(a: str, b: str):
        return F.col(a) / F.nullif(F.col(b), F.lit(0))

    return t.select(
        "*", (F.col("with_change") - F.col("resolved")).alias("unresolved"), rate("final_correct", "n_trajectories").alias("final_accuracy"),
        rate("correct_after_change", "changes").alias("update_accuracy"), rate("stale", "changes").alias("stale_rate"), rate("delay_sum", "resolved").alias("mean_delay"),
    )


def spanning_families(scored: DataFrame) -> DataFrame:
    """Families whose rows lie in more than one component; a sound corpus has none."""
    spans = scored.where("family_id IS NOT NULL").groupBy("family_id").agg(F.count_distinct("component_id").alias("n_components"))
    return spans.where("n_components > 1")


def pair_records(scored: DataFrame) -> DataFrame:
    """(method, suite, family_id, component_id, predicted_change, exact_pair): the pairs that must flip.

    Families of two in the pair suites whose labels differ. A family that spans components
    is no pair (``spanning_families`` names those).
    """
    families = scored.where("family_id IS NOT NULL").groupBy("method", "family_id").agg(
        F.min("suite").alias("suite"), F.count("*").alias("n"), F.count_distinct("gold").alias("golds"), F.count_distinct("component_id").alias("spread"), F.min("component_id").alias("component_id"),
        (F.count_distinct("prediction") > 1).alias("predicted_change"), F.bool_and(F.col("gold") == F.col("prediction")).alias("exact_pair"),
    )
    kept = families.where(F.col("suite").isin(*PAIR_SUITES)).where("n = 2 AND golds = 2 AND spread = 1")
    return kept.select("method", "suite", "family_id", "component_id", "predicted_change", "exact_pair")


def _in_one_component(rows: DataFrame) -> DataFrame:
    spread = Window.partitionBy("method", "family_id")
    least, most = F.min("component_id").over(spread), F.max("component_id").over(spread)
    return rows.withColumns({"__a": least, "__b": most}).where("__a = __b").drop("__a", "__b")


def change_records(scored: DataFrame) -> DataFrame:
    """(method, family_id, component_id, correct_after_change, stale_previous_action): every change of label within a trajectory."""
    rows = _in_one_component(turn_positions(scored)).where("changed")
    after, stale = F.col("prediction") == F.col("gold"), F.col("prediction") == F.col("previous_gold")
    return rows.select("method", "family_id", "component_id", after.alias("correct_after_change"), stale.alias("stale_previous_action"))


def trajectory_records(scored: DataFrame) -> DataFrame:
    """(method, family_id, component_id, complete_trajectory): whether all turns of a trajectory are right."""
    rows = _in_one_component(turn_positions(scored))
    return rows.groupBy("method", "family_id").agg(F.min("component_id").alias("component_id"), F.bool_and(F.col("gold") == F.col("prediction")).alias("complete_trajectory"))
