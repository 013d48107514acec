"""Agreement between raters, intervals of proportions, and panel decisions.

Every statistic is a closed form over whole-number sums, so partial sums of any
partitioning give the same result to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fleiss_kappa(ratings: DataFrame, item: str, rating: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., items, raters, observed, expected, kappa) over (item, rating) rows.

    All items must have the same number of ratings, two at least: otherwise ``equal`` is
    false and the statistics are null. Kappa is null where chance agreement is 1.
    """
    named = ratings.select(*by, F.col(item).alias("__item"), F.col(rating).alias("__rating"))
    cells = named.groupBy(*by, "__item", "__rating").agg(F.count("*").alias("c"))
    items = cells.groupBy(*by, "__item").agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    whole = items.groupBy(*by).agg(F.count("*").alias("items"), F.min("r").alias("raters"), F.max("r").alias("most"), F.sum("sq").alias("sq"), F.sum("r").alias("n"))
    shares = cells.groupBy(*by, "__rating").agg(F.sum("c").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    joined = whole.join(shares, list(by)) if by else whole.crossJoin(shares)
    ok = (F.col("raters") == F.col("most")) & (F.col("raters") > 1)
    # Mean over items of (sum c^2 - r) / (r (r - 1)), with whole-number numerator and denominator.
    observed = F.when(ok, (F.col("sq") - F.col("n")).cast("double") / (F.col("n") * (F.col("raters") - 1)))
    expected = F.when(ok, F.col("tt").cast("double") / (F.col("n") * F.col("n")))
    kappa = (observed - expected) / F.nullif(1.0 - expected, F.lit(0.0))
    return joined.select(*by, "items", "raters", ok.alias("equal"), observed.alias("observed"), expected.alias("expected"), kappa.alias("kappa"))


def intraclass(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of whole-number scores, two-way random effects, every rater on every item."""
    ratings = ratings.select(F.col(item).alias("__item"), F.col(rater).alias("__rater"), F.col(score).alias("__score"))
    rows = ratings.groupBy("__item").agg(F.sum("__score").alias("s"), F.count("*").alias("c"), F.sum(F.col("__score") * F.col("__score")).alias("q"))
    a = rows.agg(F.count("*").alias("n"), F.sum("s").alias("g"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("rr"), F.min("c").alias("k"), F.max("c").alias("k2"))
    b = ratings.groupBy("__rater").agg(F.sum("__score").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("cc"))
    t = a.crossJoin(b).select(*[F.col(c).cast("double").alias(c) for c in ("n", "g", "q", "rr", "k", "k2", "cc")])
    n, k = F.col("n"), F.col("k")
    mean = F.col("g") * F.col("g") / (n * k)
    t = t.withColumns({"ssr": F.col("rr") / k - mean, "ssc": F.col("cc") / n - mean, "sst": F.col("q") - mean})
    t = t.withColumns({"msr": F.col("ssr") / (n - 1), "msc": F.col("ssc") / (k - 1), "mse": (F.col("sst") - F.col("ssr") - F.col("ssc")) / ((n - 1) * (k - 1))})
    msr, msc, mse = F.col("msr"), F.col("msc"), F.col("mse")
    single = (msr - mse) / F.nullif(msr + (k - 1) * mse + k * (msc - mse) / n, F.lit(0.0))
    average = (msr - mse) / F.nullif(msr + (msc - mse) / n, F.lit(0.0))
    return t.where("k = k2").select(n.cast("long").alias("items"), k.cast("long").alias("raters"), single.alias("icc_single"), average.alias("icc_average"))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the 95% score interval; null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes / n
    scale = F.lit(1.0) + F.lit(z * z) / n
    middle = p + F.lit(z * z) / (2.0 * n)
    spread = F.lit(z) * F.sqrt(p * (1.0 - p) / n + F.lit(z * z) / (4.0 * n * n))
    return (middle - spread) / scale, (middle + spread) / scale


def panel_decisions(votes: DataFrame, item: str, choice: str, accepts: str, confidence: str) -> DataFrame:
    """(item, choice, votes, decision): confirm, revise or unresolved by panel of five.

    Four must select one choice with a median confidence of four or more; it is confirmed
    if four accept the current rule, revised if four do not, else unresolved. Equal vote
    counts go to the smallest choice.
    """
    counts = votes.groupBy(item, choice).agg(F.count("*").alias("votes"))
    top = counts.groupBy(item).agg(F.min_by(F.struct(choice, "votes"), F.struct(-F.col("votes"), F.col(choice))).alias("t"))
    rest = votes.groupBy(item).agg(F.count_if(accepts).alias("accept"), F.count_if(~F.col(accepts)).alias("reject"), F.median(confidence).alias("confidence"), F.count_distinct(choice).alias("n_choices"))
    found = top.join(rest, item)
    firm = (F.col("t.votes") >= 4) & (F.col("confidence") >= 4)
    decision = F.when(firm & (F.col("accept") >= 4), "confirm").when(firm & (F.col("reject") >= 4), "revise").otherwise("unresolved")
    return found.select(item, F.col("t.votes").alias("votes"), "accept", "confidence", (F.col("n_choices") == 1).alias("unanimous"), decision.alias("decision"))


def second_round(votes: DataFrame, item: str, choice: str, defect: str, acceptable: DataFrame) -> DataFrame:
    """(item, mode, reason): items for another round: votes that differ, a most frequent choice outside the acceptable ones, or any defect.

    ``acceptable`` is (item, acceptable array), unique; an item it lacks accepts nothing.
    Equal vote counts go to the smallest choice; the first reason that holds is given.
    """
    counts = votes.groupBy(item, choice).agg(F.count("*").alias("v"))
    top = counts.groupBy(item).agg(F.min_by(choice, F.struct(-F.col("v"), F.col(choice))).alias("mode"), F.count("*").alias("kinds"))
    flawed = votes.groupBy(item).agg(F.coalesce(F.bool_or(defect), F.lit(False)).alias("flawed"))
    joined = top.join(flawed, item).join(acceptable, item, "left")
    inside = F.coalesce(F.array_contains("acceptable", F.col("mode")), F.lit(False))
    reason = F.when(F.col("kinds") > 1, "not unanimous").when(~inside, "outside the acceptable actions").when(F.col("flawed"), "defect")
    return joined.select(item, "mode", reason.alias("reason")).where("reason IS NOT NULL")


def rating_summary(ratings: DataFrame, item: str, score: str, matches: str, defect: str) -> DataFrame:
    """(items, ratings, mean_score, match_rate, defects, defect_items): over all ratings, from whole-number sums."""
    sums = ratings.groupBy(item).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.count_if(matches).alias("m"), F.count_if(defect).alias("d"))
    return sums.agg(
        F.count("*").alias("items"), F.sum("n").alias("ratings"), (F.sum("s") / F.sum("n")).alias("mean_score"), (F.sum("m") / F.sum("n")).alias("match_rate"),
        F.sum("d").alias("defects"), F.count_if(F.col("d") > 0).alias("defect_items"),
    )


def panel_design(ratings: DataFrame, item: str, rater: str) -> DataFrame:
    """(ratings_per_item, n_items, n_raters): how many items have how many ratings, and by how many raters."""
    per_item = ratings.groupBy(item).agg(F.count("*").alias("k"), F.count_distinct(rater).alias("r"))
    return per_item.groupBy(F.col("k").alias("ratings_per_item")).agg(F.count("*").alias("n_items"), F.min("r").alias("least_raters"))


def broad_agreement(ratings: DataFrame, item: str, choice: str, score: str) -> DataFrame:
    """Items that are unanimous, that four raters agree on, and whose scores lie within one; with mean score."""
    cells = ratings.select(F.col(item).alias("__i"), F.col(choice).alias("__c"), F.col(score).alias("__s"))
    votes = cells.groupBy("__i", "__c").agg(F.count("*").alias("v")).groupBy("__i").agg(F.max("v").alias("top"), F.count("*").alias("kinds"))
    scores = cells.groupBy("__i").agg((F.max("__s") - F.min("__s")).alias("span"), F.sum("__s").alias("total"), F.count("*").alias("k"))
    joined = votes.join(scores, "__i")
    return joined.agg(
        F.count("*").alias("items"), F.count_if(F.col("kinds") == 1).alias("unanimous"), F.count_if(F.col("top") >= 4).alias("four_agree"),
        F.count_if(F.col("span") <= 1).alias("within_one"), (F.sum("total") / F.sum("k")).alias("mean_score"),
    )


def wrong_vote_totals(rows: DataFrame, key: str, votes: str, panel: int = 5) -> DataFrame:
    """(key, total): rows whose map of votes does not add up to the panel; null maps are left alone."""
    total = F.aggregate(F.map_values(votes), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))
    return rows.select(key, total.alias("total")).where(F.col("total") != panel)
