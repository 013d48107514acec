"""A keyword baseline: smoothed log-odds of tokens for each label, learned from one split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels a baseline may have.
LABELS = 100
#: Numbers, Latin words and single ideographs of a text in lower case whose numbers are <num>.
NUMBER, TOKEN = r"[0-9]+(?:[./:-][0-9]+)*", r"(<num>|[a-z]+|[\x{4e00}-\x{9fff}])"


def tokens(text: Column) -> Column:
    """Distinct tokens of a text: u: and a single one, b: and two adjacent ones."""
    single = F.regexp_extract_all(F.regexp_replace(F.lower(text), NUMBER, "<num>"), F.lit(TOKEN), F.lit(1))
    # Zipped with itself one on: inside a lambda the extraction would run for every element.
    n = F.greatest(F.size(single) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(single, F.lit(1), n), F.slice(single, F.lit(2), n), lambda a, b: F.concat(F.lit("b:"), a, b))
    return F.array_distinct(F.concat(F.transform(single, lambda t: F.concat(F.lit("u:"), t)), pairs))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """(label, n_label, total, prior): smoothed log prior of every label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_label"))
    whole = counts.agg(F.sum("n_label").alias("total"), F.count("*").alias("k"))
    prior = F.log((F.col("n_label") + 1) / (F.col("total") + F.col("k")))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n_label", "total", prior.alias("prior"))


def _label_array(labels: DataFrame, label: str, columns: list[str]) -> Column:
    """The labels as one literal array; more than LABELS are refused, so its size is bounded."""
    rows = labels.select(label, *columns).orderBy(label).limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    entries = [F.struct(*[F.lit(r[c]).alias(c) for c in (label, *columns)]) for r in rows]
    return F.array(*entries) if entries else F.array().cast("array<struct<" + ",".join(f"{c}:{t}" for c, t in labels.select(label, *columns).dtypes) + ">>")


def log_odds(rows: DataFrame, text: str, label: str, least: int = 5, top: int = 100) -> DataFrame:
    """(label, token, df_in, df_out, weight): the ``top`` tokens of each label, weight descending, then token.

    A token counts once in a row; tokens in fewer than ``least`` rows are left out.
    """
    labels = label_counts(rows, label)
    each = rows.select(F.col(label), F.explode(tokens(F.col(text))).alias("token"))
    inside = each.groupBy("token", label).agg(F.count("*").alias("df_in"))
    all_df = inside.groupBy("token").agg(F.sum("df_in").alias("df")).where(F.col("df") >= least)
    each_label = F.explode(_label_array(labels, label, ["n_label", "total"])).alias("l")
    grid = all_df.select("*", each_label).select("token", "df", "l.*").join(inside, ["token", label], "left").fillna(0, ["df_in"])
    n_in, n_out = F.col("n_label"), F.col("total") - F.col("n_label")
    df_out = F.col("df") - F.col("df_in")
    weight = F.log((F.col("df_in") + 0.5) / (n_in + 1)) - F.log((df_out + 0.5) / (n_out + 1))
    grid = grid.select(label, "token", "df_in", df_out.alias("df_out"), weight.alias("weight"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("weight"), "token"))
    return grid.withColumn("place", place).where(F.col("place") <= top)


def predict(rows: DataFrame, key: str, text: str, weights: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(key, prediction): prior plus the weights of the tokens present; ties to the smallest label.

    Weights are at most labels x top rows; rows without any token follow the prior.
    """
    each = rows.select(key, F.explode(tokens(F.col(text))).alias("token"))
    scores = each.join(F.broadcast(weights.select("token", label, "weight")), "token").groupBy(key, label).agg(F.sum("weight").alias("score"))
    each_label = F.explode(_label_array(labels, label, ["prior"])).alias("l")
    grid = rows.select(key, each_label).select(key, "l.*").join(scores, [key, label], "left")
    total = F.round(F.col("prior") + F.coalesce("score", F.lit(0.0)), 9)
    best = F.min_by(F.col(label), F.struct((-total).alias("s"), F.col(label)))
    return grid.groupBy(key).agg(best.alias("prediction"))
