"""How alike two collections of texts are in form: lengths, character distributions, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import ngrams
from plumbline.scratch import Scratch


def length_profile(rows: DataFrame, by: str, length: Column) -> DataFrame:
    """Count, sum, median and outer tenths of the lengths of each group."""
    q = F.percentile(length, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = rows.groupBy(by).agg(F.count(length).alias("n"), F.sum(length).alias("total"), q.alias("q"))
    return found.select(by, "n", "total", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"))


def character_counts(rows: DataFrame, side: Column, text: Column, n: int) -> DataFrame:
    """(side, gram, c): all runs of ``n`` characters of each side with their number."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
    return rows.where(F.length(text) >= n).select(side.alias("side"), F.explode(grams).alias("gram")).groupBy("side", "gram").agg(F.count("*").alias("c"))


def jensen_shannon(counts: DataFrame, left: str, right: str) -> DataFrame:
    """(bits, vocabulary): divergence of the distributions of two sides."""
    wide = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("side") == s, F.col("c")).otherwise(0)).alias(c) for s, c in ((left, "a"), (right, "b"))])
    whole = wide.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))

    return wide.crossJoin(F.broadcast(whole)).agg(F.round(F.sum((part(p) + part(q)) / 2), 9).alias("bits"), F.count("*").alias("vocabulary"))


def marker_rates(rows: DataFrame, by: str, text: Column, markers: dict[str, str]) -> DataFrame:
    """How many texts of each group match each pattern, one column each."""
    return rows.groupBy(by).agg(F.count(text).alias("n"), *[F.count_if(text.rlike(p)).alias(f"n_{name}") for name, p in markers.items()])


#: Rarest grams by which a first neighbour is looked for.
FIRST = 8


def nearest(left: DataFrame, right: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(id, neighbour, similarity): for every text of ``left`` (id, text) the most alike of ``right`` by character n-grams, exactly.

    Ties go to the smallest id; texts that share no gram have no neighbour; ids are unique.
    A first neighbour is looked for by the FIRST rarest grams of a text. One as similar as
    that, s, shares at least s times the text's grams, so it holds one of the rarest
    n - ceil(s n) + 1; only those are searched again, among texts whose size allows s. Grams
    common to nearly all texts are thus joined only where nothing alike was found.
    """

    def sets(df: DataFrame, key: str, grams: str) -> DataFrame:
        hashed = F.transform(ngrams(F.col("text"), n), lambda g: F.xxhash64(g))
        return df.where("text IS NOT NULL").select(F.col("id").alias(key), hashed.alias(grams)).where(F.size(grams) > 0)

    a, b = scratch.save(sets(left, "id", "ga"), "left"), scratch.save(sets(right, "neighbour", "gb"), "right")
    held = b.select("neighbour", F.size("gb").alias("nb"), F.explode("gb").alias("gram"))
    frequent = held.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = a.select("id", F.size("ga").alias("na"), F.explode("ga").alias("gram")).join(frequent, "gram", "left").fillna(0, ["df"])
    # As many grams as the text has: one array a text.
    rarest = scratch.save(ranked.groupBy("id", "na").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda g: g["gram"]).alias("grams")), "rarest")

    def best(wanted: DataFrame) -> DataFrame:
        """The best partner of each id that shares a gram with it; ``wanted`` is (id, na, grams, least)."""
        asked = wanted.select("id", "na", "least", F.explode("grams").alias("gram"))
        fits = (F.least("na", "nb") >= F.col("least") * F.greatest("na", "nb") - 1e-9)
        met = asked.join(held, "gram").where(fits).select("id", "neighbour").distinct()
        both = met.join(a, "id").join(b, "neighbour").select("id", "neighbour", F.size(F.array_intersect("ga", "gb")).alias("c"), F.size("ga").alias("na"), F.size("gb").alias("nb"))
        scored = both.withColumn("similarity", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
        return scored.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "neighbour")).alias("b"))

    known = F.filter("grams", lambda g: g.isNotNull())
    first = scratch.save(best(rarest.select("id", "na", F.slice(known, 1, FIRST).alias("grams"), F.lit(0.0).alias("least"))), "first")
    bound = F.coalesce(-F.col("b.s"), F.lit(0.0))
    again = rarest.join(first, "id", "left").withColumn("least", bound)
    upto = F.col("na") - F.ceil(F.col("least") * F.col("na") - 1e-9).cast("int") + 1
    found = best(again.select("id", "na", F.slice("grams", F.lit(1), F.least("na", upto)).alias("grams"), "least"))
    return found.select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.s")).alias("similarity"))
