"""Mixtures of sources with given shares of the tokens, by Poisson replication."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import plain_label
from plumbline.llm.tokens import PRE_TOKENS, TOKENIZERS, shared_ranks
from plumbline.scratch import Scratch

#: The hash of a document is read as one of so many quantiles.
QUANTILES = 4096
#: Sources a mixture may have: bounds what the driver holds (SOURCES * QUANTILES sums).
SOURCES = 1000
_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def token_counts(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A pandas UDF: tokens of each text, null for null. The vocabulary, which no data changes, is read once and broadcast."""
    ranks = shared_ranks(spark, name, folder)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if (folder, name) not in _encodings:
            pattern = PRE_TOKENS.replace(r"\P{White_Space}", r"\S").replace(r"[^\p{White_Space}", r"[^\s").replace(r"\p{White_Space}", r"\s")
            _encodings[folder, name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encoding = _encodings[folder, name]
        for texts in batches:
            yield pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count


def poisson_steps(rate: float, most: int) -> tuple[int, list[float]]:
    """(base, cuts): a document of quantile u occurs ``base`` times, and once more for each cut that u exceeds, ``most`` at most.

    The cuts are P(X <= k) of a Poisson variable of this mean, but only those that tell
    quantiles apart: with logarithms, so that no mean is too large, and at most some
    sixteen standard deviations of them.
    """
    if math.isinf(rate):
        return most, []
    if rate <= 0:
        return 0, []
    spread = 8 * math.sqrt(rate) + 40
    base = min(most, max(0, math.floor(rate - spread)))
    total, cuts = 0.0, []
    for k in range(base, min(most, math.ceil(rate + spread))):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        cuts.append(total)
    return base, cuts


def _replicated(sums: dict[int, int], rate: float, most: int) -> int:
    base, cuts = poisson_steps(rate, most)
    return sum(n * (base + bisect.bisect_left(cuts, (q + 0.5) / QUANTILES)) for q, n in sums.items())


def solve_rate(sums: dict[int, int], most: int, wanted: float) -> float:
    """The Poisson mean at which documents capped at ``most`` copies come nearest ``wanted`` tokens."""
    if wanted >= most * sum(sums.values()) * (1 - 1e-12):
        return math.inf
    low, high = 0.0, 1.0
    while _replicated(sums, high, most) < wanted:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _replicated(sums, middle, most) < wanted else (low, middle)
    return min((low, high), key=lambda rate: abs(_replicated(sums, rate, most) - wanted))


class Mixture(NamedTuple):
    """``rows``: one for each copy, in shuffled order; ``report``: one for each source."""

    rows: DataFrame
    report: DataFrame


def mix(
    documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, scratch: Scratch,
    total: int | None = None, keep: Sequence[str] = (), seed: int = 17, name: str = "byte_bpe_50k", folder: str = TOKENIZERS,
) -> Mixture:
    """Copies of the documents of the sources in ``targets`` (source, target_share, max_repeats).

    The size of the mixture is the largest at which every source can give its share
    within its cap, or ``total`` tokens if that is less. How often a document occurs is a
    Poisson quantile of its hashed key, cut off at ``max_repeats``; the mean of each source
    is set so that its copies hold its share of the tokens, by token sums over quantiles
    of the hash, which are at most SOURCES * QUANTILES numbers.

    Sources compare without case and outer blanks; a repeated target is an error, as are
    more than SOURCES of them. Documents of other or null sources are not mixed; those
    with a null or empty text have no tokens and cannot add to a share, they occur in no
    copy. A target without documents is reported with a share of 0. Rows repeated under
    one key get the same number of copies each. Columns in ``keep`` are carried along.
    """
    spark = documents.sparkSession
    wanted = targets.select(plain_label("source").alias("source"), "target_share", "max_repeats").limit(SOURCES + 1).collect()
    if len(wanted) > SOURCES or len({w.source for w in wanted}) < len(wanted):
        raise ValueError("targets must name each source once, and at most 1000 of them")
    names = [w.source for w in wanted]
    rows = documents.select(F.col(key).alias("key"), plain_label(source).alias("source"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = rows.where(F.col("source").isin(names)) if names else rows.where("false")
    quantile = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(QUANTILES)).cast("int").alias("quantile")
    sized = rows.select("key", "source", token_counts(spark, name, folder)("text").alias("n_tokens"), quantile, *[f"keep_{c}" for c in keep])
    sized = scratch.save(sized.where("n_tokens > 0"), "sized")

    sums: dict[str, dict[int, int]] = {n: {} for n in names}
    for row in sized.groupBy("source", "quantile").agg(F.sum("n_tokens").alias("n")).collect():
        sums[row.source][row.quantile] = row.n
    most = [w.max_repeats * sum(sums[w.source].values()) / w.target_share for w in wanted if w.target_share > 0 and sums[w.source]]
    size = min([*most, *([total] if total is not None else [])], default=0)
    plan = []
    for w in wanted:
        rate = solve_rate(sums[w.source], w.max_repeats, w.target_share * size) if sums[w.source] else 0.0
        plan.append((w.source, float(w.target_share), w.max_repeats, *poisson_steps(rate, w.max_repeats)))
    planned = spark.createDataFrame(plan, "source string, target_share double, max_repeats long, base long, cuts array<double>")

    u = (F.col("quantile") + 0.5) / QUANTILES
    times = F.col("base") + F.size(F.filter("cuts", lambda c: u > c))
    drawn = sized.join(F.broadcast(planned.select("source", "base", "cuts")), "source").withColumn("n_copies", times).where("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    place = F.xxhash64("key", "copy_no", F.lit(seed + 1)).alias("place")
    mixed = copies.select(F.col("key").alias(key), "source", "copy_no", "n_tokens", place, *[F.col(f"keep_{c}").alias(c) for c in keep])
    mixed = mixed.repartitionByRange("place").sortWithinPartitions("place")

    got = drawn.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n_copies").alias("n_rows"),
        F.sum(F.col("n_copies") * F.col("n_tokens")).alias("n_tokens"), F.max("n_copies").alias("most_copies"),
    )
    everything = got.agg(F.sum("n_tokens").alias("all_tokens"))
    report = F.broadcast(planned).join(got, "source", "left").join(F.broadcast(everything))
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_rows", "n_tokens", "most_copies")]
    share = F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share")
    return Mixture(mixed, report.select("source", "target_share", "max_repeats", share, *nothing))
