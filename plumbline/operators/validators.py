"""Checks that fail a job or report what is wrong, each one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n): keys that occur more than once, and null or empty ones."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | bad)


def assert_unique(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows, unless a key is repeated, null or empty: then the job ends when they are read."""
    bad = repeated_keys(rows, key).agg(F.count("*").alias("n_bad"))
    checked = bad.select(F.assert_true(F.col("n_bad") == 0, F.lit("keys are not unique")).alias("__ok"))
    return rows.crossJoin(F.broadcast(checked)).where("__ok IS NULL").drop("__ok")


def unequal(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., problem): rows of one side only, and those whose columns differ; null equals null."""
    a = left.select(*key, F.struct(*columns).alias("__a"))
    b = right.select(*key, F.struct(*columns).alias("__b"))
    joined = a.join(b, list(key), "full_outer")
    problem = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return joined.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def digest_mismatches(rows: DataFrame, key: str, stored: str, computed: Column) -> DataFrame:
    """(key): rows whose stored digest is not the computed one, without regard to case."""
    return rows.where(~F.lower(stored).eqNullSafe(computed)).select(key)


def cardinalities(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def unexpected_keys(rows: DataFrame, key: str, json: str, allowed: Sequence[str]) -> DataFrame:
    """(key, unexpected, absent): top-level keys of a JSON column against an exact set."""
    names = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    whole = F.array(*[F.lit(k) for k in allowed])
    found = rows.select(key, F.array_sort(F.array_except(names, whole)).alias("unexpected"), F.array_sort(F.array_except(whole, names)).alias("absent"))
    return found.where("size(unexpected) > 0 OR size(absent) > 0")


def key_sets(rows: DataFrame, json: str, allowed: Sequence[str]) -> DataFrame:
    """(keys, exact, n): the sets of top-level keys that occur in a JSON column, and whether each is the allowed one."""
    names = F.array_sort(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))
    exact = F.col("keys") == F.array(*[F.lit(k) for k in sorted(allowed)])
    return rows.select(names.alias("keys")).groupBy("keys").agg(F.count("*").alias("n")).select("keys", exact.alias("exact"), "n")


def assert_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """``cardinalities`` of the tables; one that has another number of rows than expected ends the job."""
    wanted = F.create_map(*[x for name, n in expected.items() for x in (F.lit(name), F.lit(n).cast("long"))]) if expected else F.lit(None).cast("map<string,bigint>")
    found = cardinalities(tables).withColumn("__want", wanted[F.col("name")])
    wrong = F.col("__want").isNotNull() & (F.col("n") != F.col("__want"))
    message = F.concat("name", F.lit(": "), F.col("n").cast("string"), F.lit(" rows, not "), F.col("__want").cast("string"))
    return found.select("name", F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.col("n")).alias("n"))


def beyond_tolerance(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(key..., metric, left, right, close): two reports of the same metrics, each within an absolute tolerance or not.

    A metric that one side lacks is not close; null is close to null only.
    """

    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
        return df.select(*key, F.explode(pairs).alias("metric", side)).withColumn(f"__{side}", F.lit(True))

    both = long(left, "left").join(long(right, "right"), [*key, "metric"], "full_outer")
    same = F.col("left").eqNullSafe(F.col("right")) | F.coalesce(F.abs(F.col("left") - F.col("right")) <= tolerance, F.lit(False))
    close = F.coalesce(F.col("__left") & F.col("__right"), F.lit(False)) & same
    return both.select(*key, "metric", "left", "right", close.alias("close"))


def unbound(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, problem): digests a report declares, (name, sha256), that are not those of the files it names."""
    found = unequal(declared.select("name", F.lower("sha256").alias("sha256")), actual.select("name", F.lower("sha256").alias("sha256")), ["name"], ["sha256"])
    return found.where("problem <> 'right_only'").select("name", F.when(F.col("problem") == "left_only", "no such file").otherwise("digest differs").alias("problem"))


def assert_bound(declared: DataFrame, actual: DataFrame) -> None:
    """Ends with an error unless every digest a report declares is that of the file."""
    wrong = unbound(declared, actual).orderBy("name").limit(5).collect()
    if wrong:
        raise ValueError("not bound: " + ", ".join(f"{r['name']} ({r.problem})" for r in wrong))


def require_status(status: str | None, allowed: Sequence[str]) -> str:
    """The status, which must be one of the allowed ones."""
    if status not in allowed:
        raise ValueError(f"status {status!r} is none of {sorted(allowed)}")
    return status


def broken_adjudications(rows: DataFrame, actions: Sequence[str], panel: int = 5) -> DataFrame:
    """(scenario_id, problem): adjudicated rows that break a rule of the release.

    A HIGH_CONFIDENCE row has one known final action, which alone is acceptable, with four
    votes and a median confidence of four at least; an UNRESOLVED one has no final action
    and known acceptable ones. Votes of a round that took place add up to the panel.
    ``rows``: scenario_id, reference_status, final_primary_action, final_acceptable_actions,
    supporting_votes, confidence_median, and maps round1_action_counts,
    round2_action_counts, round2_rule_acceptance_counts (null if there was no such round).
    """
    acceptable, final = F.col("final_acceptable_actions"), F.col("final_primary_action")
    sure = F.coalesce(final.isin(*actions) & (acceptable == F.array(final)) & (F.col("supporting_votes") >= 4) & (F.col("confidence_median") >= 4), F.lit(False))
    known = F.coalesce((F.size(acceptable) > 0) & F.forall(acceptable, lambda a: F.coalesce(a.isin(*actions), F.lit(False))), F.lit(False))

    def votes(column: str, must: bool) -> Column:
        total = F.aggregate(F.map_values(column), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))
        return F.coalesce(total != panel, F.lit(must))

    later = F.col("round2_action_counts").isNotNull()
    problem = (
        F.when(~F.coalesce(F.col("reference_status").isin("HIGH_CONFIDENCE", "UNRESOLVED"), F.lit(False)), "unknown status")
        .when((F.col("reference_status") == "HIGH_CONFIDENCE") & ~sure, "not high confidence")
        .when((F.col("reference_status") == "UNRESOLVED") & final.isNotNull(), "unresolved with an action")
        .when((F.col("reference_status") == "UNRESOLVED") & ~known, "unresolved without known actions")
        .when(votes("round1_action_counts", True), "votes of round one")
        .when(later & (votes("round2_action_counts", True) | votes("round2_rule_acceptance_counts", True)), "votes of round two")
    )
    return rows.select("scenario_id", problem.alias("problem")).where("problem IS NOT NULL")
