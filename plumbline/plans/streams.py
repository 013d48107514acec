"""Queries that read tables as streams, and files as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import Scratch
from plumbline.sources.jsonl import file_digests, manifest_differences
from plumbline.sources.tables import table
from plumbline.streaming import ledger


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/event_ledger.parquet"
    return ledger.read_ledger(spark, path, table(spark, sf_dir, "event_ledger").schema)


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each status in windows of six hours."""
    counted = ledger.windowed_status(_events(spark, sf_dir), "6 hours", "30 days")
    return ledger.run_to_table(counted, Scratch(spark)).select(F.unix_micros("start").alias("start_us"), "status", "n")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows of a day that begin every twelve hours."""
    counted = ledger.windowed_status(_events(spark, sf_dir), "24 hours", "30 days", "12 hours")
    return ledger.run_to_table(counted, Scratch(spark)).select(F.unix_micros("start").alias("start_us"), "status", "n")


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each method with no pause of half an hour."""
    found = ledger.bursts(_events(spark, sf_dir), "method", "30 minutes", "30 days")
    return ledger.run_to_table(found, Scratch(spark)).select("method", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each status after every identified event is kept once, in stream order."""
    once = ledger.select_once(_events(spark, sf_dir), {"job_id": "string", "run_generation": "long"}, "delivery_no", ["received_at"], Scratch(spark))
    return once.groupBy("run_generation").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("n_jobs"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table file with size and digest, and what a manifest says that leaves one out, names one more, and has another size and digest."""
    files = file_digests(spark, sf_dir, "*.parquet")
    name = F.col("path")
    manifest = files.where(name != "region.parquet").select(
        "path", (F.col("bytes") + F.when(name == "nation.parquet", 1).otherwise(0)).alias("bytes"), F.when(name == "part.parquet", F.reverse("sha256")).otherwise(F.upper("sha256")).alias("sha256")
    )
    more = spark.createDataFrame([("lost.parquet", 1, "00")], "path string, bytes long, sha256 string")
    differing = manifest_differences(manifest.unionByName(more), files)
    return files.join(differing, "path", "full_outer").select("path", "bytes", "sha256", "problem")


_US = 6 * 3600 * 1_000_000
SQL = {
    "stream_status": f"""SELECT epoch_us(completed_at) // {_US} * {_US} AS start_us, status, count(*) AS n FROM event_ledger
WHERE completed_at IS NOT NULL GROUP BY 1, 2""",
    "stream_sliding": f"""WITH w AS (SELECT epoch_us(completed_at) AS t, status, unnest([0, 1]) AS back FROM event_ledger WHERE completed_at IS NOT NULL)
SELECT (t // {2 * _US} - back) * {2 * _US} AS start_us, status, count(*) AS n FROM w GROUP BY 1, 2""",
    "stream_bursts": """WITH e AS (SELECT method, epoch_us(completed_at) AS t, delivery_no AS d FROM event_ledger WHERE completed_at IS NOT NULL),
s AS (SELECT method, t, d, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY method ORDER BY t, d)),
g AS (SELECT method, t, sum(fresh) OVER (PARTITION BY method ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT method, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY method, k""",
    "stream_once": """SELECT run_generation, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM (
  SELECT DISTINCT job_id, run_generation FROM event_ledger WHERE job_id IS NOT NULL AND run_generation IS NOT NULL) GROUP BY run_generation""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_status, stream_sliding, stream_bursts, stream_once, table_files)}
