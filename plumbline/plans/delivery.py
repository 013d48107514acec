"""Queries of the delivery operator over the event ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.delivery import SeenStore
from plumbline.scratch import Scratch
from plumbline.sources.tables import table

KEYS = {"job_id": "string", "run_generation": "long"}
WAVES = 3


def _store(spark: SparkSession) -> SeenStore:
    shards = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return SeenStore(spark, f"{Scratch(spark).root}/seen", KEYS, shards)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_ledger").select("delivery_no", "received_at", *KEYS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery to be dropped."""
    batch = _store(spark).accept(_arrivals(spark, sf_dir), "delivery_no", ["received_at"])
    return batch.dropped.select("delivery_no")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one delivery of each identified event that stays."""
    batch = _store(spark).accept(_arrivals(spark, sf_dir), "delivery_no", ["received_at"])
    return batch.kept.select("job_id", "run_generation", "delivery_no")


def p6_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger replayed as three successive batches over one store: counts of each."""
    arrivals = _arrivals(spark, sf_dir)
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    low, high = arrivals.agg(F.min(at), F.max(at)).first()
    low, span = low or 0, (high or 0) - (low or 0) + 1
    arrivals = arrivals.withColumn("wave", F.floor((at - F.lit(low)) * WAVES / F.lit(span)))
    store, out = _store(spark), None
    for wave in range(WAVES):
        batch = store.accept(arrivals.where(F.col("wave") == wave), "delivery_no", ["received_at"])
        counts = batch.kept.select(F.lit(1).alias("k")).unionAll(batch.dropped.select(F.lit(0).alias("k")))
        counts = counts.agg(
            F.lit(wave).alias("wave"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_kept"), F.count("k").alias("n_arrivals")
        )
        out = counts if out is None else out.unionAll(counts)
    return out


_FIRST = """
  SELECT *, row_number() OVER (PARTITION BY job_id, run_generation ORDER BY received_at, delivery_no) AS rn
  FROM event_ledger WHERE job_id IS NOT NULL AND run_generation IS NOT NULL
"""

SQL = {
    "p6_found": f"SELECT delivery_no FROM ({_FIRST}) WHERE rn > 1",
    "p6_kept": f"SELECT job_id, run_generation, delivery_no FROM ({_FIRST}) WHERE rn = 1",
    "p6_waves": f"""
WITH span AS (SELECT epoch_us(min(received_at)) AS lo, epoch_us(max(received_at)) - epoch_us(min(received_at)) + 1 AS w FROM event_ledger),
marked AS (SELECT rn, CAST(floor((epoch_us(received_at) - lo) * {WAVES} / w) AS INTEGER) AS wave FROM ({_FIRST}), span)
SELECT wave, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, count(*) AS n_arrivals FROM marked GROUP BY wave
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found,
    "p6_kept": p6_kept,
    "p6_waves": p6_waves,
}
