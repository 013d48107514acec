"""The event ledger as a stream: windowed counts with late rows, and exactly-one selection per batch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.delivery import SeenStore
from plumbline.scratch import Scratch


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """New files of a folder as a stream; of a single file's folder, that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs, where = Scratch(spark)._fs(path)  # noqa: SLF001
    if fs.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def windowed_status(events: DataFrame, width: str, late: str, every: str | None = None) -> DataFrame:
    """(start, end, status, n): events by completion time; rows later than ``late`` are dropped with their window closed.

    Rows without a completion time are in no window.
    """
    timed = events.where("completed_at IS NOT NULL").withColumn("at", F.col("completed_at").cast("timestamp")).withWatermark("at", late)
    window = F.window("at", width, every) if every else F.window("at", width)
    counted = timed.groupBy(window.alias("w"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")


def bursts(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): sessions of events with no pause of ``gap`` or more."""
    timed = events.where("completed_at IS NOT NULL").withColumn("at", F.col("completed_at").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, scratch: Scratch, mode: str = "complete") -> DataFrame:
    """Process what there is now and give the result as a table: the last batch's in complete mode, all batches' in append mode."""
    spark, root = stream.sparkSession, f"{scratch.root}/stream-{uuid.uuid4().hex[:8]}"

    def keep(batch: DataFrame, number: int) -> None:
        # Each batch has its own folder, so a batch that is tried again replaces itself.
        batch.write.mode("overwrite").parquet(f"{root}/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    fs, where = scratch._fs(root)  # noqa: SLF001
    if not fs.exists(where):
        return empty
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(root)


def select_once(stream: DataFrame, keys: dict[str, str], arrival_id: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """Every identifier's first delivery, batch after batch over one store of what was seen.

    A batch's rows are written before its version is committed. One that is tried again
    after a failure writes its result over itself, or finds its version committed and its
    rows in place, so each identifier stays once.
    """
    spark, root = stream.sparkSession, f"{scratch.root}/once-{uuid.uuid4().hex[:8]}"
    store = SeenStore(spark, f"{root}-seen", keys)

    def keep(batch: DataFrame, number: int) -> None:
        if store.version() > number:
            return
        store.accept(batch, arrival_id, order, lambda kept: kept.write.mode("overwrite").parquet(f"{root}/batch={number}"))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(root)
