"""Tables that cut lineage, kept in the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset (tests, a
laptop) a temporary folder is used, but only under a local master: a machine-local folder
on a cluster would be unreadable from other machines.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "plumbline.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts, taken from the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_FALLBACK, None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set(_FALLBACK, made)
    return made


class Scratch:
    """A run's own corner of the shared folder, removed when the process ends.

    Written tables survive the loss of executors, which a local checkpoint would not.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def save(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """Write ``df`` as a table, in files of at most ``file_rows`` rows if given, and return a reader of it."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path  # noqa: SLF001
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables nothing will read again."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                fs, where = self._fs(path)
                fs.delete(where, True)

    def clear(self) -> None:
        """Remove the whole corner; quiet if the session is already gone."""
        try:
            fs, where = self._fs(self.root)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001, S110
            pass
