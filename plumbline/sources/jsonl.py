"""JSON and text sources with explicit schemas, and file sources with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object a line. Strict: a line that is no object of the schema ends the job; else it becomes nulls.

    Blank lines are skipped. The schema is given, never inferred, so only the columns a
    query asks for are parsed.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one object."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_prompt(spark: SparkSession, path: str) -> str:
    """The stripped text of one small file, which must not be empty."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    text = rows[0].value.strip() if len(rows) == 1 else ""
    if not text:
        raise ValueError(f"no text in {path}")
    return text


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", without: str = r"(^|/)__pycache__/|\.pyc$") -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, paths relative to it, but for caches (paths that match ``without``).

    Files are read whole by one task each, as a digest needs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = folder.split(":", 1)[-1].rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    files = files.where(~path.rlike(without))
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): files missing, not declared, of another size or content."""
    m = manifest.select("path", F.struct("bytes", "sha256").alias("m"))
    f = files.select("path", F.struct("bytes", "sha256").alias("f"))
    problem = (
        F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "undeclared")
        .when(F.col("m.bytes") != F.col("f.bytes"), "size").when(F.lower("m.sha256") != F.col("f.sha256"), "content")
    )
    return m.join(f, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")
