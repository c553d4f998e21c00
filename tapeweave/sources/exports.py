"""Artefacts as files: JSON lines with sorted keys, a sample of them, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(rows: DataFrame, path: str, hidden: dict[str, str] | None = None, compression: str = "gzip") -> None:
    """Writes JSON lines, their keys in order of name; `hidden` columns are written as pseudonyms with that prefix."""
    shown = lambda c: F.concat(F.lit(hidden[c]), F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 10)).alias(c) if hidden and c in hidden else F.col(c)
    rows.select(*map(shown, sorted(rows.columns))).write.option("compression", compression).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of each file of data below the path, from what is there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def nested_captures(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Captures of all files, and the lines that can't be read: of captures with one mint the first in order of file and
    line is kept, sorted by nothing but ready to be. Both have file."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    named = read.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("at", F.monotonically_increasing_id())
    broken = F.col("_corrupt_record").isNotNull() | F.col("mint").isNull()
    first = F.min_by(F.struct(*(c for c in named.columns if c not in ("_corrupt_record", "at"))), F.struct("file", "at"))
    kept = named.where(~broken).groupBy("mint").agg(first.alias("x")).select("x.*")
    return kept, named.where(broken).select("file", F.col("_corrupt_record").alias("line"))


def pruned(captures: DataFrame, window: int) -> DataFrame:
    """Captures whose swaps name their signature only within `window` seconds of the creation."""
    return captures.withColumn("swaps", F.transform("swaps", lambda s: s.withField("sig", F.when(s["ts"] <= F.col("created") + window, s["sig"]))))
