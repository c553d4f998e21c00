"""Captures in many files and folders, each with a role: the first of each key is kept, what isn't is counted by reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(spark: SparkSession, sources: list[tuple[str, str]], schema: str) -> DataFrame:
    """Every line below the sources' paths, with its role, file and place: in order of sources, files and lines."""
    parts = []
    for number, (role, path) in enumerate(sources):
        read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
        at = F.struct(F.lit(number).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        parts.append(read.withColumn("role", F.lit(role)).withColumn("place", at))
    return reduce(DataFrame.unionByName, parts)


def scan(spark: SparkSession, sources: list[tuple[str, str]], schema: str, key: str, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """sources: (role, path), first come first. Of rows with one key the first is kept, with its role and place, unless a
    source of an excluded role has the key too: that is the first table. The second counts, for each role, its rows and
    those `unreadable` (no JSON of the schema, or no key), `excluded`, `repeated` and `kept`.

    A key is settled by an aggregate that begins in the tasks that read, so a key that most rows repeat stays small."""
    rows = rows_of(spark, sources, schema)
    broken = F.col("_corrupt_record").isNotNull() | F.col(key).isNull()
    good = rows.where(~broken).drop("_corrupt_record")
    barred = F.bool_or(F.col("role").isin(*excluded)) if excluded else F.lit(False)
    first = good.groupBy(key).agg(F.min_by(F.struct(*(c for c in good.columns if c != key)), "place").alias("first"), barred.alias("barred"))
    kept = first.where(~F.col("barred")).select(key, "first.*")
    keys = good.groupBy(key, "role").count().join(first.select(key, "barred", F.col("first.role").alias("by")), key)
    mine = F.when(~F.col("barred") & (F.col("role") == F.col("by")), 1).otherwise(0)
    settled = keys.groupBy("role").agg(F.sum(mine).alias("kept"), F.sum(F.when(F.col("barred"), F.col("count")).otherwise(0)).alias("excluded"))
    read = rows.groupBy("role").agg(F.count("*").alias("rows"), F.count_if(broken).alias("unreadable"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counted = read.join(settled, "role", "left").select("role", "rows", "unreadable", none("excluded"), none("kept"))
    return kept, counted.withColumn("repeated", F.col("rows") - F.col("unreadable") - F.col("excluded") - F.col("kept"))


def last_wins(spark: SparkSession, sources: list[tuple[str, str]], schema: str, key: str) -> DataFrame:
    """Of captures (with an array `swaps`) that have one key, the last in order of sources, files and lines; captures without
    swaps, and lines that can't be read, take no part."""
    rows = rows_of(spark, sources, schema)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull() & (F.size("swaps") > 0)).drop("_corrupt_record")
    last = good.groupBy(key).agg(F.max_by(F.struct(*(c for c in good.columns if c != key)), "place").alias("last"))
    return last.select(key, "last.*")


def whole(spark: SparkSession, path: str, schema: str, names: str = "*") -> DataFrame:
    """Documents that fill a file each (an array at the top gives a row for each item), with the file. A file that can't be
    parsed fails the read, and so does a folder without a file of such a name."""
    read = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", names).option("recursiveFileLookup", "true").json(path)
    if not read.inputFiles():
        raise ValueError(f"no file {names} below {path}")
    return read.withColumn("file", F.col("_metadata.file_path"))
